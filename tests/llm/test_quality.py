import re
from collections import Counter

from sourcewise.llm import quality

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts_equal_brute_force(spark):
    got = {r.doc_id: r for r in quality.op9_quality_rules(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert tuple(got[r.doc_id][c] for c in BASE) == brute(r.text)
        assert not (got[r.doc_id].base_failed and got[r.doc_id].kept)


def test_edge_rows(spark):
    texts = [None, "", " \n\t", "a " * 7, "a b c d e f g h " * 3, "Über\x0bmäßig 😀 # x\n# x\n", "q " * 5000, " ".join(f"w{i}" for i in range(6000))]
    docs = spark.createDataFrame([(i, t, None if i % 2 else "en", "s", i, 1) for i, t in enumerate(texts)] + [(0, None, "en", "s", 0, 1)], "doc_id long, text string, lang string, source string, n_words int, row int")
    got = quality.judged(docs).select("row.doc_id", *BASE, "kept").collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert tuple(r[c] for c in BASE) == brute(texts[r.doc_id])
    assert quality.keep(docs).columns == docs.columns
    assert quality.keep(docs.limit(0)).count() == 0


def test_keeps_good_and_drops_junk(spark):
    got = quality.op9_quality_rules(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    table = {(q, k): n for q, k, n in got.where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert table.get((1, False), 0) <= 0.01 * table[1, True]
    assert table.get((0, True), 0) <= 0.1 * table[0, False]


def test_cutoffs_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, seven = (sorted(tuple(r) for r in quality.cutoffs(quality.sketches(quality.measures(docs.repartition(n), []))).collect()) for n in (1, 7))
    assert one == seven and len(one) > 1


def test_stored_and_repeated_measures_agree(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    once = {r.doc_id for r in quality.judged(docs, ["doc_id"], stored=True).where("kept").select("row.doc_id").collect()}
    assert once == {r.doc_id for r in quality.keep(docs).collect()}
