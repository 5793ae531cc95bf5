import hashlib
import re

from sourcewise.llm import decontaminate as d
from sourcewise.llm.common import Workspace

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def nearly(win, w):
    for s in range(-2, len(w) + 3):
        if all(win[i] in w[max(s + i - 2, 0) : max(s + i + 3, 0)] for i in range(len(win))):
            return True
    return False


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add("null" if item is None else str(item))
    lengths = sorted({len(w) for w in windows})
    for key, text in docs:
        w, hit, own, near = words(text), set(), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    own |= found
        held = set(w)
        for win, of in windows.items():
            if held.issuperset(win) and not of <= near and nearly(win, w):
                near |= of
        yield key, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), len(near - own)


def same(spark, docs, items, **how):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    work = Workspace(spark, "test")
    got = d.contamination(d.matches(work, d.build_index(work, a), b, **how)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs, items), key=str)


def test_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    same(spark, docs, items)
    same(spark, docs, items, block_words=300)


def test_edges(spark):
    long = "x " + "a b " * 9
    docs = [(1, None), (2, ""), (3, "A b. c Über_ß"), (3, "A b. c Über_ß"), (4, long), (5, "b c über ß zz " * 300), (6, "c über"), (7, "..."), (8, " ".join(f"v{i}" for i in range(60_000)))]
    items = [(1, "b C über ß"), (2, long), (2, long), (3, None), (4, " !"), (10, "c"), (None, "v7 v8")]
    same(spark, docs, items)
    same(spark, docs, [])
    same(spark, [], items)


def test_matches_stay_in_their_document(spark):
    same(spark, [(1, "zz zz"), (2, "a b c d"), (3, "b a"), (4, "c d b a c d")], [(1, "b a c d")])
    same(spark, [(1, "q w"), (2, ""), (3, "e r t"), (4, "w e r")], [(1, "w e r"), (2, "q w e r")])


def test_moved_and_inserted_words_are_near(spark):
    w = [f"k{i}" for i in range(20)]
    docs = [(1, " ".join(w)), (2, " ".join(w[:6] + ["x"] + w[6:])), (3, " ".join(w[:5] + [w[6], w[5]] + w[7:])), (4, " ".join(w[:6] + ["x"] * 6 + w[6:])), (5, " ".join(w[::-1]))]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(w[:13]))], "item_id long, text string")
    work = Workspace(spark, "test")
    got = {r.doc_id: (r.n_items, r.n_near) for r in d.contamination(d.matches(work, d.build_index(work, a), b)).collect()}
    assert got == {1: (1, 0), 2: (0, 1), 3: (0, 1), 4: (0, 0), 5: (0, 0)}


def test_one_index_serves_several_benchmarks(spark):
    rows = [(1, "one two three four five"), (2, "two three"), (3, "six")]
    work = Workspace(spark, "test")
    index = d.build_index(work, spark.createDataFrame(rows, "doc_id long, text string"))
    for items in ([(1, "two three")], [(2, "six"), (3, "four five")]):
        found = d.contamination(d.matches(work, index, spark.createDataFrame(items, "item_id long, text string")))
        assert sorted(map(tuple, found.collect())) == sorted(brute(rows, items))


def test_clean_keeps_columns_and_rows(spark):
    long = " ".join(f"k{i}" for i in range(13))
    docs = spark.createDataFrame([(1, long, 5, 6), (1, long, 5, 6), (2, "k1 k2", 7, 8), (2, "k1 k2", 7, 8), (3, None, 1, 2)], "doc_id long, text string, TEXT_KEY int, `a.b` int")
    left = d.clean(docs, spark.createDataFrame([(1, long)], "item_id long, text string"))
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect())) == [(2, "k1 k2", 7, 8), (2, "k1 k2", 7, 8), (3, None, 1, 2)]
