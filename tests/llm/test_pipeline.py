import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from test_byte_bpe import expected
from test_decontaminate import brute as hits
from test_near_dup import brute as groups

from sourcewise.llm import pii, quality

DATA = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in quality.judged(docs, carried=["doc_id"]).where("kept").select("row.doc_id").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    rows = [r for r, g in zip(rows, groups(rows), strict=True) if r[0] == g]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {h[0] for h in hits(rows, items) if h[5]}
    rows = [r for r in rows if r[0] not in bad]
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {k: expected(t) for k, t in clean.items()}
    assert 0 < len(bad) and 0 < len(got) < docs.count()


def test_stages_keep_columns_and_take_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, None, None, None, 1, 2), (1, "", "en", "s", 0, 1, 2)] + [(k, " ".join(f"w{k % 3}x{i}" for i in range(60)), "en", "s", 9, 1, 2) for k in (4, 4, 5, 6)], "doc_id long, text string, lang string, source string, n_chars long, row_key int, clean int")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DATA)
        assert now.columns == docs.columns
    assert sorted(r.doc_id for r in now.collect()) == [4, 5, 6]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
