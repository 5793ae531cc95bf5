"""Small forms of what failed on larger tables in round 4."""

import itertools
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from sourcewise.operators import layout, neighbors, order, refine


def test_a_point_with_many_links_moves_too(spark):
    side, hub = 101, 0
    cells = spark.range(side * side).selectExpr("id", "cast(id div 101 as int) as row", "cast(id % 101 as int) as col")
    edges = spark.range(1, side * side).selectExpr(f"{hub}L as src", "id as dst")
    done = refine.refine(cells, edges, side, sigmas=(1.5,), anchor=0.0, rounds=4).cache()
    assert done.select("row", "col").distinct().count() == side * side
    assert layout.neighbor_objective(edges, done, 1.5).first()[0] < layout.neighbor_objective(edges, cells, 1.5).first()[0] - 5


def test_far_links_cost_the_same_at_each_cell():
    assert (refine.energy(np.array([refine.FLAT * 9.0, 1e6]), 3.0) == 1.0).all()


def test_the_estimate_of_a_rounds_size_does_not_grow(spark):
    cells = spark.range(30).selectExpr("id", "cast(id div 6 as int) as row", "cast(id % 6 as int) as col")
    done = refine.refine(cells, spark.range(29).selectExpr("id as src", "id + 1 as dst"), 6, sigmas=(2.0,), rounds=4)
    assert int(str(done._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10**7


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_a_stored_step_leaves_no_shuffle_behind(spark):
    before = shuffle_files(spark)
    kept = order.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k"))
    assert not shuffle_files(spark) - before
    assert kept.count() == 7 and sum(r["count"] for r in kept.collect()) == 1000


def test_similar_pairs_keep_words_in_their_task_and_equal_sets_as_one(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "ITEM_CLASSES", 4)  # most items share a class
    draw = random.Random(3)
    base = [draw.sample(range(60), 12) for _ in range(6)]
    sets = {i: sorted({*draw.choice(base)} - {draw.randrange(60)}) for i in range(60)} | {60: [], 61: []}
    written = []
    put = order.Tables.put
    monkeypatch.setattr(order.Tables, "put", lambda self, df, *used: written.append(put(self, df, *used)) or written[-1])
    found = neighbors.similar_pairs(spark.createDataFrame(list(sets.items()), "id long, v array<int>"), 0.75)
    got = {(r.src, r.dst): r.dist for r in found.collect()}
    alike = {(a, b): len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) for a, b in itertools.permutations(range(60), 2)}
    want = {k: 1 - s for k, s in alike.items() if s >= 0.75 - 1e-12}
    assert got == pytest.approx(want) and len(got) == found.count()
    compared = written[-1].count()
    assert 0 < compared < sum(a < b for a, b in want) and not any("string" in t or t == "array<int>" for df in written[2:] for _, t in df.dtypes)
