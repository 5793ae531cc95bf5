import random

from sourcewise.operators import layout, order, stats

F = order.F


def test_running_values_equal_a_loop_without_a_single_partition(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 1, 5, 5, 7]), rng.random() if k % 9 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, a int, x double").repartition(5)
    got = order.Ordered(df, "a", "id").numbered("i").running(s=("sum", F.col("id")), m=("max", F.col("x"))).frame
    assert "SinglePartition" not in got._jdf.queryExecution().toString() and "single partition" not in got._jdf.queryExecution().toString()
    want, s, m = [], 0, None
    for i, (k, a, x) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))):
        s, m = s + k, x if m is None else m if x is None else max(m, x)
        want.append((k, a, x, i, s, m))
    assert sorted((tuple(r) for r in got.select("id", "a", "x", "i", "s", "m").collect()), key=lambda r: r[3]) == want
    assert order.Ordered(df.limit(0), "a").numbered().frame.count() == 0


def test_average_ranks_share_ties(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0, 1.0, None]
    got = {r.id: r.rank for r in order.average_ranks(spark.createDataFrame(list(enumerate(values)), "id int, v double"), "v").collect()}
    assert got == {0: 5.0, 1: 1.5, 2: 5.0, 3: 3.0, 4: 5.0, 5: 1.5, 6: None}


def test_folds_are_even_and_repeat(spark):
    df = spark.range(1003)
    a, b = (sorted(map(tuple, order.permutation_folds(df.repartition(n), "id", 10, 3).collect())) for n in (1, 6))
    sizes = [sum(f == k for _, f in a) for k in range(10)]
    assert a == b and max(sizes) - min(sizes) <= 1 and a != sorted(map(tuple, order.permutation_folds(df, "id", 10, 4).collect()))


def test_no_window_reads_the_whole_table(spark):
    points = spark.createDataFrame([(k, random.Random(k).random(), random.Random(-k).random()) for k in range(300)], "id long, x double, y double")
    p = spark.createDataFrame([(f"n{k}", (k * 37 % 100) / 1000) for k in range(100)], "name string, p double")
    for df in (layout.curve_slots(points, 600), stats.holm(p), order.average_ranks(p, "p")):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert all("_part" in line for line in text.splitlines() if " Window [" in line)
