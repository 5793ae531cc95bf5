import math

import numpy as np

from sourcewise.operators import evaluation as V

F = V.F


def loop(values, replicates, rng):
    """Means when datasets, and then the entries of every copy, are drawn one by one."""
    names = sorted(values)
    out = []
    for _ in range(replicates):
        s = n = 0.0
        for d in rng.integers(0, len(names), len(names)):
            x = values[names[d]]
            pick = rng.integers(0, len(x), len(x))
            s, n = s + sum(x[p] for p in pick), n + len(x)
        out.append(s / n)
    return np.array(out)


def test_two_stage_draws_vary_as_a_plain_loop_does(spark):
    rng = np.random.default_rng(1)
    values = {f"d{k:02d}": (rng.normal(0, 1) + rng.normal(0, 1, 5)).tolist() for k in range(40)}
    frame = spark.createDataFrame([(d, f"e{i}", x) for d, v in values.items() for i, x in enumerate(v)], "dataset string, entry string, x double")
    got = np.array([r.s / r.n for r in V.two_stage_draws(frame, "dataset", "entry", 20_000, 5).select("s", "n").collect()])
    # closed form: copies of a dataset are drawn evenly, and entries evenly within each copy
    means, inner = np.array([np.mean(v) for v in values.values()]), np.array([np.var(v) / 5 for v in values.values()])
    exact = (means.var() + inner.mean()) / 40
    plain = loop(values, 20_000, np.random.default_rng(2))
    assert abs(got.var() / exact - 1) < 0.03 and abs(got.var() / plain.var() - 1) < 0.05 and abs(plain.var() / exact - 1) < 0.03
    a, b = np.quantile(got, [0.025, 0.975]), np.quantile(plain, [0.025, 0.975])
    assert np.abs(a - b).max() < 0.05 * (b[1] - b[0])
    row = V.two_stage_bootstrap(frame, "dataset", "entry", 4000, 5).first()
    assert abs(row.mean - np.mean(sum(values.values(), []))) < 1e-12
    assert abs(row.high - row.low - (b[1] - b[0])) < 0.05 * (b[1] - b[0])


def test_blocks_of_draws_add_up(spark):
    trials = np.array([0, 1, 50, 100_000])
    blocks = [V.drawn(trials, 1003, b, (7, 2), 100) for b in range(11)]
    assert (sum(x.sum(1) for x in blocks) == trials).all() and blocks[-1].shape == (4, 3)
    many = np.concatenate(blocks, 1)[3]
    assert abs(many.mean() - 100_000 / 1003) < 1e-9 and abs(many.var() / (100_000 / 1003) - 1) < 0.2
    frame = spark.range(9000).select((F.col("id") % 3 == 0).alias("d"), F.col("id").alias("e"), (F.col("id") % 7).cast("double").alias("x"))
    one, two = (sorted(map(tuple, V.two_stage_draws(f, "d", "e", 20).collect())) for f in (frame, frame.repartition(7)))
    assert one == two


def em(values, tau, df, grid, rounds, tolerance):
    """Responsibilities by loops over entries."""
    rows = []
    for v in values:
        z = (np.array(v)[:, None] - grid) / tau
        rows.append((-0.5 * z * z if df is None else -(df + 1) / 2 * np.log1p(z * z / df)).sum(0))
    weight = np.full(len(grid), 1 / len(grid))
    for _ in range(rounds):
        total = np.zeros(len(grid))
        for ll in rows:
            r = np.exp(ll - ll.max()) * weight
            total += r / r.sum()
        moved, weight = np.abs(total / len(rows) - weight).max(), total / len(rows)
        if moved < tolerance:
            break
    return weight


def test_npmle_equals_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    values = [rng.normal(rng.choice([5.0, 7.5]), 0.5, rng.integers(1, 6)).tolist() for _ in range(120)]
    doc = spark.createDataFrame([(f"e{i:03d}", f"d{j}", x) for i, v in enumerate(values) for j, x in enumerate(v)], "entry string, document string, document_value double").repartition(3)
    grid = 1.0 + 0.1 * np.arange(121)
    for df in (None, 5.0):
        want = em(values, 0.5, df, grid, 25, 1e-4)
        got = V.npmle(doc, 0.5, df, step=0.1, tolerance=1e-4, rounds=25, smoothing=None).orderBy("x").toPandas()
        assert np.abs(got["weight"] - want).max() < 1e-6 and np.allclose(got["x"], grid)
    smooth = V.npmle(doc, 0.5, 5.0, step=0.1, tolerance=1e-4, rounds=25).orderBy("x").toPandas()["weight"].to_numpy()
    kernel = [math.exp(-0.5 * (k * 0.1 / 0.15) ** 2) for k in range(-8, 9)]
    plain = np.array([sum(kernel[k + 8] * want[i + k] for k in range(-8, 9) if 0 <= i + k < len(want)) for i in range(len(want))])
    assert np.abs(smooth - plain / plain.sum()).max() < 1e-6


def test_predictions_under_both_laws(spark):
    doc = spark.createDataFrame([("a", "1", 4.0), ("a", "2", 5.0), ("b", "1", 6.0)], "entry string, document string, document_value double")
    prior = spark.createDataFrame([(4.0, 0.2), (5.0, 0.5), (6.0, 0.3)], "x double, weight double")
    normal = {r.entry: tuple(r)[1:] for r in V.law_prediction(doc, prior, 0.7, 4.5, 5.5).collect()}
    before = {r.entry: tuple(r)[1:] for r in V.grid_prediction(doc, prior, 0.7, 4.5, 5.5).collect()}
    student = {r.entry: tuple(r)[1:] for r in V.law_prediction(doc, prior, 0.7, 4.5, 5.5, 3.0).collect()}
    t = lambda y, x: (1 + ((y - x) / 0.7) ** 2 / 3) ** -2
    for e, ys in (("a", (4.0, 5.0)), ("b", (6.0,))):
        w = np.array([p * math.prod(t(y, x) for y in ys) for x, p in ((4.0, 0.2), (5.0, 0.5), (6.0, 0.3))])
        assert np.allclose(student[e], w / w.sum()) and np.allclose(normal[e], before[e])
