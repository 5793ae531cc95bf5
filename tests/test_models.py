import math

import numpy as np

from sourcewise.operators import models, refine

F = models.F


def test_variance_prior_is_recovered(spark):
    rng = np.random.default_rng(1)
    rows = []
    for e in range(400):
        sd = math.sqrt(0.25 * 8 / rng.chisquare(8))
        rows += [(f"e{e}", f"d{k}", float(rng.normal(0, sd))) for k in range(4)]
    doc = spark.createDataFrame(rows, "entry string, document string, document_value double")
    fit = models.fit_variance_prior(doc)
    assert 0.42 < fit["tau"] < 0.58 and 4 < fit["prior_df"] < 20
    got = models.moderated(doc, fit["tau"], fit["prior_df"]).first()
    assert got.posterior_df == fit["prior_df"] + 3


def test_projection_equals_svd_up_to_sign(spark):
    x = np.random.default_rng(2).normal(size=(40, 5)) * [1, 5, 2, 1, 0]
    got = models.project(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")).orderBy("id").collect()
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs([r.xy for r in got]), np.abs(u[:, :2] * s[:2]), atol=1e-8)


def test_refinement_lowers_the_objective_and_keeps_cells_unique(spark):
    rng = np.random.default_rng(3)
    order = rng.permutation(36)
    cells = spark.createDataFrame([(i, int(p // 6), int(p % 6)) for i, p in enumerate(order)], "id long, row int, col int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(35)], "src long, dst long")
    from sourcewise.operators.layout import neighbor_objective

    better = refine.refine(cells, edges, 6).cache()
    assert len({(r.row, r.col) for r in better.collect()}) == 36
    assert neighbor_objective(edges, better, 2.0).first().objective < neighbor_objective(edges, cells, 2.0).first().objective


def test_bootstrap_interval_holds_the_median(spark):
    rows = [("a", float(i)) for i in range(101)] + [("b", 5.0)]
    got = {r.k: r for r in models.bootstrap_median(spark.createDataFrame(rows, "k string, x double"), "k").collect()}
    assert got["a"].low < got["a"].median == 50.0 < got["a"].high and got["b"].low == got["b"].high == 5.0


def test_signed_rank_of_millions_of_rows_does_not_overflow(spark):
    n = 3_000_000
    d = spark.range(n).select(F.lit(1).alias("k"), F.when(F.col("id") % 3 == 0, -1.0).otherwise(1.0).alias("d"))
    r = models.signed_rank(d, "k").first()
    sd = (n * (n + 1) * (2 * n + 1) / 24 - (n**3 - n) / 48) ** 0.5
    w = (n + 1) / 2 * (n - n // 3)
    assert (r.n, r.w) == (n, w) and abs(r.z / ((w - n * (n + 1) / 4) / sd) - 1) < 1e-9
