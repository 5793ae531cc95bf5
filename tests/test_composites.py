import math

import numpy as np
import pytest

from sourcewise.functions import expressions as X
from sourcewise.operators import composite as P
from sourcewise.operators import evaluation as V
from sourcewise.operators import evidence as E
from sourcewise.operators import models, reports
from sourcewise.sources import files

F = E.F


def units(spark, rows):
    return E.units(spark.createDataFrame(rows, "entry string, document string, value double"))


def test_student_and_beta_by_known_values():
    # Tabulated quantiles.
    for t, df, p in ((2.2281388519649385, 10, 0.975), (12.706204736432095, 1, 0.975), (-1.8124611228107335, 10, 0.05), (1.959963984540054, 1e7, 0.975)):
        assert abs(float(X.student_cdf(t, df)) - p) < 1e-7
    assert abs(V.t_quantile(0.975, 24) - 2.0638985616280205) < 1e-9
    low, high = V.exact_interval(8, 10)
    assert abs(low - 0.44390453) < 1e-6 and abs(high - 0.97478927) < 1e-6
    assert V.exact_interval(0, 5)[0] == 0.0 and V.exact_interval(5, 5)[1] == 1.0


def test_predictive_prior_is_a_maximum(spark):
    rng = np.random.default_rng(0)
    rows = [(f"e{i}", f"d{j}", float(m + s * z)) for i in range(150) for m, s in [(rng.normal(6, 1), 0.5 * math.sqrt(4 / rng.chisquare(4)))] for j, z in enumerate(rng.normal(size=4))]
    doc = units(spark, rows)
    fit = models.fit_predictive_variance(doc)
    held = E.held_out(doc).toPandas()

    def loss(tau, d0):
        r = held["remaining"].to_numpy(float)
        df = d0 + r - 1
        s2 = (d0 * tau**2 + (r - 1) * held["own"].to_numpy(float)) / df * (1 + 1 / r)
        z2 = (held["observed"] - held["center"]).to_numpy(float) ** 2
        return -sum(math.lgamma((d + 1) / 2) - math.lgamma(d / 2) - 0.5 * math.log(math.pi * d * s) - (d + 1) / 2 * math.log1p(z / (d * s)) for d, s, z in zip(df, s2, z2, strict=True))

    best = loss(fit["tau"], fit["prior_df"])
    assert all(best <= loss(fit["tau"] * a, fit["prior_df"] * b) + 1e-3 for a in (0.97, 1, 1.03) for b in (0.9, 1, 1.1))
    assert fit["n_predictions"] == len(held)  # values of an entry that agree after rounding are one unit
    with pytest.raises(ValueError):
        models.fit_predictive_variance(units(spark, rows[:8]))


def test_support_refuses_wrong_options(spark):
    r = spark.createDataFrame([("a", "d", 6.0)], "entry string, document string, value double")
    for wrong in ({"level": 0.5}, {"model": "x"}, {"offset_display": "off"}, {"min_shared": 1}, {"assumed_sigma": 0.0}, {"assumed_sigma": 1.0, "fit": {"tau": 1.0}}):
        with pytest.raises(ValueError):
            E.support(r, 6.0, 7.0, **wrong)
    (row,) = E.support(r, 6.0, 7.0).collect()
    assert (row.activity_class, row.n_evidence_units, row.status_reason, row.discordant_documents) == ("inactive", 1, "low_support", "")


def test_ridge_offsets_solve_the_normal_equations(spark):
    rng = np.random.default_rng(3)
    rows = [(f"e{i}", f"d{j}", float(rng.normal(6, 1) * 0 + i % 3 + 0.4 * j + rng.normal(0, 0.1))) for i in range(12) for j in range(4)]
    doc = E.units(spark.createDataFrame(rows, "entry string, document string, value double"), merge_identical=False)
    got = {r.document: r.offset for r in V.ridge_offsets(doc, 2.0, rounds=40).collect()}
    y = np.array([v for _, _, v in rows]).reshape(12, 4)
    centred = y - y.mean(1, keepdims=True)
    a = 12 * (np.eye(4) - 0.25) + 2.0 * np.eye(4)
    want = np.linalg.solve(a, centred.sum(0))
    assert np.allclose([got[f"d{j}"] for j in range(4)], want, atol=1e-6)


def test_npmle_recovers_two_levels(spark):
    rng = np.random.default_rng(5)
    doc = units(spark, [(f"e{i}", f"d{j}", float((4 if i % 4 else 8) + rng.normal(0, 0.3))) for i in range(80) for j in range(3)])
    prior = V.npmle(doc, 0.3, step=0.1, tolerance=1e-4, rounds=40).toPandas()
    assert abs(prior["weight"].sum() - 1) < 1e-9
    assert abs(prior[prior["x"] < 6]["weight"].sum() - 0.75) < 0.02


def test_cluster_weights_repeat_and_have_mean_one(spark):
    c = spark.range(2000).withColumnRenamed("id", "k")
    a, b = (sorted(map(tuple, V.cluster_weights(c.repartition(n), "k", 5).collect())) for n in (1, 6))
    assert a == b and abs(sum(w for _, _, w in a) / 10_000 - 1) < 0.03


def test_leak_free_units_share_no_document(spark):
    doc = units(spark, [(f"e{i}", f"d{i * j % 17}", float(i + j)) for i in range(30) for j in range(1, 4)])
    fold = {r.entry: r.f for r in doc.select("entry", V.fold_of(F.col("entry"), 4).alias("f")).distinct().collect()}
    documents = {(r.entry, r.document): set(r.documents) for r in doc.collect()}
    got = {tuple(r) for r in V.training_units(doc, 4).collect()}
    for f in range(4):
        held = set().union(*(d for (e, _), d in documents.items() if fold[e] == f))
        assert {(e, d) for g, e, d in got if g == f} == {k for k, d in documents.items() if fold[k[0]] != f and not d & held}


def test_curated_export_and_its_errors(spark):
    rows = [("e1", "s1", "p1", 6.0, "d1", "T1"), ("e1", "s1", None, 7.0, "d2", "t1 "), ("e2", "s2", "p2", 5.0, "d1", "T1"), ("e3", "s2", "p2", 5.0, "d1", "T1"), ("e4", "s4", "p4", None, "d1", "T1")]
    r = spark.createDataFrame(rows, "entry string, structure string, parent string, value double, document string, target string")
    with pytest.raises(ValueError):
        P.curate_export(r, 5.5, 6.5)
    run = P.curate_export(r, 5.5, 6.5, conflicts="exclude")
    assert {x.entry: (x.n_values, x.median_value, x.documents) for x in run.entries.collect()} == {"e1": (2, 6.5, "d1;d2")}
    assert sorted(";".join(x.reasons) for x in run.excluded.collect()) == ["conflicting_identity", "conflicting_identity", "missing_or_non_numeric_value"]
    assert {x.parent for x in run.retained.collect()} == {"p1"}
    two = r.unionByName(r.withColumn("target", F.lit("T2")))
    with pytest.raises(ValueError):
        reports.single_target(two)
    assert reports.single_target(two, wanted=" t2") == "T2"


def test_insertion_chain(spark):
    words = lambda i: [f"w{i}", f"w{i + 1}", f"w{i + 2}", "the"]
    ref = spark.createDataFrame([(i, i, f"s{i}", words(i), "active" if i % 2 else "inactive", "supported") for i in range(20)], "position long, ref_id long, structure string, items array<string>, activity_class string, class_status string")
    q = spark.createDataFrame([(0, 100, "s3", words(3)), (1, 101, "new", words(5)), (2, 102, "new", words(5)), (3, 103, None, words(1)), (4, 104, "far", ["x"])], "position long, query_id long, structure string, items array<string>")
    cells = spark.createDataFrame([(i, i // 5, i % 5) for i in range(20)], "id long, row int, col int")
    out = P.insert_rows(q, ref, cells, 6, similarity=0.9)
    assert {r.query_id: r.status for r in out["checks"].collect()} == {100: "in_reference", 101: "mapped", 102: "duplicate_query", 103: "invalid", 104: "mapped"}
    assert {r.query_id: r.neighbor_evidence for r in out["evidence"].collect()} == {101: "active", 104: "none"}
    (placed,) = out["cells"].collect()
    assert placed.id == 101 and (placed.row, placed.col) not in {(i // 5, i % 5) for i in range(20)}
    assert out["warnings"].first().none_share == 0.5


def test_layout_of_few_and_given_points(spark):
    points = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], "id long, v array<double>")
    cells, metrics = P.build_layout(points)
    assert len({(r.row, r.col) for r in cells.collect()}) == 2 and metrics.first().n_points == 2
    xy = spark.createDataFrame([(i, float(i % 5), float(i // 5)) for i in range(25)], "id long, x double, y double")
    given, _ = P.build_layout(xy.select("id", F.array("x", "y").alias("v")), coordinates=xy, occupancy=1.0, refined=True)
    assert len({(r.row, r.col) for r in given.collect()}) == 25


def test_saved_tables_are_checked(spark, tmp_path):
    table = spark.createDataFrame([(1, [1, 2], 0.5), (2, [], float("nan"))], "id long, v array<int>, x double")
    files.save_tables({"a": table}, f"{tmp_path}/run")
    assert files.open_tables(spark, f"{tmp_path}/run")["a"].count() == 2
    table.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/run/a")
    with pytest.raises(ValueError):
        files.open_tables(spark, f"{tmp_path}/run")
    files.save_tables({"a": table}, f"{tmp_path}/run", "csv")
    assert (tmp_path / "run-2" / "a").exists()
    empty = tmp_path / "e.csv"
    empty.write_text("")
    with pytest.raises(ValueError):
        files.read_upload(spark, str(empty))
    assert P.saved_rules({"lower": 5.0, "upper": 6.0}, {"lower": 6.0, "upper": 7.0}) == {"lower": 5.0, "upper": 6.0}
    with pytest.raises(ValueError):
        P.saved_rules({"lower": 5.0}, {"lower": 6.0, "upper": 7.0})
