"""Causes of pairs by hand, medians without a unit against a loop, odd rows."""

import math
import random
import statistics

from sourcewise.operators import audit as A
from sourcewise.operators import evaluation, models, stats

SCHEMA = "target string, entry string, parent string, document string, value double, relation string, kind string, flagged boolean, source string"


def rows_of(target, document, values, kind="B", flagged=False, source="1", relation="="):
    return [(target, f"e{i}", f"e{i}", document, v, relation, kind, flagged, source) for i, v in enumerate(values)]


def causes(spark, rows, **options):
    return {(r.target, r.document_a, r.document_b): r for r in A.offset_causes(spark.createDataFrame(rows, SCHEMA), **options).collect()}


BASE = [5.0, 5.5, 6.1, 6.6, 7.2]
WIDE = [x + 1 + 0.5 * i for i, x in enumerate(BASE)]


def test_each_cause_is_found_in_its_order(spark):
    rows = rows_of("T", "a", BASE) + rows_of("T", "b", [x + 3 for x in BASE]) + rows_of("T", "c", [x + 1.5 for x in BASE])
    rows += rows_of("T", "x", WIDE, kind="F", flagged=True, source="2")
    got = causes(spark, rows)
    assert got["T", "a", "b"].cause == "S2" and got["T", "a", "c"].cause == "S3" and got["T", "b", "c"].cause == "S3"
    assert got["T", "a", "x"].cause == "S4" and got["T", "a", "x"].evidence == "5/5 shared entries of different kinds"
    assert abs(got["T", "a", "x"].median_offset - 2.0) < 1e-9 and abs(got["T", "a", "x"].quartile_range - 1.0) < 1e-9
    rest = {"S5": dict(flagged=True, source="2"), "S6": dict(source="2"), "S0": {}}
    for cause, options in rest.items():
        (one,) = causes(spark, rows_of("T", "a", BASE) + rows_of("T", "x", WIDE, **options)).values()
        assert one.cause == cause and one.cause_label == A.CAUSES[cause]


def test_swapped_targets_come_first_and_need_three_exact_parents(spark):
    high = [x + 3 for x in BASE]
    rows = rows_of("T", "a", BASE) + rows_of("U", "a", high) + rows_of("T", "b", high) + rows_of("U", "b", BASE)
    got = causes(spark, rows)
    assert {k: r.cause for k, r in got.items()} == {("T", "a", "b"): "S1", ("U", "a", "b"): "S1"}
    assert got["T", "a", "b"].evidence == "U: 5/5 (100.0%) swapped both ways"
    bounds = [(*r[:5], ">" if r[1] in ("e0", "e1", "e2") and r[3] == "b" else "=", *r[6:]) for r in rows]
    assert {r.cause for r in causes(spark, bounds).values()} == {"S2"}


def test_nulls_ties_and_empty_tables(spark):
    odd = [("T", None, "e0", "b", 9.0, "=", "B", None, None), (None, "e0", "e0", "b", 9.0, "=", None, None, None), ("T", "e0", "e0", "b", float("nan"), "=", "B", None, None)]
    rows = rows_of("T", "a", BASE, kind=None, source=None) + rows_of("T", None, [x + 1.5 for x in BASE], kind=None, flagged=None, source=None)
    (one,) = causes(spark, rows + odd + rows).values()
    assert one.document_b == "unknown_document" and one.cause == "S3" and one.flagged_records == 0 and one.source_a == ""
    assert causes(spark, []) == {}


def test_flags_come_from_training_entries_only(spark):
    rows = [(f"e{i}", d, v) for i in range(6) for d, v in (("a", 1.0), ("b", 1.0 if i < 4 else 4.0))]
    diffs = A.differences(spark.createDataFrame(rows, "entry string, document string, value double"))
    training = spark.createDataFrame([(0, f"e{i}") for i in range(6)] + [(1, f"e{i}") for i in (0, 4, 5)], "fold long, entry string")
    flags = A.training_flags(diffs, training, sign_agreement=0.6)
    assert {(r.fold, r.document) for r in flags.collect()} == {(1, "a"), (1, "b")}
    doc = spark.createDataFrame([(f"e{i}", ["a"] if i else ["c"]) for i in range(6)], "entry string, documents array<string>")
    left = {(r.fold, r.entry) for r in A.clean_training(doc, training, flags).collect()}
    assert left == {(0, f"e{i}") for i in range(6)} | {(1, "e0")}


def test_median_without_a_unit_equals_a_loop(spark):
    draw = random.Random(5)
    rows = [(e, f"d{draw.randrange(5)}", float(draw.randrange(6))) for e in range(30) for _ in range(draw.randrange(1, 14))]
    owners = {e: {d for x, d, _ in rows if x == e} for e in range(30)}
    unit_rows = []
    for e, names in owners.items():
        names = sorted(names)
        cut = draw.randrange(len(names) + 1)
        unit_rows += [(e, part[0], part) for part in (names[:cut], names[cut:]) if part]
    doc = spark.createDataFrame(unit_rows, "entry long, document string, documents array<string>")
    got = {(r.entry, r.document): r.rest for r in A.median_without(spark.createDataFrame(rows, "entry long, document string, value double"), doc).collect()}
    for e, name, part in unit_rows:
        rest = [v for x, d, v in rows if x == e and d not in part]
        assert got[e, name] == (statistics.median(rest) if rest else None)


def test_signed_rank_chances_equal_enumeration(spark):
    draw = random.Random(9)
    rows = []
    for k in range(6):
        rows += [(k, (i + 1 + draw.random() / 2) * draw.choice((-1, 1))) for i in range(4 + k)]
    odd = [(10, 0.0), (10, 0.0), (11, None), (12, 1.0), (12, 1.0), (12, -2.0), (12, float("nan")), (13, float("inf"))]
    frame = spark.createDataFrame(rows + odd, "k long, d double")
    for alternative in ("greater", "less"):
        got = {r.k: r for r in models.signed_rank_test(frame, "k", alternative=alternative).collect()}
        for k in range(6):
            d = sorted((v for x, v in rows if x == k), key=abs)
            n, w = len(d), sum(i + 1 for i, v in enumerate(d) if v > 0)
            sums = [sum(i + 1 for i in range(n) if mask >> i & 1) for mask in range(1 << n)]
            hit = sum(s >= w if alternative == "greater" else s <= w for s in sums)
            assert (got[k].n, got[k].w) == (n, w) and abs(got[k].p - hit / len(sums)) < 1e-12
        assert got[10].p == got[11].p == got[13].p == 1.0 and got[10].w is None and (got[10].n_values, got[11].n_values) == (2, 0)
        assert got[12].w == 3.0 and abs(got[12].p - 0.5) < 1e-12


def test_one_effect_has_no_spread_and_small_classes_fall_back(spark):
    (one,) = stats.dersimonian_laird(spark.createDataFrame([(2.0, 0.25)], "y double, v double")).collect()
    assert (one.tau2, one.i2, one.pooled) == (0.0, 0.0, 2.0) and abs(one.ci_high - 2.98) < 1e-12 and one.prediction_high == one.ci_high
    doc = spark.createDataFrame([(e, 5.0 + x) for e in range(5) for x in (0.0, 0.2)] + [(9, 7.5), (9, 7.9), (8, 6.5)], "entry long, document_value double")
    overall = spark.createDataFrame([(0.4,)], "tau double")
    got = {r["class"]: (round(r.sigma, 9), r.n_entries, r.method) for r in models.pooled_sd_by_class(doc, overall).collect()}
    assert got == {"inactive": (round(0.02**0.5, 9), 5, "class_pooled"), "medium": (0.4, 0, "overall_fallback"), "active": (0.4, 1, "overall_fallback")}


def test_null_flags_come_as_often_as_the_law_says(spark):
    rows = [(3 * k + i, f"{k}{s}") for k in range(400) for i in range(3) for s in "ab"]
    doc = spark.createDataFrame(rows, "entry long, document string")
    run = lambda d: sorted(tuple(r) for r in evaluation.null_flags(d, 0.5, 3, 0.4, 1.0, replicates=10, seed=3).collect())
    got = run(doc)
    assert [r[0] for r in got] == list(range(1, 11)) and all(r[2] == 400 for r in got) and got == run(doc.repartition(7))
    tail = lambda x: 0.5 * math.erfc(x / (0.5 * 2**0.5) / 2**0.5)
    p, q = tail(0.4), 0.5 - tail(0.4)
    chance = 2 * (p**3 + 3 * p * p * q)
    assert abs(sum(r[1] for r in got) - 4000 * chance) < 4 * (4000 * chance * (1 - chance)) ** 0.5
    assert len({r[1] for r in got}) > 1 and evaluation.null_flags(doc, 0.5, 4, 0.4, 1.0, replicates=2).agg({"flagged": "sum"}).first()[0] == 0
