"""Small forms of what failed on larger tables in round 3."""

import itertools
import math
import random
import statistics

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sourcewise.operators import audit, evaluation, groups, layout, models, neighbors
from sourcewise.operators import evidence as E
from sourcewise.operators import pairs as P


def test_row_ids_of_many_digits_equal_their_sql(spark, tmp_path):
    rows = duckdb.sql("SELECT i AS doc_id, 't' || i % 7 AS text, 'en' AS lang, 'src1' AS source, 300 AS n_chars FROM range(99990, 100030) t(i)")
    rows.write_parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    got = entry.queries()["new_row_check"](spark, str(tmp_path)).select("query_id", "status", "duplicate_of", "reference_id")
    text = lambda table: sorted(map(str, (tuple(r) for r in table)))
    assert text(got.collect()) == text(con.execute(f"SELECT query_id, status, duplicate_of, reference_id FROM ({entry.oracle_sql()['new_row_check']})").fetchall())


def test_objective_of_labels_equals_that_of_their_edges(spark):
    draw = random.Random(2)
    cells = [(i, draw.randrange(90), draw.randrange(6), draw.choice(["a", "b", None])) for i in range(120)]
    table = spark.createDataFrame(cells, "id long, row long, col long, label string")
    edges = [(x[0], y[0]) for x, y in itertools.permutations(cells, 2) if x[3] is not None and x[3] == y[3]]
    want = layout.neighbor_objective(spark.createDataFrame(edges, "src long, dst long"), table, 3.0).first()
    got = layout.label_objective(table, 3.0).first()
    assert got.n_edges == want.n_edges and got.objective == pytest.approx(want.objective, abs=1e-9)
    assert tuple(layout.label_objective(table.limit(0), 3.0).first()) == (None, 0)


@pytest.mark.parametrize("tile, together, few", [(1_000, 4_096, 1_000), (7, 3, 0), (7, 3, 6)])
def test_medoids_by_products_equal_loops(spark, monkeypatch, tile, together, few):
    monkeypatch.setattr(groups, "FEW_PAIRS", few)
    monkeypatch.setattr(groups, "PAIRS_TOGETHER", 5)
    monkeypatch.setattr(groups, "TILE", tile)
    monkeypatch.setattr(groups, "ITEMS_TOGETHER", together)
    draw = random.Random(4)
    sets = {i: (draw.choice("xyz"), sorted(draw.sample("abcdefghij", draw.randrange(0, 7)))) for i in range(60)}
    points = spark.createDataFrame([(i, v) for i, (_, v) in sets.items()], "id long, v array<string>")
    got = {r.group: r.medoid for r in groups.medoids(points, spark.createDataFrame([(i, g) for i, (g, _) in sets.items()], "id long, group string")).collect()}
    far = lambda a, b: 1 - (len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0)
    for g in "xyz":
        own = {i: v for i, (h, v) in sets.items() if h == g}
        assert got[g] == min(own, key=lambda i: (round(sum(far(own[i], v) for j, v in own.items() if j != i), 9), i))


def test_medoids_count_common_items_without_comparing_lists():
    lists = pa.array([[1, 2, 3], [2, 3], [], [9]], pa.list_(pa.int64()))
    assert groups._distances(lists, np.array([3, 2, 0, 1]), np.array([0, 2]), np.array([0, 1, 3])).tolist() == pytest.approx(np.array([[0, 1 / 3, 1], [1, 1, 1]]))


def test_similar_pairs_with_room_equal_loops(spark):
    draw = random.Random(6)
    base = [draw.sample(range(60), 25) for _ in range(8)]
    sets = {i: sorted({*draw.sample(draw.choice(base), draw.randrange(19, 26)), *(draw.randrange(60) for _ in range(draw.randrange(3)))}) for i in range(120)}
    got = {(r.src, r.dst): r.dist for r in neighbors.similar_pairs(spark.createDataFrame(list(sets.items()), "id long, v array<int>"), 0.7).collect()}
    alike = {(a, b): len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) for a, b in itertools.permutations(sets, 2)}
    want = {k: 1 - s for k, s in alike.items() if s >= 0.7 - 1e-12}
    assert got == pytest.approx(want) and want


def test_ranks_of_tied_and_near_points_equal_loops(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 30)
    draw = np.random.default_rng(3)
    points = np.round(draw.normal(0, 1, (80, 3)), 1)
    points[40:60] = points[:20]
    points[60:70] = points[:10] + 1e-12
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 80, (200, 2)) if a != b]
    got = {(r.src, r.dst): r["rank"] for r in neighbors.ranks_of(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>"), spark.createDataFrame(sorted(set(edges)), "src long, dst long")).collect()}
    for (a, b), rank in got.items():
        d = np.sqrt(((points - points[a]) ** 2).sum(1))
        assert rank == 1 + sum((d[i] < d[b]) or (d[i] == d[b] and i < b) for i in range(80) if i != a)


def test_predictive_fit_brings_no_table_to_the_driver(spark, monkeypatch):
    draw = np.random.default_rng(1)
    rows = [(e, f"d{k}", float(v)) for e in range(60) for k, v in enumerate(draw.normal(draw.normal(0, 1), 0.3, draw.integers(1, 6)))]
    doc = spark.createDataFrame(rows, "entry long, document string, document_value double")
    monkeypatch.setattr(type(doc), "toPandas", None)
    got = models.fit_predictive_variance(doc)

    def loss(tau, prior_df):
        out = 0.0
        for e in range(60):
            own = [v for x, _, v in rows if x == e]
            for i, v in enumerate(own):
                rest = own[:i] + own[i + 1 :]
                if rest:
                    r, df = len(rest), prior_df + len(rest) - 1
                    s2 = (prior_df * tau**2 + (r - 1) * (max(statistics.variance(rest), 1e-4) if r > 1 else 0)) / df * (1 + 1 / r)
                    d2 = (v - statistics.mean(rest)) ** 2
                    out -= math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi * df * s2) - (df + 1) / 2 * math.log1p(d2 / (df * s2))
        return out

    best = loss(got["tau"], got["prior_df"])
    assert all(best <= loss(got["tau"] * a, min(200.0, got["prior_df"] * b)) + 1e-3 for a in (0.97, 1, 1.03) for b in (0.9, 1, 1.1))


def drawn_records(spark, seed, entries=25, documents=9):
    draw = random.Random(seed)
    rows = [(e, f"d{d}", round(draw.gauss(5 + d / 10, 0.2), 3)) for e in range(entries) for d in draw.sample(range(documents), draw.randrange(1, 6))]
    return spark.createDataFrame(rows, "entry long, document string, value double")


@pytest.mark.parametrize("most_entries, bucket", [(2_000_000, 1_000_000), (4, 20)])
def test_offsets_and_totals_come_from_one_sort_of_the_differences(spark, monkeypatch, most_entries, bucket):
    records = drawn_records(spark, 8)
    want, totals = sorted(map(tuple, E.pair_offsets(records, offset_threshold=0.3).collect())), tuple(E.pair_totals(records).first())
    monkeypatch.setattr(P, "MOST_ENTRIES", most_entries)
    monkeypatch.setattr(P, "BUCKET_PAIRS", bucket)
    calls = []
    bucketed = P.Pairs._bucketed
    monkeypatch.setattr(P.Pairs, "_bucketed", lambda self: calls.append(1) or bucketed(self))
    offsets, counts = E.pair_offsets_and_totals(records, offset_threshold=0.3)
    got = sorted(map(tuple, offsets.collect()))
    assert [g[:3] + g[7:] for g in got] == [w[:3] + w[7:] for w in want] and tuple(counts.first()) == totals and len(calls) == 1
    assert [x for g in got for x in g[3:7]] == pytest.approx([x for w in want for x in w[3:7]])
    calls.clear()
    fit = E.support_fit(records, offset_threshold=0.3).first()
    flagged = [w for w in want if w[7]]
    assert len(calls) == 1 and fit.discordant_document_pair_count == len(flagged) > 0 and fit.flagged_document_count == len({d for w in flagged for d in w[:2]})
    assert (fit.document_pair_possible_count, fit.observed_document_pair_count, fit.document_pair_count) == totals


def test_units_of_an_entry_are_dealt_into_parts_by_their_number(spark, monkeypatch):
    records = drawn_records(spark, 3)
    monkeypatch.setattr(E, "PART_ROWS", 5)
    n = records.count()
    assert E.units(records, merge_identical=False).rdd.getNumPartitions() >= n // 5 > spark.sparkContext.defaultParallelism


def test_causes_make_no_row_for_a_difference_of_unflagged_documents(spark, monkeypatch):
    monkeypatch.setattr(audit, "differences", None)
    draw = random.Random(5)
    far = {"d0": 0.0, "d1": 3.0, "d2": 0.0}
    rows = [("t", e, e, d, 5 + far[d] + draw.gauss(0, 0.01) + e, "=", "k" if d == "d0" else "j", False, "s") for e in range(5) for d in far]
    table = spark.createDataFrame(rows, "target string, entry long, parent long, document string, value double, relation string, kind string, flagged boolean, source string")
    got = {(r.document_a, r.document_b): (r.cause, r.shared_entries, r.other_kind, r.pair_records) for r in audit.offset_causes(table).collect()}
    assert got == {("d0", "d1"): ("S2", 5, 5, 10), ("d1", "d2"): ("S2", 5, 0, 10)}


@pytest.mark.parametrize("folds", [3, 70])
def test_training_units_join_no_rows_of_folds(spark, folds):
    draw = random.Random(7)
    units = [(e, f"u{k}", sorted(draw.sample(range(200), draw.randrange(1, 3)))) for e in range(90) for k in range(draw.randrange(1, 4))]
    out = evaluation.training_units(spark.createDataFrame([(e, u, [str(d) for d in ds]) for e, u, ds in units], "entry long, document string, documents array<string>"), folds, evaluation.F.pmod("entry", evaluation.F.lit(folds)).cast("int"))
    held = {(d, e % folds) for e, _, ds in units for d in ds}
    want = {(f, e, u) for e, u, ds in units for f in range(folds) if f != e % folds and not any((d, f) in held for d in ds)}
    assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("fold#" in line for line in plan.splitlines() if "Join" in line)


def test_sparse_assignment_of_a_crowd_in_tiles_is_near_the_exact_one(spark):
    xy = np.clip(np.random.default_rng(3).normal(0.5, 0.06, (500, 2)), 0, 1)
    xy[:40] = 0.5
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    side, cost, cells = 27, {}, {}
    for method in ("dense", "sparse"):
        cells[method] = {r.id: (r.row, r.col) for r in layout.assign(points, side, method).collect()}
        assert len(set(cells[method].values())) == len(xy) and all(0 <= c < side for place in cells[method].values() for c in place)
        cost[method] = sum((xy[i][0] - c / (side - 1)) ** 2 + (xy[i][1] - r / (side - 1)) ** 2 for i, (r, c) in cells[method].items())
    assert cost["dense"] - 1e-9 <= cost["sparse"] <= 1.02 * cost["dense"]
    assert layout.assign(points.limit(0), 40, "sparse").count() == 0


def test_cycles_of_exchanges_lead_to_the_least_cost():
    draw = np.random.default_rng(5)
    for n, m in ((1, 1), (6, 6), (5, 9), (30, 41)):
        cost = draw.integers(0, 30, (n, m)).astype(float)
        got = layout.settled(cost, draw.permutation(m)[:n])
        assert len(set(got.tolist())) == n and cost[np.arange(n), got].sum() == cost[np.arange(n), layout.hungarian(cost)].sum()


def test_parts_by_entry_keep_their_size_and_medians_sort_once(spark):
    rows = spark.range(1_000_000).select((F.col("id") % 50_000).alias("entry"), F.col("id").cast("double").alias("value"))
    assert E.by_entry(rows).rdd.getNumPartitions() == 10
    plan = E.ranked(rows, "value", "entry")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") == 1
    got = {r.entry: r.m for r in E.ranked(rows, "value", "entry").where("entry < 3").groupBy("entry").agg(F.avg("middle").alias("m")).collect()}
    assert got == {e: e + 50_000 * 9.5 for e in range(3)}


def test_only_pairs_that_may_agree_are_sorted(monkeypatch):
    draw = np.random.default_rng(6)
    lengths = draw.integers(1, 9, 400)
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    lists = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x))
    codes, values = draw.integers(20, 90, offsets[-1]).astype(np.int32), draw.normal(0, 0.5, offsets[-1]).round(1)
    table = pa.table({"a": draw.integers(0, 12, 400).astype(np.int32), "x": draw.normal(0, 0.5, 400).round(1), "codes": lists(codes), "values": lists(values)})
    every = P._bucket_statistics(table, True, False, 3, 0.0, 0.0, True).to_pylist()
    for shift in (1, 1_000_000):  # the second has too many possible pairs for a table of them
        far = table.set_column(2, "codes", lists((codes * shift).astype(np.int32)))
        sorted_ones, order = [], P._order
        monkeypatch.setattr(P, "_order", lambda a, b, d: sorted_ones.append(len(d)) or order(a, b, d))  # noqa: B023
        got = P._bucket_statistics(far, True, False, 3, 0.3, 0.8, True).to_pylist()
        monkeypatch.setattr(P, "_order", order)
        share = lambda r: (r["up"] if r["median_offset"] > 0 else r["down"] if r["median_offset"] < 0 else 0) / r["shared_entries"]
        want = [{**r, "b": r["b"] * shift} for r in every[:-1] if abs(r["median_offset"]) >= 0.3 and share(r) >= 0.8]
        assert got == [*want, every[-1]] and len(want) > 3 and sorted_ones[0] < offsets[-1] / 2


@pytest.mark.parametrize("most_entries, bucket", [(2_000_000, 1_000_000), (4, 20)])
def test_top_pairs_make_no_differences_of_the_others(spark, monkeypatch, most_entries, bucket):
    monkeypatch.setattr(P, "MOST_ENTRIES", most_entries)
    monkeypatch.setattr(P, "BUCKET_PAIRS", bucket)
    records = drawn_records(spark, 9)
    found = sorted((-r.shared_entries, r.document_a, r.document_b, round(r.median_offset, 9)) for r in E.pair_offsets(records).collect())
    monkeypatch.setattr(P.Pairs, "statistics", None)
    for k in (1, 5, 1_000):
        got = sorted((-r.shared_entries, r.document_a, r.document_b, round(r.median_offset, 9)) for r in E.top_pairs(records, k).collect())
        assert got == found[:k]
    assert E.top_pairs(records.limit(0)).count() == 0


def test_nearest_rows_are_chosen_among_few(monkeypatch):
    """Rows far beyond the kth are left out before any is sorted; ties, own ids and few rows stay right."""
    draw, sizes, cut = np.random.default_rng(5), [], np.partition
    monkeypatch.setattr(neighbors.np, "partition", lambda x, *r, **k: sizes.append(x.shape[-1]) or cut(x, *r, **k))
    for n, ids in ((3_000, np.arange(3_000)), (3_000, np.arange(3_000) // 40), (6, np.arange(6)), (1, np.arange(1))):
        v = draw.integers(0, 60, (n, 2)).astype(float)
        table = neighbors.pd.DataFrame({"id": ids, "v": list(v)})
        sizes.clear()
        got = neighbors._near(table.iloc[:50], table, 5)
        assert n < 3_000 or ids[-1] < n - 1 or max(sizes) < n // 2
        want = []
        for i in range(min(50, n)):
            far = np.sqrt(((v - v[i]) ** 2).sum(1))
            others = np.sort(far[ids != ids[i]])[:5]
            want += [(ids[i], j, d) for j, d, own in zip(ids, far, ids == ids[i], strict=True) if len(others) and not own and d <= others[-1]]
        assert sorted(map(tuple, got.to_numpy().tolist())) == sorted((float(a), float(b), float(c)) for a, b, c in want)
