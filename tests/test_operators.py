import numpy as np
import pytest

import __spark_entry__ as entry
from sourcewise.functions.expressions import rounded_key
from sourcewise.operators import evidence, groups, insert, layout, models, neighbors, refine
from sourcewise.sources import files
from sourcewise.streaming import updates

F = evidence.F


def records(spark, text):
    rows = [(e, d, float(v)) for e, d, v in (x.split(":") for x in text.split())]
    return spark.createDataFrame(rows, "entry string, document string, value double")


def test_pair_offsets_of_a_small_table(spark):
    r = records(spark, "E1:A:4 E1:A:6 E1:B:7 E1:C:5 E2:A:6 E2:B:8 E2:C:6 E3:A:7 E3:B:9 E4:A:6 E5:D:8")
    (p,) = evidence.pair_offsets(r).collect()
    assert (p.document_a, p.document_b, p.shared_entries, p.median_offset, p.mean_offset, p.std_offset, p.sign_agreement, p.systematic_offset) == ("A", "B", 3, 2.0, 2.0, 0.0, 1.0, True)
    assert tuple(evidence.pair_totals(r).first()) == (6, 3, 1)


def test_identical_reports_merge(spark):
    r = records(spark, "E1:A:6 E1:B:6 E1:C:8")
    assert evidence.moments(evidence.units(r)).first()["mean"] == 7
    assert abs(evidence.moments(evidence.units(r, merge_identical=False)).first()["mean"] - 20 / 3) < 1e-12
    same = records(spark, " ".join(f"E{i}:{d}:{v}" for i, v in enumerate((6, 7, 6.5, 8, 5)) for d in "AB"))
    fit = evidence.pooled_sd(evidence.units(same, merge_identical=False)).first()
    assert (fit.tau, fit.method) == (0.0, "pooled_between_unit_sd")
    assert evidence.pooled_sd(evidence.units(same)).first().method == "literature_fallback"


def test_rounding_is_half_even(spark):
    got = spark.createDataFrame([(1.015,), (2.5,), (0.125,)], "v double").select(rounded_key(F.col("v")).alias("r")).collect()
    assert [r.r for r in got] == np.round([1.015, 2.5, 0.125], 2).tolist()


def test_neighbors_keep_ties(spark):
    points = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 5.0])], "id long, v array<double>")
    edges = neighbors.knn(points, 1)
    assert sorted((r.dst, r.weight) for r in edges.where("src = 0").collect()) == [(1, 0.5), (2, 0.5)]


def test_blocked_neighbors_equal_brute_force(spark, monkeypatch):
    points = spark.createDataFrame([(i, [float(i * i % 17), float(i % 5)]) for i in range(40)], "id long, v array<double>")
    whole = sorted(map(tuple, neighbors.knn(points, 3).select("src", "dst").collect()))
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 7)
    assert sorted(map(tuple, neighbors.knn(points, 3).select("src", "dst").collect())) == whole
    assert neighbors.knn(points.limit(0), 3).count() == 0 and neighbors.knn(points.limit(1), 3).count() == 0


def nearest(cells, k):
    out = set()
    for i, r, c in cells:
        near = sorted(((r - x) ** 2 + (c - y) ** 2, j) for j, x, y in cells if j != i)
        out |= {(i, j) for d, j in near if d <= near[min(k, len(near)) - 1][0]} if near else set()
    return sorted(out)


def test_grid_neighbors_of_any_layout_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    layouts = {
        "dense": [(i, i // 9, i % 9) for i in range(81)],
        "sparse": [(i, 40 * (i // 10), 40 * (i % 10)) for i in range(100)],
        "clumps": [(i, int(r), int(c)) for i, (r, c) in enumerate({(int(x), int(y)) for x, y in rng.normal(0, 3, (60, 2))} | {(int(x) + 500, int(y) - 900) for x, y in rng.normal(0, 2, (8, 2))})],
        "line": [(i, 0, i * i) for i in range(30)], "few": [(1, 0, 0), (2, 5, 5)], "one": [(1, 3, 3)],
    }
    for cells in layouts.values():
        got = neighbors.grid_neighbors(spark.createDataFrame(cells, "id long, row long, col long"), 8)
        assert sorted(map(tuple, got.select("src", "dst").collect())) == nearest(cells, 8)
    assert neighbors.grid_neighbors(spark.createDataFrame([], "id long, row long, col long"), 8).count() == 0


def test_jaccard_neighbors_keep_all_ties(spark):
    sets = [["a", "b"], ["a", "c"], ["x"], [], [], ["a", "b", "c"]]
    points = spark.createDataFrame(list(enumerate(sets)), "id long, v array<string>")
    got = {}
    for r in neighbors.knn(points, 2, "jaccard").collect():
        got.setdefault(r.src, {})[r.dst] = (r.dist, r.weight)
    for i, x in enumerate(sets):
        far = {j: 1 - (len(set(x) & set(y)) / len(set(x) | set(y)) if set(x) | set(y) else 1.0) for j, y in enumerate(sets) if j != i}
        kth = sorted(far.values())[1]
        want = {j for j, d in far.items() if d <= kth + 1e-12}
        assert set(got[i]) == want and abs(sum(w for _, w in got[i].values()) - 2) < 1e-12


def test_top_matches_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    word = lambda n: sorted({f"w{int(x)}" for x in rng.zipf(1.3, n) % 400} | {"the"})
    refs, queries = [(i, word(30)) for i in range(150)], [(i, word(25)) for i in range(30)] + [(99, ["no", "such"]), (98, [])]
    got = neighbors.top_matches(spark.createDataFrame(queries, "query_id long, items array<string>"), spark.createDataFrame(refs, "ref_id long, items array<string>")).collect()
    for q, x in queries:
        every = sorted(((len(set(x) & set(y)) / len(set(x) | set(y)), r) for r, y in refs if set(x) & set(y)), key=lambda s: -s[0])
        cut = every[min(5, len(every)) - 1][0] if every else 2
        want = {r: 1 + sum(t > s + 1e-15 for t, _ in every) for s, r in every if s >= cut - 1e-12}
        assert {r.ref_id: r["rank"] for r in got if r.query_id == q} == want


def test_sparse_assignment_is_close_to_the_exact_one(spark):
    rng = np.random.default_rng(9)
    xy = np.concatenate([rng.random((80, 2)), np.full((20, 2), 0.5)])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    cost = {}
    for method in ("dense", "sparse"):
        rows = layout.assign(points, 14, method).collect()
        assert len({(r.row, r.col) for r in rows}) == len(xy)
        cost[method] = sum((xy[r.id][0] - r.col / 13) ** 2 + (xy[r.id][1] - r.row / 13) ** 2 for r in rows)
    assert cost["dense"] <= cost["sparse"] + 1e-9 and cost["sparse"] <= 1.001 * cost["dense"]
    assert layout.choose_solver(100, 14) == "dense" and layout.choose_solver(10**6, 1500) == "sparse"
    crowded = layout.curve_cells(np.full((30, 2), 0.99), 6)
    assert len(set(crowded.tolist())) == 30


def test_refinement_lowers_the_objective_and_keeps_cells_unique(spark):
    rng = np.random.default_rng(1)
    side, n = 9, 40
    spots = rng.permutation(side * side)[:n]
    cells = spark.createDataFrame([(i, int(s) // side, int(s) % side) for i, s in enumerate(spots)], "id long, row int, col int")
    edges = spark.createDataFrame([(i, (i + d) % n) for i in range(n) for d in (1, 2)], "src long, dst long")
    done = refine.refine(cells, edges, side, anchor=0.0, rounds=4)
    assert len({(r.row, r.col) for r in done.collect()}) == n
    value = lambda c: layout.neighbor_objective(edges, c, 2.0).first()[0]
    assert value(done) < 0.8 * value(cells)


def test_placement_recall_by_hand(spark):
    placed = spark.createDataFrame([(10, 0, 0), (11, 5, 5)], "id long, row int, col int")
    reference = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 9, 9), (4, 5, 6)], "id long, row int, col int")
    matches = spark.createDataFrame([(10, 1, 1), (10, 3, 2), (11, 4, 1), (11, 3, 2), (12, 1, 1)], "query_id long, ref_id long, rank int")
    got = {r.query_id: r.placement_recall for r in models.placement_recall(matches, placed, reference, 2).collect()}
    assert got == {10: 0.5, 11: 1.0}


def test_assignment_is_optimal_and_unique(spark):
    rng = np.random.default_rng(4)
    cost = rng.integers(0, 20, (6, 7)).astype(float)
    import itertools

    best = min(sum(cost[i, p[i]] for i in range(6)) for p in itertools.permutations(range(7), 6))
    chosen = layout.hungarian(cost)
    assert len(set(chosen.tolist())) == 6 and cost[np.arange(6), chosen].sum() == best
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((30, 2)))], "id long, x double, y double")
    cells = layout.assign(points, 7).collect()
    assert len({(r.row, r.col) for r in cells}) == 30


def test_slots_follow_the_loop(spark):
    points = spark.createDataFrame([(i, (i * i % 23) / 23, (i * 7 % 11) / 11) for i in range(25)], "id long, x double, y double")
    got = sorted((r.i, r.code, r.slot) for r in layout.curve_slots(points, 40).collect())
    last = -1
    for i, code, slot in got:
        last = min(max(int(code / 2**32 * 40), last + 1), 40 - (25 - i))
        assert slot == last


def test_placement_takes_the_nearest_free_cell(spark):
    held = spark.createDataFrame([(1, 1, 1), (2, 2, 2)], "id long, row int, col int")
    wishes = spark.createDataFrame([(30, 2, 0.5), (20, 1, 0.8), (10, 1, 0.8)], "id long, ref_id long, similarity double")
    got = {r.id: (r.row, r.col) for r in layout.place(held, wishes, 3).collect()}
    assert got == {10: (0, 1), 20: (1, 0), 30: (1, 2)}


def test_neighbor_evidence_categories(spark):
    rows = [("a", 0.59, "active", "supported"), ("b", 0.8, "active", "uncertain"), ("c", 0.8, "active", "supported"), ("d", 0.8, "medium", "supported"), ("e", 0.8, "inactive", "supported"), ("f", 0.8, "active", "supported"), ("f", 0.8, "inactive", "supported")]
    n = spark.createDataFrame(rows, "query_id string, similarity double, activity_class string, class_status string")
    q = spark.createDataFrame([(x, y) for x, y in zip("abcdef", ("active", "active", "active", "inactive", "inactive", "active"), strict=True)], "query_id string, own_class string")
    got = insert.compare(insert.evidence(q, n, 0.6).join(q, "query_id")).orderBy("query_id").collect()
    assert [r.neighbor_evidence for r in got] == ["none", "insufficient", "active", "medium", "inactive", "mixed"]
    assert [r.comparison for r in got] == [None, None, "agrees", "disagrees", "agrees", None]


def test_groups_cover_every_row_once(spark):
    points = spark.createDataFrame([(1, list("abcd")), (2, list("abcde")), (3, list("abcdf")), (4, list("xyz")), (5, list("xyzw")), (6, ["q"])], "id long, v array<string>")
    got = groups.butina(points, 0.75).collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4, 5, 6]
    of = {r.id: r.group for r in got}
    assert of[1] == of[2] == of[3] and of[4] == of[5] and of[6] not in (of[1], of[4])
    pairs = {(r.src, r.dst) for r in neighbors.similar_pairs(points, 0.75).collect()}
    assert pairs == {(1, 2), (2, 1), (1, 3), (3, 1), (4, 5), (5, 4)}


def test_files_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("﻿Molecule ChEMBL ID;pChEMBL Value;Document ChEMBL ID\n001;7.5;D1\n002;x;D2\n")
    table = files.rename(files.read_delimited(spark, str(path), text_only=True))
    assert [tuple(r) for r in table.select("entry", "value", "document", "source_row").collect()] == [("001", "7.5", "D1", 0), ("002", "x", "D2", 1)]
    out = tmp_path / "out"
    files.write_checked(table, str(out), table.schema)
    with pytest.raises(ValueError):
        files.write_checked(table.drop("value"), str(tmp_path / "bad"), table.schema)
    note = tmp_path / "m.json"
    files.manifest(str(note), {"k": 1}, {}, files.digests([str(path)]))
    assert files.verify_manifest(str(note), str(tmp_path)) == []
    path.write_text("changed")
    assert files.verify_manifest(str(note), str(tmp_path)) == ["in.csv"]
    assert files.row_digest(table) == files.row_digest(table.repartition(3))
    assert files.fresh_folder(str(out)).endswith("out-2")
    files.bundle([str(path)], str(tmp_path / "z.zip"))


def test_streams_give_the_batch_result(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("cast(ts as timestamp) as ts", "user_id", "value")
    source = str(tmp_path / "events")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = updates.windowed_summary(stream, late="1000 days").writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.groupBy(F.window("ts", "1 day").start.alias("day"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    assert spark.table("days").select("day", "user_id", "n").exceptAll(want).count() == 0
    entries = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source).select(F.col("user_id").alias("entry"), "value")
    updates.recompute_touched(entries, str(tmp_path / "t"), str(tmp_path / "c2")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "t/summaries")).groupBy("entry").agg(F.max_by("median", "version").alias("m"), F.max_by("n", "version").alias("n"))
    exact = events.groupBy(F.col("user_id").alias("entry")).agg(F.median("value").alias("m"), F.count(F.lit(1)).alias("n"))
    assert got.exceptAll(exact).count() == 0 and got.count() == exact.count()
    log = spark.createDataFrame([("a", 1, 1.0, False), ("a", 2, 2.0, False), ("b", 1, 5.0, False), ("b", 2, None, True)], "key string, version int, value double, deleted boolean")
    assert [tuple(r) for r in updates.latest(log).collect()] == [("a", 2.0)]
    assert sorted(tuple(r) for r in updates.original(log).collect()) == [("a", 1.0), ("b", 5.0)]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
