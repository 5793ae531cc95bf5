import random

import numpy as np
import pytest

from sourcewise.operators import groups, layout, neighbors, refine

F = groups.F


def loop(nodes, edges):
    """The greedy groups one after the other."""
    near = {n: {n} for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out, number = {}, 0
    while near:
        number += 1
        centre = min(near, key=lambda x: (-len(near[x]), x))
        members = set(near[centre])
        out |= {x: (number, x == centre) for x in members}
        near = {x: s - members for x, s in near.items() if x not in members}
    return out


@pytest.mark.parametrize(("n", "m", "seed"), [(60, 90, 1), (80, 60, 2), (40, 300, 3)])
def test_greedy_groups_equal_the_loop(spark, n, m, seed):
    rng = random.Random(seed)
    edges = {tuple(rng.sample(range(n), 2)) for _ in range(m)}
    both = [(a, b) for a, b in edges] + [(b, a) for a, b in edges]
    got = groups.greedy_groups(spark.range(n), spark.createDataFrame(both, "src long, dst long").repartition(3)).collect()
    assert {r.id: (r.group, r.is_centre) for r in got} == loop(range(n), edges) and len(got) == n


def test_greedy_groups_of_nothing(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert groups.greedy_groups(spark.range(0), empty).count() == 0
    assert sorted(r.group for r in groups.greedy_groups(spark.range(3), empty).collect()) == [1, 2, 3]


def energy(pos, edges, wish, sigma, anchor):
    e = sum(1 - np.exp(-((pos[a][0] - pos[b][0]) ** 2 + (pos[a][1] - pos[b][1]) ** 2) / (2 * sigma * sigma)) for a, b in edges)
    return e + anchor * sum((pos[k][0] - w[0]) ** 2 + (pos[k][1] - w[1]) ** 2 for k, w in wish.items())


def test_rounds_never_raise_the_objective(spark):
    """Cells stay unique and within the lattice, and every round lowers the sum that a plain loop computes."""
    rng = random.Random(5)
    n, side = 120, 13
    spots = rng.sample([(r, c) for r in range(side) for c in range(side)], n)
    start = dict(enumerate(spots))
    edges = {tuple(sorted((i, (i + d) % n))) for i in range(n) for d in (1, 2)} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(60)}
    df = spark.createDataFrame([(k, *p) for k, p in start.items()], "id long, row int, col int")
    links = spark.createDataFrame(sorted(edges), "src long, dst long")
    last, values = df, [energy(start, edges, start, 2.0, 0.003)]
    for k in (1, 2, 4):
        last = refine.refine(df, links, side, sigmas=(2.0,), rounds=k, tile=6)
        pos = {r.id: (r.row, r.col) for r in last.collect()}
        assert len(set(pos.values())) == n and all(0 <= r < side and 0 <= c < side for r, c in pos.values())
        values.append(energy(pos, edges, start, 2.0, 0.003))
    assert values == sorted(values, reverse=True) and values[-1] < 0.9 * values[0]
    with pytest.raises(ValueError):
        refine.refine(df.withColumn("row", F.lit(1)).withColumn("col", F.lit(1)), links, side)


def test_a_tile_ends_where_no_exchange_helps():
    rng = np.random.default_rng(7)
    side, n = 5, 18
    spots = rng.permutation(side * side)[:n]
    place = np.stack([spots // side, spots % side], 1)
    edges = {tuple(sorted((i, (i + 1) % n))) for i in range(n)} | {(0, 9), (3, 12)}
    near = [[{"id": b if a == i else a, "row": int(place[b if a == i else a][0]), "col": int(place[b if a == i else a][1])} for a, b in edges if i in (a, b)] for i in range(n)]
    rows = refine.pd.DataFrame({"id": range(n), "row": place[:, 0], "col": place[:, 1], "free": True, "wish_row": place[:, 0].astype(float), "wish_col": place[:, 1].astype(float), "near": near})
    out = refine.settle(rows, 0, 0, side, side, 2.0, 0.003)
    wish = {i: tuple(p) for i, p in enumerate(place.tolist())}
    cost = lambda pos: energy(dict(enumerate(map(tuple, pos.tolist()))), edges, wish, 2.0, 0.003)
    best = cost(out)
    assert best < cost(place) and len({tuple(p) for p in out.tolist()}) == n
    held = {tuple(p): i for i, p in enumerate(out.tolist())}
    for i in range(n):
        for r in range(side):
            for c in range(side):
                tried = out.copy()
                j = held.get((r, c))
                if j is not None:
                    tried[j] = out[i]
                tried[i] = (r, c)
                assert cost(tried) >= best - 1e-6


def test_top_matches_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(neighbors, "REFERENCE_BLOCK", 11)
    rng = random.Random(2)
    items = [f"i{k}" for k in range(30)]
    sets = lambda n, base: {base + k: rng.sample(items, rng.randint(0, 8)) for k in range(n)}
    q, r = sets(30, 0), sets(60, 100)
    q[5] = ["only here"]
    got = {}
    for x in neighbors.top_matches(spark.createDataFrame(list(q.items()), "query_id long, items array<string>"), spark.createDataFrame(list(r.items()), "ref_id long, items array<string>"), 4).collect():
        got.setdefault(x.query_id, {})[x.ref_id] = (x.similarity, x.rank)
    for k, own in q.items():
        scores = {j: len(set(own) & set(v)) / len(set(own) | set(v)) for j, v in r.items() if set(own) & set(v)}
        kth = sorted(scores.values(), reverse=True)[:4]
        want = {j: (s, 1 + sum(t > s for t in scores.values())) for j, s in scores.items() if s >= kth[-1]}
        assert got.get(k, {}) == want


def test_refined_layouts_are_layouts(spark):
    cells = spark.createDataFrame([(0, 0, 0), (1, 3, 3)], "id long, row int, col int")
    got = refine.refine(cells, spark.createDataFrame([(0, 1), (1, 9)], "src long, dst long"), 4, rounds=3)
    objective = lambda c: layout.neighbor_objective(spark.createDataFrame([(0, 1)], "src long, dst long"), c, 2.0).first().objective
    assert objective(got) < objective(cells) and got.count() == 2
