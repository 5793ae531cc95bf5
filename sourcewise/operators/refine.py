"""Refinement of a lattice layout in tiles that work side by side."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcewise.operators.order import Tables, dealt

# The widths of the energy, in turn, and the weight of the wished places.
SIGMAS, ANCHOR = (3.0, 2.0, 1.5), 0.003
#: Side of a tile in cells, and rounds of a width at most.
TILE, ROUNDS = 16, 12
#: Squared distance in squared widths from which the energy is exactly 1 in doubles, points up to which their cells are broadcast, and fixed links at once.
FLAT, BROADCAST_POINTS, LINKS_TOGETHER = 75, 500_000, 4_096


def energy(d2: np.ndarray, sigma: float) -> np.ndarray:
    return 1 - np.exp(-d2 / (2 * sigma * sigma))


def settle(rows: pd.DataFrame, top: int, left: int, height: int, width: int, sigma: float, anchor: float) -> np.ndarray:
    """(row, col) of a tile's points after exchanges of two cells have been made until none helps.

    ``rows`` has the points of the tile, those that may move marked ``free``, with
    the places of all they are linked to.
    """
    near = [(i, x["id"], x["row"], x["col"]) for i, own in enumerate(rows["near"]) for x in (own if own is not None else ())]
    at = {k: i for i, k in enumerate(rows["id"].tolist())}
    links = np.array([(i, at.get(k, -1), r, c) for i, k, r, c in near], np.int64).reshape(-1, 4)
    return _settled(rows[["row", "col"]].to_numpy(np.int64), rows["free"].to_numpy(bool), rows[["wish_row", "wish_col"]].to_numpy(float), links, top, left, height, width, sigma, anchor)


def _settled(place: np.ndarray, free: np.ndarray, wish: np.ndarray, links: np.ndarray, top: int, left: int, height: int, width: int, sigma: float, anchor: float) -> np.ndarray:
    """``settle`` of arrays; ``links``: (point, linked point or -1 if it is in no cell of the tile, row, col), both ways between points of the tile.

    A table holds what each free point would cost at each cell; an exchange of cells
    (one may be empty) changes two of its entries, and the links of the moved points.
    In a pass the exchanges of most gain are made that change none of each other's entries.
    """
    movers = np.flatnonzero(free)
    if not len(movers):
        return place
    cells = np.array([(r, c) for r in range(top, top + height) for c in range(left, left + width)])
    at = (place[:, 0] - top) * width + place[:, 1] - left
    usable = np.ones(len(cells), bool)
    usable[at[~free]] = False
    spots = np.flatnonzero(usable)
    spot_of = np.full(len(cells), -1)
    spot_of[spots] = np.arange(len(spots))
    xy = cells[spots].astype(float)
    far = energy(((xy[:, None] - xy[None]) ** 2).sum(2), sigma)  # between usable cells
    cost = anchor * ((xy[None] - wish[movers][:, None]) ** 2).sum(2)
    number = np.full(len(place), -1)
    number[movers] = np.arange(len(movers))
    links = links[number[links[:, 0]] >= 0]
    own, other = number[links[:, 0]], np.where(links[:, 1] >= 0, number[links[:, 1]], -1)
    linked = np.zeros((len(movers), len(movers)))
    np.add.at(linked, (own[other >= 0], other[other >= 0]), 1)
    fixed = np.flatnonzero(other < 0)
    fixed = fixed[np.argsort(own[fixed], kind="stable")]
    for k in range(0, len(fixed), LINKS_TOGETHER):
        part = fixed[k : k + LINKS_TOGETHER]
        who, first = np.unique(own[part], return_index=True)
        cost[who] += np.add.reduceat(energy(((xy[None] - links[part, 2:].astype(float)[:, None]) ** 2).sum(2), sigma), first, axis=0)
    spot = spot_of[at[movers]]
    cost += linked @ far[spot]
    touches = [np.flatnonzero(x) for x in linked]
    empty = np.setdiff1d(np.arange(len(spots)), spot)
    each = np.arange(len(movers))
    while True:
        now = cost[each, spot]
        swap = cost[:, spot] - now[:, None]
        swap = swap + swap.T + 2 * linked * far[np.ix_(spot, spot)]  # a swapped pair keeps its own distance
        partner = swap.argmin(1)
        gain, to_empty = swap[each, partner], np.zeros(len(movers), bool)
        if len(empty):
            move = cost[:, empty] - now[:, None]
            room = move.argmin(1)
            to_empty = move[each, room] < gain
            gain = np.minimum(gain, move[each, room])
        some = np.flatnonzero(gain < -1e-9)
        if not len(some):
            break
        touched, filled = np.zeros(len(movers), bool), np.zeros(len(empty), bool)
        changed: list[tuple[int, int, int]] = []
        for i in some[np.argsort(gain[some], kind="stable")].tolist():
            if touched[i]:
                continue
            if to_empty[i]:
                if filled[room[i]]:
                    continue
                filled[room[i]] = True
                moved = [(i, spot[i], empty[room[i]])]
                empty[room[i]] = spot[i]
            else:
                j = int(partner[i])
                if touched[j]:
                    continue
                moved = [(i, spot[i], spot[j]), (j, spot[j], spot[i])]
            for p, _, new in moved:
                spot[p], touched[p], touched[touches[p]] = new, True, True
            changed += moved
        for p, old, new in changed:
            cost[touches[p]] += linked[touches[p], p][:, None] * (far[new] - far[old])
    place = place.copy()
    place[movers] = cells[spots[spot]]
    return place


def refine(
    cells: DataFrame, edges: DataFrame, side: int, sigmas=SIGMAS, anchor: float = ANCHOR, rounds: int = ROUNDS, tile: int = TILE, seed: int = 0, wishes: DataFrame | None = None,
) -> DataFrame:
    """(id, row, col) after exchanges of cells that lower, for each sigma in turn, the sum over undirected edges of
    1 - exp(-d2 / 2 sigma^2), plus ``anchor`` times the squared distances to the wished places.

    ``wishes``: (id, row, col) as numbers, the cells themselves by default.  The
    lattice is cut into tiles, at other places each round.  A point may move if its
    draw of the round is above those of all it is linked to in other tiles, so no
    link has two ends that move in different tiles: the gains of the tiles add up,
    and the objective never rises.  In every fourth round points with more links come
    first, as one with many would hardly ever win a draw.  A link between tiles so far apart
    that its energy is 1 wherever its ends move in them counts for neither: so a point
    takes the links of the tiles around it along, however many it has.  A tile is one group of
    ``tile`` x ``tile`` cells at most.  A sigma ends when no point has moved in four rounds.
    """
    if anchor < 0 or tile < 2 or not sigmas or min(sigmas) <= 0:
        raise ValueError("anchor from 0, tiles from 2 cells, sigmas above 0")
    ints = [F.col(c).cast("int").alias(c) for c in ("row", "col")]
    now = cells.select("id", *ints)
    shared = now.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not shared.isEmpty():
        raise ValueError("two points share a cell")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    known = now.select(F.col("id").alias("src"))
    both = both.join(known, "src", "left_semi").join(known.withColumnRenamed("src", "dst"), "dst", "left_semi")
    tables = Tables(now.sparkSession)
    both = tables.put(both.select("src", "dst"))
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("links"))
    wished = cells if wishes is None else wishes
    wished = wished.select(F.col("id").alias("wish_id"), F.col("row").cast("double").alias("wish_row"), F.col("col").cast("double").alias("wish_col"))
    now = now.join(degree, F.col("id") == F.col("src"), "left").drop("src").join(wished, F.col("id") == F.col("wish_id"), "left").drop("wish_id")
    now = tables.put(now.withColumn("links", F.coalesce("links", F.lit(0).cast("bigint"))))
    n = now.count()
    near = F.broadcast if n <= BROADCAST_POINTS else lambda t: t
    groups = min(math.ceil(side / tile) ** 2, 4 * math.ceil(n / tile**2))
    for level, sigma in enumerate(sigmas):
        still = 0
        for k in range(rounds):
            now = tables.put(_round(now.drop("moved"), both, near, groups, side, sigma, anchor, tile, (k * (tile // 2 + 1) % tile, k * (tile // 3 + 1) % tile), f"{seed}:{level}:{k}", k % 4 == 3), now)
            still = still + 1 if now.where("moved").isEmpty() else 0
            if still == 4:
                break
    return now.select("id", "row", "col")


def _round(now: DataFrame, both: DataFrame, near, groups: int, side: int, sigma: float, anchor: float, tile: int, shift: tuple[int, int], draw: str, by_links: bool) -> DataFrame:
    spot = [F.floor((F.col(c) + s) / tile).cast("int").alias(n) for c, s, n in (("row", shift[0], "tr"), ("col", shift[1], "tc"))]
    rank = F.struct((F.col("links") if by_links else F.lit(0).cast("bigint")).alias("n"), F.xxhash64("id", F.lit(draw)).alias("h"), F.col("id").alias("own"))
    placed = now.select("*", *spot)
    a = placed.select(F.col("id").alias("src"), F.col("tr"), F.col("tc"), rank.alias("a_rank"))
    b = placed.select(F.col("id").alias("dst"), "row", "col", F.col("tr").alias("r"), F.col("tc").alias("c"), rank.alias("b_rank"))
    apart = lambda x, y: F.greatest(F.lit(0), (F.abs(F.col(x) - F.col(y)) - 1) * tile + 1).cast("double")
    ends = both.join(near(b), "dst").join(near(a), "src").where(apart("tr", "r") * apart("tr", "r") + apart("tc", "c") * apart("tc", "c") <= FLAT * sigma * sigma)
    above = ((F.col("tr") == F.col("r")) & (F.col("tc") == F.col("c"))) | (F.col("a_rank") > F.col("b_rank"))
    links = ends.select("tr", "tc", F.col("src").alias("id"), "dst", "row", "col", above.alias("above"))
    rows = placed.select("tr", "tc", "id", F.lit(None).cast("bigint").alias("dst"), "row", "col", F.lit(True).alias("above"), "links", "wish_row", "wish_col")
    rows = rows.unionByName(links, allowMissingColumns=True)

    def work(part: pa.Table) -> pa.Table:
        top, left = part["tr"][0].as_py() * tile - shift[0], part["tc"][0].as_py() * tile - shift[1]
        high, wide = min(top + tile, side), min(left + tile, side)
        top, left = max(top, 0), max(left, 0)
        own = part.filter(pc.is_null(part["dst"])).sort_by("id")
        held = part.filter(pc.is_valid(part["dst"])).sort_by([("id", "ascending"), ("dst", "ascending")])
        ids, dst = own["id"].to_numpy(), held["dst"].to_numpy()
        src, at = np.searchsorted(ids, held["id"].to_numpy()), np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
        free = np.ones(len(ids), bool)
        free[src[~held["above"].to_numpy(zero_copy_only=False)]] = False
        links = np.stack([src, np.where(ids[at] == dst, at, -1), held["row"].to_numpy(), held["col"].to_numpy()], 1).astype(np.int64)
        before = np.stack([own["row"].to_numpy(), own["col"].to_numpy()], 1).astype(np.int64)
        wish = np.stack([own["wish_row"].to_numpy(), own["wish_col"].to_numpy()], 1)
        place = _settled(before, free, wish, links, top, left, high - top, wide - left, sigma, anchor)
        placed = {"id": ids, "row": place[:, 0].astype(np.int32), "col": place[:, 1].astype(np.int32), "links": own["links"], "wish_row": own["wish_row"], "wish_col": own["wish_col"]}
        return pa.table({**placed, "moved": (place != before).any(1)})

    kinds = "id bigint, row int, col int, links bigint, wish_row double, wish_col double, moved boolean"
    return dealt(rows, groups, "tr", "tc").groupBy("tr", "tc").applyInArrow(work, kinds)
