"""Connected components of a link table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcewise.llm.common import Workspace, join_uneven

ROUNDS = 60
#: Links of a node from which it may count as hot.
HOT_LINKS = 200


def components(work: Workspace, links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node in ``links`` (columns a, b); root is the least node of its component.

    Each round links every node's larger neighbours to its least neighbour
    (large star), then its smaller ones (small star).  A round's state is a
    stored table of at most one row per link, so lineage stays short and nothing
    is gathered; a node with very many neighbours is first reduced to its least
    neighbour by a partial aggregate, which is then brought to its links without
    a shuffle of them.
    """
    edges = work.put(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    for k in range(1, ROUNDS):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        least = work.put(least.where("n > 0"), f"{name}-least{k}")
        large = join_uneven(both.where("v > u"), least, "u", "n", HOT_LINKS).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = work.put(large.where("u <> v").distinct(), f"{name}-large{k}", f"{name}-least{k}")
        small = work.put(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-small{k}")
        edges_next = join_uneven(large, small, "u", "n", HOT_LINKS).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = work.put(edges_next.where("u <> v").distinct(), f"{name}-{k}", f"{name}-large{k}", f"{name}-small{k}", f"{name}-{k - 1}")
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return work.put(roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), name, f"{name}-{k - 1}")


def _settled(edges: DataFrame) -> bool:
    """Whether all links go from a node with no other link to a node that links nowhere: one star a component, its centre the least."""
    out = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    centres = edges.select(F.col("v").alias("u"), F.lit(True).alias("is_centre")).distinct()
    return out.join(centres, "u", "left").where("n > 1 or is_centre").isEmpty()
