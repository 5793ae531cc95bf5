"""New rows against a finished reference: checks, neighbour evidence, group assignment, recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check(queries: DataFrame, reference: DataFrame) -> DataFrame:
    """Status of each (position, query_id, structure): invalid, duplicate_query, in_reference or mapped, in that order.

    A duplicate points to the first query of its structure, a reference hit to
    the first reference row.
    """
    first = F.first("query_id", ignorenulls=False).over(Window.partitionBy("structure").orderBy("position"))
    known = reference.groupBy("structure").agg(F.min_by("ref_id", "position").alias("reference_id"))
    q = queries.withColumn("first_id", F.when(F.col("structure").isNotNull(), first)).join(known, "structure", "left")
    status = (
        F.when(F.col("structure").isNull(), "invalid")
        .when(F.col("first_id") != F.col("query_id"), "duplicate_query")
        .when(F.col("reference_id").isNotNull(), "in_reference")
        .otherwise("mapped")
    )
    return q.select("query_id", status.alias("status"), F.when(status == "duplicate_query", F.col("first_id")).alias("duplicate_of"), F.when(status != "invalid", F.col("reference_id")).alias("reference_id"))


def evidence(queries: DataFrame, neighbors: DataFrame, similarity: float) -> DataFrame:
    """Category of the near supported neighbours of each query: none, insufficient, one class, or mixed.

    ``neighbors``: (query_id, similarity, activity_class, class_status); a query
    needs one supported neighbour at ``similarity`` or more.
    """
    near = neighbors.where(F.col("similarity") >= similarity)
    got = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_near"), F.collect_set(F.when(F.col("class_status") == "supported", F.col("activity_class"))).alias("classes"))
    category = F.when(F.coalesce("n_near", F.lit(0)) == 0, "none").when(F.size("classes") == 0, "insufficient").when(F.size("classes") == 1, F.get("classes", F.lit(0))).otherwise("mixed")
    return queries.select("query_id").join(got, "query_id", "left").select("query_id", F.coalesce("n_near", F.lit(0)).alias("n_near"), category.alias("neighbor_evidence"))


def compare(table: DataFrame) -> DataFrame:
    """agrees / disagrees where both the own class and a single-class evidence exist, else null."""
    clear = F.col("neighbor_evidence").isin("active", "medium", "inactive") & F.col("own_class").isNotNull()
    return table.withColumn("comparison", F.when(clear, F.when(F.col("neighbor_evidence") == F.col("own_class"), "agrees").otherwise("disagrees")))


def nearest_group(scores: DataFrame, threshold: float) -> DataFrame:
    """The best centre of each query from (query_id, group, similarity), lowest group on ties, if good enough."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "group")
    return scores.withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", F.when(F.col("similarity") >= threshold, F.col("group")).alias("group"), "similarity")


def batch_warnings(summary: DataFrame) -> DataFrame:
    """One row from (neighbor_evidence, best_similarity): share without neighbours, median similarity, warning."""
    s = summary.agg(F.avg(F.when(F.col("neighbor_evidence") == "none", 1.0).otherwise(0.0)).alias("none_share"), F.median("best_similarity").alias("median_similarity"))
    return s.withColumn("far_from_reference", (F.col("none_share") >= 0.9) & (F.col("median_similarity") < 0.35))
