"""Audits: recompute saved results, look up sources, list bounds, select entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcewise.functions.expressions import flipped
from sourcewise.operators.curate import annotate


def verify(records: DataFrame, saved: DataFrame, lower: float, upper: float, wide: float = 1.0, tolerance: float = 1e-10) -> DataFrame:
    """Entries whose saved annotation differs from a recomputation; empty if all agree."""
    fresh = annotate(records, lower, upper, wide)
    a, b = saved.alias("a"), fresh.alias("b")
    wrong = F.lit(False)
    for name, kind in fresh.dtypes:
        if name != "entry":
            x, y = F.col(f"a.{name}"), F.col(f"b.{name}")
            same = x.eqNullSafe(y) | (F.abs(x - y) <= tolerance) if kind == "double" else x.eqNullSafe(y)
            wrong = wrong | ~F.coalesce(same, F.lit(False))
    return a.join(b, F.col("a.entry") == F.col("b.entry"), "full").where(wrong | F.col("a.entry").isNull() | F.col("b.entry").isNull()).select(F.coalesce("a.entry", "b.entry").alias("entry"))


def source_lookup(records: DataFrame, lookup: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Lookup rows (entry, document, value) of known entries, marked where a retained value lies within the tolerance."""
    values = records.groupBy("entry").agg(F.collect_list("value").alias("values"))
    joined = lookup.join(values, "entry")
    return joined.select("entry", "document", "value", F.exists("values", lambda v: F.abs(v - F.col("value")) <= tolerance + 1e-12).alias("same_value"))


def bounds(excluded: DataFrame, entry, limit: int = 20) -> DataFrame:
    """The first records of an entry that were excluded for their relation alone, as bounds of the logarithm."""
    only = excluded.where((F.col("entry") == entry) & (F.col("reasons") == F.array(F.lit("non_exact_relation"))))
    return only.select("source_row", flipped(F.col("relation")).alias("relation"), "value").orderBy("source_row").limit(limit)


def coverage(sources: DataFrame) -> DataFrame:
    """Entries by the kind of their best source link: (entry, kind) with kinds doi, pmid, url, text."""
    best = sources.groupBy("entry").agg(
        F.max(F.when(F.col("kind") == "doi", 3).when(F.col("kind") == "pmid", 2).when(F.col("kind") == "url", 1).otherwise(0)).alias("level")
    )
    return best.groupBy(F.element_at(F.array(F.lit("none"), F.lit("url"), F.lit("pmid"), F.lit("doi")), F.col("level") + 1).alias("kind")).agg(F.count(F.lit(1)).alias("n_entries"))


def inverted(records: DataFrame) -> DataFrame:
    """document -> sorted entries."""
    return records.groupBy("document").agg(F.array_sort(F.collect_set("entry")).alias("entries"))


def reconcile(listed: DataFrame, by_identity: DataFrame) -> DataFrame:
    """Rows in one of two record sets only; both are bags of the same columns."""
    return listed.exceptAll(by_identity).withColumn("only_in", F.lit("listed")).unionByName(by_identity.exceptAll(listed).withColumn("only_in", F.lit("identity")))
