"""Curation: named exclusion reasons in one pass, roll-ups to entries, conflicts and variants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcewise.functions import expressions as X
from sourcewise.operators.evidence import ranked


@dataclass
class Curation:
    """Tables of a curation run; ``flagged`` holds every record with its reasons."""

    flagged: DataFrame
    retained: DataFrame
    excluded: DataFrame
    entries: DataFrame
    conflicts: DataFrame
    reason_counts: DataFrame


def differs(c: Column, wanted: str) -> Column:
    """Text unlike ``wanted``; a null cell is unlike any text."""
    return ~c.eqNullSafe(F.lit(wanted))


def flag(records: DataFrame, unit: str = "nM", relation: str = "=", allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """``records`` with array ``reasons``: every rule that a record breaks, sorted.

    Rules of columns that the records lack are skipped.
    """
    rules = [(X.clean_double(F.col("value")).isNull(), "missing_or_non_numeric_value")]
    if "relation" in records.columns:
        rules.append((differs(X.unquote_relation(F.col("relation")), relation), "non_exact_relation"))
    if "unit" in records.columns:
        rules.append((differs(F.lower("unit"), unit.lower()), "unexpected_unit"))
    if "comment" in records.columns:
        rules.append((~F.lower(F.coalesce(F.trim("comment"), F.lit(""))).isin("", "nan", "none", "manually validated"), "data_validity_flag"))
    if "duplicate" in records.columns:
        rules.append((X.truthy(F.col("duplicate"), dict(records.dtypes)["duplicate"]), "potential_duplicate"))
    for column, values in (allowed or {}).items():
        rules.append((~F.coalesce(F.upper(F.trim(column)).isin(*[v.strip().upper() for v in values]), F.lit(False)), f"{column}_mismatch"))
    return records.withColumn("reasons", X.reasons(*rules))


def annotate(records: DataFrame, lower: float, upper: float, wide: float = 1.0) -> DataFrame:
    """Per entry: exact median, spread, class flags and repeat status of its values; one shuffle, no distinct counts."""
    v = F.col("value")
    has = {c: F.max(F.when(X.class_of(v, lower, upper) == c, 1).otherwise(0)) for c in ("inactive", "medium", "active")}
    out = ranked(records.select("entry", "value"), "value", "entry").groupBy("entry").agg(
        F.count(v).alias("n_values"),
        F.avg("middle").alias("median_value"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        (F.max(v) - F.min(v)).alias("value_range"),
        F.stddev_samp(v).alias("sd_value"),
        has["inactive"].alias("has_inactive"),
        has["active"].alias("has_active"),
        (has["inactive"] + has["medium"] + has["active"]).cast("bigint").alias("n_classes"),
    )
    return out.withColumns(
        {
            "class_boundary_crossing": F.when(F.col("n_classes") > 1, 1).otherwise(0),
            "wide_range": F.when(F.col("value_range") > wide, 1).otherwise(0),
            "repeat_status": F.when(F.col("n_values") == 1, "single").otherwise("repeated"),
            "activity_class": X.class_of(F.col("median_value"), lower, upper),
        }
    )


def conflicts(records: DataFrame, identity: str, key: str) -> DataFrame:
    """Identities with more than one distinct key, and the keys; who needs the identities alone pays for two extremes."""
    found = records.groupBy(identity).agg(F.min(key).alias("_least"), F.max(key).alias("_most"), F.size(F.collect_set(key)).cast("bigint").alias("n_keys"), X.joined_distinct(F.col(key)).alias("keys"))
    return found.where("_least <> _most").drop("_least", "_most")


def variants(records: DataFrame, identity: str, writing: str) -> DataFrame:
    """Records of each writing of an identity; the representative has most records, then is the least text."""
    counts = records.groupBy(identity, writing).agg(F.count(F.lit(1)).alias("n_records"))
    w = Window.partitionBy(identity).orderBy(F.desc("n_records"), writing)
    return counts.withColumn("is_representative", F.row_number().over(w) == 1)


def recover_parent(records: DataFrame, structure: str = "structure", parent: str = "parent") -> DataFrame:
    """Missing parents from other records of the same structure, where those agree on one parent."""
    known = records.where(F.col(parent).isNotNull()).groupBy(structure).agg(F.min(parent).alias("_least"), F.max(parent).alias("_most")).where("_least = _most")
    return records.join(known.select(structure, F.col("_least").alias("_one")), structure, "left").withColumn(parent, F.coalesce(parent, "_one")).drop("_one")


def reason_counts(flagged: DataFrame) -> DataFrame:
    """Records per reason; a record counts once for each of its reasons."""
    return flagged.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_records"))


def curate(records: DataFrame, lower: float, upper: float, identity: str | None = None, key: str | None = None, **rules) -> Curation:
    """Flag, split, drop conflicting identities, and roll up to one row per entry."""
    flagged = flag(records, **rules)
    retained, excluded = flagged.where(F.size("reasons") == 0), flagged.where(F.size("reasons") > 0)
    bad = conflicts(retained, identity, key) if identity else retained.select(F.lit(None).alias("none")).limit(0)
    if identity:
        moved = retained.join(bad.select(identity), identity, "left_semi").withColumn("reasons", F.array(F.lit("conflicting_identity")))
        retained = retained.join(bad.select(identity), identity, "left_anti")
        excluded = excluded.unionByName(moved)
    return Curation(flagged, retained, excluded, annotate(retained, lower, upper), bad, reason_counts(excluded))


def first_failing(records: DataFrame) -> DataFrame:
    """Generic records: the first failing rule in the order value, sign, unit, structure, id, relation."""
    value = X.clean_double(F.col("raw"))
    p = X.p_value(value, F.col("unit"))
    reason = F.coalesce(
        X.p_value_reason(value, F.col("unit")),
        F.when(F.col("entry").isNull(), "missing_entry_id"),
        F.when(differs(X.unquote_relation(F.col("relation")), "="), "non_exact_relation"),
    )
    return records.withColumn("p_value", p).withColumn("reason", reason)


def duplicates(table: DataFrame, structure: str) -> DataFrame:
    """One row: rows and distinct structures in groups of more than one."""
    groups = table.groupBy(structure).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"), F.count(F.lit(1)).alias("duplicate_structures"))
