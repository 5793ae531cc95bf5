"""Evaluation statistics: scores, calibration, ranks, intervals, meta-analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcewise.operators.order import Ordered, average_ranks


def probability_scores(frame: DataFrame, *keys: str) -> DataFrame:
    """accuracy, Brier score and log loss (clipped at 1e-6) of (p, y) with y in 0, 1."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))
    hit = F.when((F.col("p") >= 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0)
    # summed as decimals, so the mean is the same in any order of rows
    miss = ((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).cast("decimal(28,18)")
    return frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit).alias("accuracy"),
        (F.sum(miss) / F.count(miss)).cast("double").alias("brier"),
        F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("log_loss"),
    )


def calibration_bins(frame: DataFrame, bins: int = 5) -> DataFrame:
    """Equal-width bins of p with mean p and mean y; empty bins are kept."""
    spark = frame.sparkSession
    got = frame.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "mean_y")


def calibration_error(frame: DataFrame, bins: int = 10) -> DataFrame:
    """One row: expected calibration error over equal-width bins."""
    part = frame.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.sum(F.col("y") - F.col("p")).alias("gap"), F.count(F.lit(1)).alias("n"))
    return part.agg((F.sum(F.abs("gap")) / F.sum("n")).alias("ece"))


def spearman(table: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rank correlation of two columns, ties sharing their mean rank; rows without either don't count."""
    both = table.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return average_ranks(average_ranks(both, a, "_a"), b, "_b").agg(F.corr("_a", "_b").alias("rho"))


def auc(frame: DataFrame, *keys: str) -> DataFrame:
    """Rank AUC of (p, y) within ``keys``.

    Counts per distinct p come first, so the ranking window runs over distinct
    scores, not rows.
    """
    per = frame.groupBy(*keys, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = per.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2))
    return wins.groupBy(*keys).agg((F.sum("wins") / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    centre = (k / n + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt((k / n) * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half


def holm(table: DataFrame) -> DataFrame:
    """(name, p) with Holm-adjusted p: running maximum of (m - rank + 1) p, at most 1."""
    ranked = Ordered(table, "p", "name").numbered("r")
    m = table.count()
    step = F.least(F.lit(1.0), (F.lit(m) - F.col("r")) * F.col("p"))
    return ranked.running(adjusted=("max", step)).frame.select("name", "p", "adjusted")


def dersimonian_laird(effects: DataFrame, z: float = 1.96) -> DataFrame:
    """One row from (y, v): k, tau2, pooled mean, its variance, I2, Q, and the intervals of the mean and of a new effect.

    Variances are 1e-12 at least; with one effect tau2 is 0.
    """
    v = F.greatest(F.col("v"), F.lit(1e-12))
    w = 1 / v
    s = effects.agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * F.col("y")).alias("wy"), F.sum(w * F.col("y") * F.col("y")).alias("wyy"))
    q = F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w")
    tau2 = F.when(F.col("k") > 1, F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / (F.col("w") - F.col("w2") / F.col("w")))).otherwise(0.0)
    s = s.select("k", q.alias("q"), tau2.alias("tau2"))
    random = 1 / (v + F.col("tau2"))
    both = effects.join(F.broadcast(s)).groupBy("k", "q", "tau2").agg((F.sum(random * F.col("y")) / F.sum(random)).alias("pooled"), (1 / F.sum(random)).alias("variance"))
    both = both.withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.col("q"))).otherwise(0.0))
    own, new = z * F.sqrt("variance"), z * F.sqrt(F.col("tau2") + F.col("variance"))
    return both.withColumns({"ci_low": F.col("pooled") - own, "ci_high": F.col("pooled") + own, "prediction_low": F.col("pooled") - new, "prediction_high": F.col("pooled") + new})


def mantel_haenszel(strata: DataFrame) -> DataFrame:
    """One row from (a, n1, c, n0): the pooled risk difference and its standard error, which holds for few large and for many small strata."""
    a, n1, c, n0 = (F.col(x).cast("double") for x in ("a", "n1", "c", "n0"))
    n = n1 + n0
    by_size = (n1 * n1 * c - n0 * n0 * a + n1 * n0 * (n0 - n1) / 2) / (n * n)
    mixed = (a * (n0 - c) + c * (n1 - a)) / (2 * n)
    sums = strata.agg(F.sum((a * n0 - c * n1) / n).alias("d"), F.sum(n1 * n0 / n).alias("w"), F.sum(by_size).alias("p"), F.sum(mixed).alias("q"))
    rd = F.col("d") / F.col("w")
    return sums.select(rd.alias("risk_difference"), F.sqrt(F.greatest(F.lit(0.0), (rd * F.col("p") + F.col("q")) / (F.col("w") * F.col("w")))).alias("standard_error"))


def islands(table: DataFrame, key: str, value: str, gap: float) -> DataFrame:
    """Values of a key chained while neighbours are within ``gap``: mean and size of each chain."""
    w = Window.partitionBy(key).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) <= gap + 1e-12, 0).otherwise(1)
    chained = table.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy(key, "island").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def inverse_variance(units: DataFrame, key: str) -> DataFrame:
    """Weighted mean and its variance per key from (y, v)."""
    return units.groupBy(key).agg((F.sum(F.col("y") / F.col("v")) / F.sum(1 / F.col("v"))).alias("mean"), (1 / F.sum(1 / F.col("v"))).alias("variance"))
