"""Further models: flagged documents left out, moderated variances, projection, refinement, paired tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcewise.functions.expressions import normal_cdf
from sourcewise.operators.evidence import VARIANCE_FLOOR, marked, merged, moments, pooled_sd, posteriors, stored_units, systematic_pairs, units
from sourcewise.operators.neighbors import nearest_of
from sourcewise.operators.order import cut


def exclude_flagged(records: DataFrame, min_shared: int = 3, offset_threshold: float = 1.0, sign_agreement: float = 0.8) -> DataFrame:
    """Posteriors from the units that hold no document of a systematic pair.

    Entries that lose all their units keep the fit of all data; ``fallback`` marks them.
    """
    plain = stored_units(records)
    hits = marked(plain, systematic_pairs(plain, min_shared, offset_threshold, sign_agreement))
    doc = cut(merged(hits, marks=("hit",)).select("entry", "document_value", "hit"))  # three small columns, read for both fits and both moments
    clean = doc.where(~F.col("hit"))
    kept = posteriors(clean, pooled_sd(clean)).withColumn("fallback", F.lit(False))
    lost = doc.join(clean.select("entry").distinct(), "entry", "left_anti")
    return kept.unionByName(posteriors(lost, pooled_sd(doc)).withColumn("fallback", F.lit(True)))


def nelder_mead(f, start: list[float], low: list[float], high: list[float], steps: int = 120, tolerance: float = 1e-7) -> list[float]:
    """Minimiser of ``f`` in a box, by a simplex; points outside are moved to the edge."""
    clip = lambda p: np.minimum(np.maximum(p, low), high)
    simplex = [clip(np.array(start, float))] + [clip(np.array(start, float) + 0.5 * e) for e in np.eye(len(start))]
    values = [f(p) for p in simplex]
    for _ in range(steps):
        order = np.argsort(values)
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance):
            break
        centre = np.mean(simplex[:-1], axis=0)
        move = lambda k: clip(centre + k * (simplex[-1] - centre))  # noqa: B023, E731
        reflected = move(-1.0)
        value = f(reflected)
        if value < values[0]:
            far = move(-2.0)
            far_value = f(far)
            simplex[-1], values[-1] = (far, far_value) if far_value < value else (reflected, value)
        elif value < values[-2]:
            simplex[-1], values[-1] = reflected, value
        else:
            near = move(0.5)
            near_value = f(near)
            if near_value < values[-1]:
                simplex[-1], values[-1] = near, near_value
            else:
                simplex = [simplex[0]] + [clip(simplex[0] + 0.5 * (p - simplex[0])) for p in simplex[1:]]
                values = [values[0]] + [f(p) for p in simplex[1:]]
    return simplex[int(np.argmin(values))].tolist()


def fit_variance_prior(doc: DataFrame, min_entries: int = 5) -> dict[str, float]:
    """(tau, prior_df) of the moderated-t model: scaled-F likelihood of the entries' variances.

    Each evaluation is one aggregate by degrees of freedom; the gamma terms
    depend on those alone, so only a few sums come to the driver.
    """
    m = moments(doc).where("n_units >= 2").select((F.col("n_units") - 1).cast("double").alias("df"), F.greatest("variance", F.lit(VARIANCE_FLOOR)).alias("v")).cache()
    base = m.groupBy("df").agg(F.count(F.lit(1)).alias("k"), F.sum(F.log("v")).alias("log_v"), F.sum("v").alias("v")).collect()
    n = sum(r["k"] for r in base)
    if n < min_entries:
        raise ValueError(f"{min_entries} entries with two or more units are needed; found {n}")
    pooled = sum(r["v"] * r["df"] for r in base) / sum(r["df"] * r["k"] for r in base)

    def loss(p) -> float:
        tau2, d2 = math.exp(p[0]), math.exp(p[1])
        sums = {r["df"]: r["s"] for r in m.groupBy("df").agg(F.sum(F.log1p(F.col("df") * F.col("v") / (d2 * tau2))).alias("s")).collect()}
        total = 0.0
        for r in base:
            d1 = r["df"]
            gamma = math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2) + d1 / 2 * math.log(d1 / d2)
            total += r["k"] * (gamma - math.log(tau2)) + (d1 / 2 - 1) * (r["log_v"] - r["k"] * math.log(tau2)) - (d1 + d2) / 2 * sums[d1]
        return -total

    best = nelder_mead(loss, [math.log(pooled), math.log(4.0)], [math.log(1e-3), math.log(0.5)], [math.log(25.0), math.log(1e3)])
    m.unpersist()
    return {"tau": math.exp(best[0] / 2), "prior_df": math.exp(best[1]), "pooled_sd": math.sqrt(pooled), "n_entries": n}


#: Entries by size and variance in so many steps of the logarithm are one row of the likelihood's table.
HELD_STEPS = 200


def fit_predictive_variance(doc: DataFrame, min_entries: int = 5) -> dict[str, float]:
    """(tau, prior_df) of the moderated t model at the greatest leave-one-unit-out predictive likelihood.

    A held-out unit matters by its distance from the others' mean, their variance
    and their number; units are counted by the number and by both others in
    ``HELD_STEPS`` steps of a decade, with exact means in each step, so that each
    evaluation is one pass over a table whose size does not grow with the units.
    The table stays on the executors: an evaluation sums it there, and only the
    counts by number of other units, for the gamma terms, come to the driver.
    """
    from sourcewise.operators.evidence import held_out

    held = held_out(doc).select(F.pow(F.col("observed") - F.col("center"), 2).alias("d2"), "own", F.col("remaining").cast("double").alias("r"))
    step = lambda c: F.floor(F.log10(F.col(c) + 1e-12) * HELD_STEPS)
    rows = held.groupBy("r", step("d2").alias("i"), step("own").alias("j")).agg(F.count(F.lit(1)).alias("k"), F.avg("d2").alias("d2"), F.avg("own").alias("own"))
    rows = cut(rows)
    n = doc.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").count()
    if n < min_entries:
        raise ValueError(f"{min_entries} entries with two or more units are needed; found {n}")
    counts = {x["r"]: x["k"] for x in rows.groupBy("r").agg(F.sum("k").alias("k")).collect()}

    def loss(p) -> float:
        tau, prior_df = math.exp(p[0]), math.exp(p[1])
        df = F.lit(prior_df - 1) + F.col("r")
        s2 = (F.lit(prior_df * tau * tau) + (F.col("r") - 1) * F.col("own")) / df * (1 + 1 / F.col("r"))
        spread = rows.agg(F.sum(F.col("k") * (0.5 * F.log(s2) + (df + 1) / 2 * F.log1p(F.col("d2") / (df * s2))))).first()[0]
        front = 0.0
        for r, k in counts.items():
            x = prior_df + r - 1
            front += k * (math.lgamma((x + 1) / 2) - math.lgamma(x / 2) - 0.5 * math.log(math.pi * x))
        return spread - front

    best = nelder_mead(loss, [math.log(0.7), math.log(4.0)], [math.log(0.05), math.log(0.5)], [math.log(3.0), math.log(200.0)], steps=300, tolerance=1e-10)
    return {"tau": math.exp(best[0]), "prior_df": math.exp(best[1]), "n_entries": n, "n_predictions": sum(counts.values())}


def moderated(doc: DataFrame, tau: float, prior_df: float) -> DataFrame:
    """Posterior scales of the moderated-t model: each entry's variance shrunk toward tau squared."""
    fit = doc.sparkSession.range(1).select(F.lit(float(tau)).alias("tau"))
    return posteriors(doc, fit, prior_df).select("entry", "n_units", "mean", "posterior_df", "posterior_scale", "predictive_scale")


def empirical_bayes(doc: DataFrame, fit: DataFrame, floor: float = 0.01) -> DataFrame:
    """Entry means shrunk to the grand mean by a normal prior: its variance is that of the entry means beyond sigma^2 / m, floor^2 at least."""
    m = doc.groupBy("entry").agg(F.count(F.lit(1)).alias("m"), F.avg("document_value").alias("mean")).join(F.broadcast(fit.select("tau")))
    prior = m.agg(F.greatest(F.var_samp("mean") - F.avg(F.col("tau") * F.col("tau") / F.col("m")), F.lit(floor * floor)).alias("t2"), F.avg("mean").alias("mu"))
    own = F.col("m") / (F.col("tau") * F.col("tau"))
    weight = own + 1 / F.col("t2")
    return m.join(F.broadcast(prior)).select("entry", ((F.col("mean") * own + F.col("mu") / F.col("t2")) / weight).alias("posterior_mean"), F.sqrt(1 / weight).alias("posterior_scale"))


def project(points: DataFrame, k: int = 2) -> DataFrame:
    """(id, xy): principal components of (id, v) after z-scores with the population SD; constant columns become 0."""
    each = points.select("id", F.posexplode("v").alias("j", "x"))
    stats = each.groupBy("j").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    table = stats.agg(F.array_sort(F.collect_list(F.struct("j", "mu", "sd"))).alias("s"))
    scaled = F.transform("v", lambda x, j: F.when(F.get("s", j)["sd"] == 0, 0.0).otherwise((x - F.get("s", j)["mu"]) / F.get("s", j)["sd"]))
    z = points.join(F.broadcast(table)).select("id", array_to_vector(scaled).alias("z"))
    return PCA(k=k, inputCol="z", outputCol="p").fit(z).transform(z).select("id", vector_to_array("p").alias("xy"))


def placement_recall(matches: DataFrame, placed: DataFrame, reference: DataFrame, k: int = 5) -> DataFrame:
    """Per placed row: share of its k best matches (ties kept) among its k nearest reference cells (ties kept).

    ``matches``: (query_id, ref_id, rank) with competition ranks; ``placed`` and
    ``reference``: (id, row, col).  Nearest cells come from rings of blocks, as in
    ``neighbors.grid_neighbors``, so no row meets the whole reference.
    """
    near = nearest_of(placed, reference, k).select(F.col("src").alias("query_id"), F.col("dst").alias("ref_id"), F.lit(1).alias("hit"))
    best = matches.where(F.col("rank") <= k).join(placed.select(F.col("id").alias("query_id")), "query_id", "left_semi")
    return best.join(near, ["query_id", "ref_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("placement_recall"))


def signed_rank(table: DataFrame, *keys: str) -> DataFrame:
    """One-sided Wilcoxon statistic of ``d`` per key: zeros dropped, average ranks, normal score with tie correction."""
    d = table.where("d <> 0").withColumn("a", F.abs("d"))
    tied = d.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    w = Window.partitionBy(*keys).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    ranked = tied.withColumn("rank", F.coalesce(F.sum("t").over(w), F.lit(0)) + (F.col("t") + 1) / 2)
    # cubes of counts pass 64 bits from some two million rows on, so they are doubles
    t, n = F.col("t").cast("double"), F.col("n").cast("double")
    s = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("up")).alias("w"), F.sum("t").alias("n"), F.sum(t * t * t - t).alias("ties"))
    mean = n * (n + 1) / 4
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return s.select(*keys, "n", "w", ((F.col("w") - mean) / sd).alias("z"))


#: Pairs up to which the law of the signed-rank statistic is counted out.
EXACT_PAIRS = 50


def _rank_sums(most: int) -> list[tuple[int, list[float]]]:
    """(n, chances) for n up to ``most``: the chance that a sum of signed ranks 1..n is w or more, for each w."""
    ways, out = np.ones(1), []
    for n in range(1, most + 1):
        ways = np.pad(ways, (0, n)) / 2 + np.pad(ways, (n, 0)) / 2
        out.append((n, np.minimum(1.0, np.cumsum(ways[::-1])[::-1]).tolist()))
    return out


def signed_rank_test(table: DataFrame, *keys: str, alternative: str = "greater") -> DataFrame:
    """(keys, n_values, n, w, p): one-sided Wilcoxon test of ``d`` per key.

    Nulls and values that are not finite are left out and zeros dropped.  Without ties and zeros
    the law of up to ``EXACT_PAIRS`` pairs is exact, else normal with tie correction.
    Only zeros, or no value, give p = 1 and a null ``w``.
    """
    if alternative not in ("greater", "less"):
        raise ValueError("alternative is greater or less")
    x = table.select(*keys, F.col("d").cast("double").alias("d")).where("d is not null and not isnan(d) and abs(d) < double('infinity')")
    every = table.select(*keys).distinct().join(x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"), F.max(F.abs("d")).alias("top")), [*keys], "left")
    ties = x.where("d <> 0").groupBy(*keys, F.abs("d").alias("a")).agg(F.count(F.lit(1)).alias("t")).groupBy(*keys).agg(F.max("t").alias("tied"))
    found = every.join(signed_rank(x, *keys).join(ties, [*keys]), [*keys], "left")
    law = table.sparkSession.createDataFrame(_rank_sums(EXACT_PAIRS), "n bigint, chances array<double>")
    found = found.join(F.broadcast(law), "n", "left")
    up = F.col("w") if alternative == "greater" else F.col("n") * (F.col("n") + 1) / 2 - F.col("w")
    exact = F.get("chances", up.cast("int"))
    z = F.col("z") if alternative == "greater" else -F.col("z")
    plain = (F.col("tied") == 1) & (F.col("n") == F.col("n_values")) & F.col("chances").isNotNull()
    none = F.col("n").isNull() | (F.col("top") <= 1e-8)
    p = F.when(none, 1.0).when(plain, exact).otherwise(normal_cdf(-z))
    return found.select(*keys, F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("n", F.lit(0)).alias("n"), F.when(~none, F.col("w")).alias("w"), p.alias("p"))


def pooled_sd_by_class(doc: DataFrame, overall: DataFrame, lower: float = 6.0, upper: float = 7.0, min_entries: int = 5) -> DataFrame:
    """(class, sigma, n_entries, method): pooled between-unit SD by the class of the entry's mean (medium from ``lower``, active from ``upper``).

    A class with fewer entries of two units takes the one row ``overall`` (tau); classes without any are kept.
    """
    m = doc.groupBy("entry").agg(F.count(F.lit(1)).alias("m"), F.avg("document_value").alias("mean"), F.var_samp("document_value").alias("variance")).where("m > 1")
    kind = F.when(F.col("mean") < lower, "inactive").when(F.col("mean") < upper, "medium").otherwise("active")
    sums = m.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("variance") * (F.col("m") - 1)).alias("ss"), F.sum(F.col("m") - 1).alias("df"))
    classes = overall.select("tau", F.explode(F.array(*(F.lit(c) for c in ("inactive", "medium", "active")))).alias("class"))
    n = F.coalesce("n", F.lit(0))
    return classes.join(sums, "class", "left").select(
        "class", F.when(n >= min_entries, F.sqrt(F.col("ss") / F.col("df"))).otherwise(F.col("tau")).alias("sigma"), n.alias("n_entries"),
        F.when(n >= min_entries, "class_pooled").otherwise("overall_fallback").alias("method"),
    )


def bootstrap_median(table: DataFrame, key: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """Percentile interval of the median of ``x`` per key; each key is one group, so keys bound its size."""

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(rows["x"].to_numpy(float))
        draw = np.random.default_rng(seed).integers(0, len(x), (replicates, len(x)))
        low, high = np.quantile(np.median(x[draw], axis=1), [0.025, 0.975])
        return pd.DataFrame({key: [rows[key].iloc[0]], "median": [float(np.median(x))], "low": [low], "high": [high]})

    return table.select(key, "x").groupBy(key).applyInPandas(go, f"{key} {dict(table.dtypes)[key]}, median double, low double, high double")
