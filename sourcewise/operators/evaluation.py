"""Evaluation library: folds, calibration, bounds, contrasts and resampling over the record model."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcewise.functions.expressions import incomplete_beta
from sourcewise.operators.evidence import moments, pooled_sd
from sourcewise.operators.order import cut, numbered


def fold_of(entry: Column, folds: int = 10, seed: int = 0) -> Column:
    """Fold of an entry, by its hash: even, repeatable, and the same wherever the entry stands."""
    return F.pmod(F.xxhash64(entry, F.lit(seed)), F.lit(folds)).cast("int")


def out_of_fold(doc: DataFrame, fold: Column | None = None) -> DataFrame:
    """Each unit against the mean of its entry's other units, with the SD fitted without its entry's fold.

    The sums of all folds are one small table; a fold's fit is the total less its own.
    """
    fold = fold_of(F.col("entry")) if fold is None else fold
    n = F.count(F.lit(1)).over(Window.partitionBy("entry"))
    rest = (F.sum("document_value").over(Window.partitionBy("entry")) - F.col("document_value")) / (n - 1)
    each = doc.withColumn("fold", fold).withColumn("n", n).withColumn("center", F.when(n > 1, rest)).where("n >= 2")
    spread = doc.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.var_samp("document_value").alias("v")).where("n >= 2").withColumn("fold", fold)
    own = spread.groupBy("fold").agg(F.sum(F.col("v") * (F.col("n") - 1)).alias("ss"), F.sum(F.col("n") - 1).alias("df"))
    total = own.agg(F.sum("ss").alias("all_ss"), F.sum("df").alias("all_df"))
    fits = own.join(F.broadcast(total)).select("fold", F.sqrt((F.col("all_ss") - F.col("ss")) / (F.col("all_df") - F.col("df"))).alias("tau"))
    scale = F.col("tau") * F.sqrt(1 + 1 / (F.col("n") - 1))
    return each.join(F.broadcast(fits), "fold").select("entry", "document", "fold", F.col("document_value").alias("observed"), "center", "tau", scale.alias("scale"))


#: Folds whose presence one whole number holds.
FOLD_BITS = 62


def training_units(doc: DataFrame, folds: int = 10, fold: Column | None = None) -> DataFrame:
    """(fold, entry, document): units that a fold may be trained on: of entries outside it and without a document that occurs in it.

    The folds in which a document occurs are bits of whole numbers, so a unit has no row for each fold until the last step.
    """
    fold = fold_of(F.col("entry"), folds) if fold is None else fold
    words = [f"_w{k}" for k in range(-(-folds // FOLD_BITS))]
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod({c}, {FOLD_BITS}) AS int))")
    each = doc.select("entry", "document", F.explode("documents").alias("d")).withColumn("own", fold)
    held = each.groupBy("d").agg(*(F.bit_or(F.when(F.floor(F.col("own") / FOLD_BITS) == k, bit("own")).otherwise(F.lit(0).cast("bigint"))).alias(w) for k, w in enumerate(words)))
    taken = each.select("entry", "document", "d").join(held, "d").groupBy("entry", "document").agg(*(F.bit_or(w).alias(w) for w in words))
    every = doc.select("entry", "document").withColumn("own", fold).join(taken, ["entry", "document"], "left")
    every = every.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("fold <> own")
    in_fold = F.get(F.array(*(F.coalesce(w, F.lit(0).cast("bigint")) for w in words)), F.floor(F.col("fold") / FOLD_BITS).cast("int")).bitwiseAND(bit("fold"))
    return every.where(in_fold == 0).select("fold", "entry", "document")


def consensus_errors(doc: DataFrame, least_units: int = 5) -> DataFrame:
    """Each unit's distance from the mean of the others, in entries with ``least_units`` units or more."""
    w = Window.partitionBy("entry")
    n, s = F.count(F.lit(1)).over(w), F.sum("document_value").over(w)
    return doc.withColumn("n", n).withColumn("consensus", (s - F.col("document_value")) / (n - 1)).where(F.col("n") >= least_units).select("entry", "document", "consensus", (F.col("document_value") - F.col("consensus")).alias("error"))


def distance_score(value: Column, lower: float, upper: float) -> Column:
    """Distance to the nearest bound of the own class, never negative: how far a value may move before its class changes."""
    return F.when(value <= lower, lower - value).when(value >= upper, value - upper).otherwise(F.least(value - lower, upper - value))


def bound_outcome(relation: Column, bound: Column, klass: Column, lower: float, upper: float) -> Column:
    """agree, disagree or none: what a bound of the logarithm says of a class, bounds of classes inclusive."""
    above, below = relation.isin(">", ">="), relation.isin("<", "<=")
    least_active = above & (bound >= upper)
    least_above = (relation == ">") & (bound >= lower) | (relation == ">=") & (bound > lower)
    most_inactive = below & (bound <= lower)
    most_below = (relation == "<") & (bound <= upper) | (relation == "<=") & (bound < upper)
    return (
        F.when(klass == "active", F.when(least_active, "agree").when(most_below, "disagree"))
        .when(klass == "inactive", F.when(most_inactive, "agree").when(least_above, "disagree"))
        .when(klass == "medium", F.when(least_active | most_inactive, "disagree"))
    )


def unanimous(outcomes: DataFrame, *keys: str) -> DataFrame:
    """One outcome per key: the only one named, else none."""
    kinds = outcomes.where(F.col("outcome").isin("agree", "disagree")).groupBy(*keys).agg(F.collect_set("outcome").alias("o"))
    return kinds.select(*keys, F.when(F.size("o") == 1, F.get("o", F.lit(0))).otherwise("none").alias("outcome"))


def pair_contrasts(pairs: DataFrame, chances: DataFrame) -> DataFrame:
    """One row over neighbour pairs (a, b): share of different displayed classes, the expected share by the class
    probabilities p0, p1, p2 of both ends, and the share of pairs with an uncertain end."""
    a, b = (chances.select(F.col("id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("p0", "p1", "p2", "shown", "uncertain"))) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    same = F.col("a_p0") * F.col("b_p0") + F.col("a_p1") * F.col("b_p1") + F.col("a_p2") * F.col("b_p2")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return both.agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(one(F.col("a_shown") != F.col("b_shown"))).alias("displayed"), F.avg(1 - same).alias("expected"),
        F.avg(one(F.col("a_uncertain") | F.col("b_uncertain"))).alias("hidden"),
    )


def stratified_auc(frame: DataFrame, stratum: str) -> DataFrame:
    """One row: the AUCs of the strata that have both outcomes, weighted by their pairs."""
    per = frame.groupBy(stratum, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(stratum).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = per.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2)).groupBy(stratum).agg(F.sum("wins").alias("wins"), (F.sum("pos") * F.sum("neg")).alias("pairs"))
    return wins.where("pairs > 0").agg((F.sum("wins") / F.sum("pairs")).alias("auc"), F.count(F.lit(1)).alias("strata"))


def recall_bins(frame: DataFrame, bins: int = 5) -> DataFrame:
    """Left-closed bins of ``recall``, the last closed on both sides, empty ones kept: count and mean of ``value``."""
    got = frame.groupBy(F.least(F.floor(F.col("recall") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    every = frame.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") / bins).alias("low"), ((F.col("id") + 1) / bins).alias("high"))
    return every.join(got, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def expected_error(edges: DataFrame, values: DataFrame, k: int) -> DataFrame:
    """Per src: expected absolute difference to k neighbours when ties are drawn at random: the weighted sum over k."""
    named = edges.join(values.select(F.col("id").alias("src"), F.col("value").alias("a")), "src").join(values.select(F.col("id").alias("dst"), F.col("value").alias("b")), "dst")
    return named.groupBy("src").agg((F.sum(F.col("weight") * F.abs(F.col("a") - F.col("b"))) / k).alias("expected_error"))


def preservation_curve(pairs: DataFrame) -> DataFrame:
    """(src, rank, reference_mean, layout_mean): running means of reference distances along the order of either space."""
    order = lambda c: Window.partitionBy("src").orderBy(c, "dst").rowsBetween(Window.unboundedPreceding, 0)
    rank = lambda c: F.row_number().over(Window.partitionBy("src").orderBy(c, "dst"))
    a = pairs.select("src", rank("dist").alias("rank"), F.avg("dist").over(order("dist")).alias("reference_mean"))
    b = pairs.select("src", rank("layout_dist").alias("rank"), F.avg("dist").over(order("layout_dist")).alias("layout_mean"))
    return a.join(b, ["src", "rank"])


def permuted_within(frame: DataFrame, group: str, value: str, key: str, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """``frame`` with ``shuffled``: the group's values dealt anew, by the order of a hash of the key (or of ``draw``)."""
    plain, mixed = Window.partitionBy(group).orderBy(key), Window.partitionBy(group).orderBy(F.xxhash64(key, F.lit(seed)) if draw is None else draw, key)
    own = frame.withColumn("_at", F.row_number().over(plain))
    other = frame.select(F.col(group).alias("_g"), F.col(value).alias("shuffled"), F.row_number().over(mixed).alias("_b"))
    return own.join(other, own[group].eqNullSafe(F.col("_g")) & (F.col("_at") == F.col("_b"))).drop("_at", "_g", "_b")


def fixed_subset(frame: DataFrame, key: str, size: int, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """A sample of exactly ``size`` keys, the first by hash (or by ``draw``): the smaller one is part of the larger one."""
    return frame.orderBy(F.xxhash64(key, F.lit(seed)) if draw is None else draw, key).limit(size)


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t, by bisection of its distribution function."""
    low, high = -1e6, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        tail = float(incomplete_beta(df / 2, 0.5, df / (df + middle * middle))) / 2
        if (tail if middle < 0 else 1 - tail) < p:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def t_interval(table: DataFrame, level: float = 0.95) -> DataFrame:
    """One row from differences ``d``: n, mean, and Student's interval of the mean."""
    got = table.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    n = got.first()["n"]
    half = F.lit(t_quantile((1 + level) / 2, n - 1)) * F.col("sd") / F.sqrt("n") if n > 1 else F.lit(None).cast("double")
    return got.select("n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def exact_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact binomial interval of k in n, by bisection of the beta distribution."""

    def quantile(p: float, a: float, b: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if float(incomplete_beta(a, b, middle)) < p else (low, middle)
        return (low + high) / 2

    tail = (1 - level) / 2
    return (0.0 if k == 0 else quantile(tail, k, n - k + 1)), (1.0 if k == n else quantile(1 - tail, k + 1, n - k))


def count_flips(records: DataFrame, doc: DataFrame, level: float, support) -> DataFrame:
    """Entries whose support changes when every record counts as a document: (entry, by_documents, by_records, direction).

    ``support(doc, fit)`` gives (entry, p); both sides use the documents' fit.
    """
    fit = pooled_sd(doc)
    single = records.where("value is not null").select("entry", F.monotonically_increasing_id().cast("string").alias("document"), F.col("value").cast("double").alias("document_value"))
    single = single.withColumn("n_records", F.lit(1).cast("bigint")).withColumn("documents", F.array("document"))
    a, b = support(doc, fit).withColumnRenamed("p", "by_documents"), support(single, fit).withColumnRenamed("p", "by_records")
    direction = F.when((F.col("by_documents") < level) & (F.col("by_records") >= level), "gained").when((F.col("by_documents") >= level) & (F.col("by_records") < level), "lost").otherwise("same")
    return a.join(b, "entry").withColumn("direction", direction)


def rescaled(p: Column, shown: Column, others: list[Column]) -> list[Column]:
    """Probabilities of the other classes when the shown one's is set to ``p``: the rest is shared in proportion, evenly without any."""
    mass = sum(others[1:], others[0])
    return [F.when(mass > 0, (1 - p) * o / mass).otherwise((1 - p) / len(others)) for o in others]


def recalibration(frame: DataFrame) -> tuple[float, float]:
    """(slope, intercept) of a logistic fit of y on logit p, by Newton steps over sums.

    Each step is one aggregate of six sums.
    """
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))
    table = frame.select(F.log(p / (1 - p)).alias("x"), F.col("y").cast("double").alias("y")).groupBy("x").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).cache()
    slope, intercept = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + F.exp(-(slope * F.col("x") + intercept)))
        g, w = F.col("y") - F.col("n") * q, F.col("n") * q * (1 - q)
        s = table.agg(F.sum(g * F.col("x")), F.sum(g), F.sum(w * F.col("x") * F.col("x")), F.sum(w * F.col("x")), F.sum(w)).first()
        det = s[2] * s[4] - s[3] * s[3]
        if abs(det) < 1e-12:
            break
        a, b = (s[0] * s[4] - s[1] * s[3]) / det, (s[1] * s[2] - s[0] * s[3]) / det
        slope, intercept = slope + a, intercept + b
        if abs(a) + abs(b) < 1e-10:
            break
    table.unpersist()
    return slope, intercept


def cluster_weights(clusters: DataFrame, key: str, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, key, weight): Poisson(1) weights of whole clusters, the resampling that needs no total.

    The uniform number of a cluster is a hash of key, replicate and seed, so a lost
    task draws the same weights again.
    """
    each = clusters.select(key).distinct().withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = (F.xxhash64(F.col(key), "replicate", F.lit(seed)).bitwiseAND((1 << 53) - 1)) / float(1 << 53)
    weight, total, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(12):
        total += term
        weight = weight + F.when(u >= total, 1).otherwise(0)
        term /= k + 1
    return each.select("replicate", key, weight.alias("weight")).where("weight > 0")


def cluster_bootstrap(frame: DataFrame, key: str, replicates: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """One row: mean of ``x`` with its percentile interval when whole clusters are drawn again.

    Clusters are summed first, so a replicate costs one row per cluster.
    """
    sums = frame.groupBy(key).agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    drawn = sums.join(cluster_weights(sums, key, replicates, seed), key).groupBy("replicate").agg((F.sum(F.col("s") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("m"))
    ends = drawn.agg(F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q"))
    return sums.agg((F.sum("s") / F.sum("n")).alias("mean")).join(F.broadcast(ends)).select("mean", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


#: Entries of a dataset (or datasets) whose draws are made together.
DRAWN_TOGETHER = 4096


def block_trials(trials: np.ndarray, size: int, block: int, seed: tuple[int, ...], width: int = DRAWN_TOGETHER) -> np.ndarray:
    """Of ``trials`` even draws among ``size`` cells, per replicate those that fall in one block of ``width`` cells.

    A range of blocks is halved again and again; the share of one half is a
    binomial draw seeded by the range, so every task that asks for a block of it
    sees the same split, and the blocks add up to the trials.
    """
    low, high = 0, -(-size // width)
    cells = lambda a, b: min(b * width, size) - a * width
    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng([*seed, low, high]).binomial(trials, cells(low, middle) / cells(low, high))
        trials, low, high = (left, low, middle) if block < middle else (trials - left, middle, high)
    return trials


def drawn(trials: np.ndarray, size: int, block: int, seed: tuple[int, ...], width: int = DRAWN_TOGETHER) -> np.ndarray:
    """(replicates, cells): how often each cell of a block comes up in the draws of ``block_trials``."""
    own = min(width, size - block * width)
    return np.random.default_rng([*seed, block]).multinomial(block_trials(trials, size, block, seed, width), np.full(own, 1 / own))


def two_stage_draws(frame: DataFrame, dataset: str, entry: str, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, s, n): sums and counts of ``x`` when datasets are drawn anew, and then the entries of each copy.

    A dataset drawn c times gives c times as many draws among its entries as it
    has, even and independent.  Datasets and entries are numbered by their order;
    a task draws for the entries of one block, and gives one row per replicate.
    """
    sums = numbered(frame.groupBy(dataset, entry).agg(F.sum("x").alias("s"), F.count("x").alias("n")), dataset, entry, name="_i")
    sets = numbered(sums.groupBy(dataset).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_size")), dataset, name="_set")
    n_sets = sets.count()
    each = sums.join(sets.withColumnRenamed(dataset, "_d"), F.col(dataset).eqNullSafe(F.col("_d"))).select("_set", "_size", (F.col("_i") - F.col("_first")).alias("_k"), "s", "n")

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d, block = (int(x) for x in key)
        rows, size = rows.sort_values("_k"), int(rows["_size"].iloc[0])
        copies = drawn(np.full(replicates, n_sets), n_sets, d // DRAWN_TOGETHER, (seed, 1))[:, d % DRAWN_TOGETHER]
        weights = drawn(copies * size, size, block, (seed, 2, d))
        return pd.DataFrame({"replicate": np.arange(replicates, dtype=np.int32), "s": weights @ rows["s"].to_numpy(float), "n": weights @ rows["n"].to_numpy(float)})

    blocks = each.withColumn("_block", F.floor(F.col("_k") / DRAWN_TOGETHER)).groupBy("_set", "_block")
    return blocks.applyInPandas(draw, "replicate int, s double, n double").groupBy("replicate").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def two_stage_bootstrap(frame: DataFrame, dataset: str, entry: str, replicates: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """As ``cluster_bootstrap``, with datasets drawn first and the entries of each drawn copy after."""
    each = two_stage_draws(frame, dataset, entry, replicates, seed).select((F.col("s") / F.col("n")).alias("m"))
    ends = each.agg(F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q"))
    return frame.agg(F.avg("x").alias("mean")).join(F.broadcast(ends)).select("mean", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


# Grid, tolerance, rounds and smoothing of the nonparametric prior.
GRID_LOW, GRID_HIGH, GRID_STEP = 1.0, 13.0, 0.02
EM_TOLERANCE, EM_ROUNDS, SMOOTHING_SD, SMOOTHING_REACH = 1e-8, 3000, 0.15, 5.0


def unit_likelihoods(doc: DataFrame, tau: float, grid: np.ndarray, df: float | None = None) -> DataFrame:
    """(entry, loglik): log likelihood of an entry's units at each grid point, less its greatest; normal errors, or Student's with ``df``.

    Units come sorted by entry and are added up as they pass, so an entry may have
    any number of them.
    """

    def density(y: np.ndarray) -> np.ndarray:
        z = (y[:, None] - grid) / tau
        return -0.5 * z * z if df is None else -(df + 1) / 2 * np.log1p(z * z / df)

    def run(batches):
        entry, total = None, None
        for table in batches:
            for at in range(0, len(table), 2000):
                rows = table.iloc[at : at + 2000]
                names, ll = rows["entry"].to_numpy(), density(rows["y"].to_numpy(float))
                first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
                sums, heads = np.add.reduceat(ll, first), names[first]
                if total is not None and heads[0] == entry:
                    sums[0] += total
                elif total is not None:
                    yield pd.DataFrame({"entry": [entry], "loglik": [total - total.max()]})
                entry, total = heads[-1], sums[-1].copy()
                if len(heads) > 1:
                    yield pd.DataFrame({"entry": heads[:-1], "loglik": list(sums[:-1] - sums[:-1].max(1, keepdims=True))})
        if total is not None:
            yield pd.DataFrame({"entry": [entry], "loglik": [total - total.max()]})

    kind = dict(doc.dtypes)["entry"]
    units = doc.where("entry is not null and document_value is not null").select("entry", F.col("document_value").cast("double").alias("y"))
    return units.repartition("entry").sortWithinPartitions("entry").mapInPandas(run, f"entry {kind}, loglik array<double>")


def smoothed(weight: np.ndarray, step: float, sd: float = SMOOTHING_SD) -> np.ndarray:
    """A prior on an even grid under a normal kernel, cut at ``SMOOTHING_REACH`` SDs; nothing comes from beyond the grid."""
    reach = int(SMOOTHING_REACH * sd / step + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) * step / sd) ** 2)
    out = np.convolve(weight, kernel / kernel.sum(), "full")[reach : reach + len(weight)]
    return out / out.sum()


def npmle(
    doc: DataFrame, tau: float, df: float | None = None, low: float = GRID_LOW, high: float = GRID_HIGH, step: float = GRID_STEP,
    tolerance: float = EM_TOLERANCE, rounds: int = EM_ROUNDS, smoothing: float | None = SMOOTHING_SD,
) -> DataFrame:
    """(x, weight): nonparametric maximum-likelihood prior of the entries on a grid, by EM from an even start, then smoothed.

    The likelihoods are stored once.  A round is one aggregate of the entries'
    responsibilities, a row per task and grid point; the driver holds the grid's
    weights and nothing else.  It ends when no weight moves by ``tolerance``.
    """
    grid = low + step * np.arange(round((high - low) / step) + 1)
    table = cut(unit_likelihoods(doc, tau, grid, df))
    n = table.count()
    if not n:
        raise ValueError("no entry has a unit")
    weight = np.full(len(grid), 1 / len(grid))

    def responsibilities(now: np.ndarray):
        def run(batches):
            total = np.zeros(len(grid))
            for rows in batches:
                for at in range(0, len(rows), 2000):
                    part = np.exp(np.stack(rows["loglik"].iloc[at : at + 2000].to_numpy())) * now
                    total += (part / part.sum(1, keepdims=True)).sum(0)
            yield pd.DataFrame({"j": np.arange(len(grid), dtype=np.int32), "r": total})

        return run

    for _ in range(rounds):
        shares = table.select("loglik").mapInPandas(responsibilities(weight), "j int, r double").groupBy("j").agg(F.sum("r").alias("r")).toPandas()
        new = np.zeros(len(grid))
        new[shares["j"]] = shares["r"] / n
        moved, weight = np.abs(new - weight).max(), new
        if moved < tolerance:
            break
    if smoothing:
        weight = smoothed(weight, step, smoothing)
    return doc.sparkSession.createDataFrame(pd.DataFrame({"x": grid, "weight": weight}))


def law_prediction(doc: DataFrame, prior: DataFrame, tau: float, lower: float, upper: float, df: float | None = None) -> DataFrame:
    """As ``grid_prediction``, from the likelihoods of all units, with normal or Student's errors."""
    points = prior.orderBy("x").toPandas()
    grid, weight = points["x"].to_numpy(float), points["weight"].to_numpy(float)
    classes = np.stack([grid <= lower, (grid > lower) & (grid < upper), grid >= upper], 1).astype(float)

    def run(batches):
        for rows in batches:
            part = np.exp(np.stack(rows["loglik"].to_numpy())) * weight if len(rows) else np.zeros((0, len(grid)))
            p = part @ classes / part.sum(1, keepdims=True)
            yield pd.DataFrame({"entry": rows["entry"], "p_inactive": p[:, 0], "p_medium": p[:, 1], "p_active": p[:, 2]})

    kind = dict(doc.dtypes)["entry"]
    return unit_likelihoods(doc, tau, grid, df).mapInPandas(run, f"entry {kind}, p_inactive double, p_medium double, p_active double")


def grid_prediction(doc: DataFrame, prior: DataFrame, tau: float, lower: float, upper: float) -> DataFrame:
    """(entry, p_inactive, p_medium, p_active) of the entry mean under a prior on a grid; the prior is small by construction."""
    m = doc.groupBy("entry").agg(F.count(F.lit(1)).alias("m"), F.avg("document_value").alias("y"))
    z = (F.col("y") - F.col("x")) * F.sqrt("m") / tau
    each = m.join(F.broadcast(prior)).withColumn("w", F.col("weight") * F.exp(-0.5 * z * z))
    share = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0)) / F.sum("w")
    return each.groupBy("entry").agg(share(F.col("x") <= lower).alias("p_inactive"), share((F.col("x") > lower) & (F.col("x") < upper)).alias("p_medium"), share(F.col("x") >= upper).alias("p_active"))


#: Documents whose offsets (one number each) come to the driver between the rounds of a fit.
MOST_DOCUMENTS = 1_000_000


def ridge_offsets(doc: DataFrame, penalty: float, rounds: int = 15) -> DataFrame:
    """(document, offset) that minimise squared distances from entry means plus ``penalty`` times squared offsets.

    Entry means and offsets are fitted in turn; a round is two aggregates over
    the units.  One number a document passes through the driver, so plans stay
    short; more than ``MOST_DOCUMENTS`` documents are refused.
    """
    spark = doc.sparkSession
    base = doc.select("entry", "document", "document_value").cache()
    if base.select("document").distinct().count() > MOST_DOCUMENTS:
        raise ValueError(f"more than {MOST_DOCUMENTS} documents")
    offsets = base.select("document").distinct().withColumn("offset", F.lit(0.0))
    for _ in range(rounds):
        free = base.join(offsets, "document")
        means = free.groupBy("entry").agg(F.avg(F.col("document_value") - F.col("offset")).alias("mean"))
        fitted = base.join(means, "entry").groupBy("document").agg((F.sum(F.col("document_value") - F.col("mean")) / (F.count(F.lit(1)) + penalty)).alias("offset"))
        offsets = spark.createDataFrame(fitted.toPandas())
    base.unpersist()
    return offsets


def comparators(records: DataFrame) -> DataFrame:
    """Plain scores of agreement per entry: range up to one, minus the SD, both sides of the class gap touched."""
    return records.where("value is not null").groupBy("entry").agg(
        (F.max("value") - F.min("value") <= 1).alias("range_within_one"), (-F.coalesce(F.stddev_samp("value"), F.lit(0.0))).alias("minus_sd"), F.count(F.lit(1)).alias("n")
    )


def null_flags(doc: DataFrame, tau: float, min_shared: int, threshold: float, agreement: float, replicates: int = 20, seed: int = 0) -> DataFrame:
    """(replicate, flagged): systematic pairs among values drawn anew without any offset.

    The normal numbers are made from hashes of entry, document and replicate, so
    the same are drawn wherever a task runs.
    """
    u = lambda s: (F.xxhash64("entry", "document", "replicate", F.lit(s)).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    each = doc.select("entry", "document").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    each = each.withColumn("x", tau * F.sqrt(-2 * F.log(u(seed))) * F.cos(2 * math.pi * u(seed + 1)))
    a, b = (each.select("replicate", "entry", F.col("document").alias(n), F.col("x").alias(f"x_{n}")) for n in "ab")
    pairs = a.join(b, ["replicate", "entry"]).where("a < b").groupBy("replicate", "a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.median(F.col("x_b") - F.col("x_a")).alias("med"), F.count_if(F.col("x_b") > F.col("x_a")).alias("up"), F.count_if(F.col("x_b") < F.col("x_a")).alias("down")
    )
    flagged = (F.col("n") >= min_shared) & (F.abs("med") >= threshold) & (F.when(F.col("med") > 0, F.col("up")).otherwise(F.col("down")) / F.col("n") >= agreement)
    return pairs.groupBy("replicate").agg(F.count_if(flagged).alias("flagged"), F.count(F.lit(1)).alias("pairs"))


def scores_by_sets(frame: DataFrame) -> DataFrame:
    """Accuracy and Brier score of (target, method, p, y) per target and method, and per method over all targets."""
    hit = F.when((F.col("p") >= 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0)
    table = frame.select("target", "method", hit.alias("hit"), ((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("miss"))
    table = table.groupingSets([["target", "method"], ["method"]], "target", "method")
    return table.agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy"), F.avg("miss").alias("brier"))


def entry_spread(doc: DataFrame) -> DataFrame:
    """Entries with several units: number, mean and SD."""
    return moments(doc).where("n_units >= 2").select("entry", "n_units", "mean", F.sqrt("variance").alias("sd"))
