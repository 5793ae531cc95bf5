"""Evidence units, pooled variance, document-pair offsets and class support.

Everything is keyed on the entry: units, moments, pairs and posteriors share one
shuffle key, so Spark reuses the partitioning.  Fits are one-row aggregates that
are joined back as a broadcast of one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcewise.functions.expressions import class_of, class_tails, clean_double, rounded_key
from sourcewise.operators.order import cut
from sourcewise.operators.pairs import BROADCAST_DOCUMENTS, Pairs, agreement, row_statistics

# The SD where too few entries have several units, and the least variance of one entry.
FALLBACK_SD, VARIANCE_FLOOR = 0.64, 1e-4
#: Records of a part, so that the sorts of a task don't grow with the table.
PART_ROWS = 100_000


def ranked(frame: DataFrame, value: str, *keys: str) -> DataFrame:
    """``frame`` with ``middle``: the value where it is one of the one or two middle ones of its group, else null.

    The mean of ``middle`` is the exact median.  Groups are sorted, spilling as
    any sort does, and no group's values are gathered in an aggregate.
    Counts and places share one order, so rows are sorted once.
    """
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(value))
    n, r = F.count(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.row_number().over(w)
    return frame.withColumn("middle", F.when((2 * r >= n) & (2 * r <= n + 2), F.col(value)))


def by_entry(frame: DataFrame) -> DataFrame:
    """``frame`` dealt out by entry into parts of about ``PART_ROWS`` rows; all groups within an entry are formed without a further shuffle."""
    return frame.repartition(max(frame.sparkSession.sparkContext.defaultParallelism, -(-frame.count() // PART_ROWS)), "entry")


def units(records: DataFrame, merge_identical: bool = True, decimals: int = 2) -> DataFrame:
    """entry, document, document_value, n_records, documents: one exact median per entry and document.

    With ``merge_identical``, units of an entry that agree after rounding become
    one: first document, median of the medians, summed records, all documents.
    Values that are no finite number are dropped; a null document is
    ``unknown_document``.
    """
    frame = records.select("entry", F.coalesce(F.col("document").cast("string"), F.lit("unknown_document")).alias("document"), clean_double(F.col("value")).alias("value"))
    known = by_entry(frame.where(F.col("value").isNotNull() & F.col("entry").isNotNull()))
    plain = ranked(known, "value", "entry", "document").groupBy("entry", "document").agg(F.avg("middle").alias("document_value"), F.count(F.lit(1)).alias("n_records"))
    return merged(plain, decimals) if merge_identical else plain.withColumn("documents", F.array("document"))


def merged(plain: DataFrame, decimals: int = 2, marks: tuple[str, ...] = ()) -> DataFrame:
    """Units of an entry that agree after rounding as one; from units that are not merged.  A boolean column of ``marks`` is true if any of its units has it."""
    keyed = plain.withColumn("rounded", rounded_key(F.col("document_value"), decimals))
    return (
        ranked(keyed, "document_value", "entry", "rounded")
        .groupBy("entry", "rounded")
        .agg(
            F.min("document").alias("document"),
            F.avg("middle").alias("document_value"),
            F.sum("n_records").alias("n_records"),
            F.array_sort(F.collect_list("document")).alias("documents"),
            *(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in marks),
        )
        .select("entry", "document", "document_value", "n_records", "documents", *marks)
    )


def moments(doc: DataFrame) -> DataFrame:
    """n_units, mean, median and sample variance (0 for one unit) of each entry."""
    return ranked(doc, "document_value", "entry").groupBy("entry").agg(
        F.count(F.lit(1)).alias("n_units"),
        F.avg("document_value").alias("mean"),
        F.avg("middle").alias("median"),
        F.coalesce(F.var_samp("document_value"), F.lit(0.0)).alias("variance"),
    )


def _spread(doc: DataFrame) -> DataFrame:
    """n_units and sample variance of entries with two units or more."""
    return doc.groupBy("entry").agg(F.count(F.lit(1)).alias("n_units"), F.var_samp("document_value").alias("variance")).where("n_units >= 2")


def pooled_sd(doc: DataFrame, min_entries: int = 5, fallback_sd: float | None = FALLBACK_SD, cap: int | None = None) -> DataFrame:
    """One row: tau, method, n_entries, n_units, degrees_of_freedom of the pooled between-unit SD.

    With ``cap``, no entry weighs more than that many degrees of freedom.
    """
    multi = _spread(doc)
    df = F.col("n_units") - 1 if cap is None else F.least(F.col("n_units") - 1, F.lit(cap))
    total = multi.agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.coalesce(F.sum("n_units"), F.lit(0)).alias("n_units"),
        F.coalesce(F.sum(df), F.lit(0)).alias("degrees_of_freedom"),
        F.sum(F.col("variance") * df).alias("sum_of_squares"),
    )
    enough = F.col("n_entries") >= min_entries
    spare = F.lit(fallback_sd).cast("double") if fallback_sd is not None else F.raise_error(F.lit("too few entries with two or more units")).cast("double")
    return total.select(
        "n_entries",
        "n_units",
        "degrees_of_freedom",
        F.when(enough, F.sqrt(F.col("sum_of_squares") / F.col("degrees_of_freedom"))).otherwise(spare).alias("tau"),
        F.when(enough, "pooled_between_unit_sd").otherwise("literature_fallback").alias("method"),
    )


def dominant_entry(doc: DataFrame) -> DataFrame:
    """The entry with the greatest share of degrees of freedom or of squares; the first in key order on ties."""
    multi = cut(_spread(doc).select("entry", (F.col("n_units") - 1).alias("df"), (F.col("variance") * (F.col("n_units") - 1)).alias("ss")))
    total = multi.agg(F.sum("df").alias("all_df"), F.sum("ss").alias("all_ss"))
    shares = multi.join(F.broadcast(total)).select(
        "entry", (F.col("df") / F.col("all_df")).alias("df_share"), F.coalesce(F.try_divide("ss", "all_ss"), F.lit(0.0)).alias("ss_share")
    )
    return shares.orderBy(F.greatest("df_share", "ss_share").desc(), "entry").limit(1)


def pair_offsets(records: DataFrame, min_shared: int = 3, offset_threshold: float = 1.0, sign_agreement: float = 0.8) -> DataFrame:
    """Differences of documents over the entries that they share, B minus A with A before B.

    The differences are as many as the pairs of documents of each entry; they are
    made and sorted for their exact median in buckets (``pairs.Pairs``).
    """
    if min_shared < 1 or offset_threshold < 0 or not 0 <= sign_agreement <= 1:
        raise ValueError("min_shared from 1, offset_threshold from 0, sign_agreement from 0 to 1")
    return _offsets(_pairs(units(records, merge_identical=False)).statistics(min_shared), offset_threshold, sign_agreement)


def pair_offsets_and_totals(records: DataFrame, min_shared: int = 3, offset_threshold: float = 1.0, sign_agreement: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``pair_offsets`` and ``pair_totals`` of the same differences."""
    found, counts = _pairs(units(records, merge_identical=False)).statistics_and_totals(min_shared)
    return _offsets(found, offset_threshold, sign_agreement), _totals(counts)


def stored_units(records: DataFrame) -> DataFrame:
    """Units that are not merged, without their documents, as a checkpoint for the steps that read them several times."""
    return cut(units(records, merge_identical=False).drop("documents"))


def _pairs(doc: DataFrame, stored: bool = False) -> Pairs:
    return Pairs(doc.select("entry", "document", F.col("document_value").alias("value")), stored=stored)


def systematic_pairs(stored: DataFrame, min_shared: int = 3, offset_threshold: float = 1.0, sign_agreement: float = 0.8) -> DataFrame:
    """(document_a, document_b) of the systematic pairs of ``stored_units``; no other pair leaves its bucket."""
    return _pairs(stored, stored=True).statistics(min_shared, offset_threshold, sign_agreement).select("document_a", "document_b")


def marked(stored: DataFrame, flagged: DataFrame) -> DataFrame:
    """``stored_units`` with ``hit``, true for the documents of the ``flagged`` pairs."""
    bad = cut(flagged.select(F.explode(F.array("document_a", "document_b")).alias("document")).distinct().withColumn("hit", F.lit(True)))
    return stored.join(F.broadcast(bad) if bad.count() <= BROADCAST_DOCUMENTS else bad, "document", "left")


def top_pairs(records: DataFrame, k: int = 10, min_shared: int = 3) -> DataFrame:
    """(document_a, document_b, shared_entries, median_offset) of the k pairs that share most entries; only theirs are differences that are made."""
    if k < 1 or min_shared < 1:
        raise ValueError("k and min_shared from 1")
    plain = stored_units(records)
    best = cut(Pairs(plain.select("entry", "document"), stored=True).most_shared(k, min_shared))
    unit = lambda n: plain.select("entry", F.col("document").alias(f"document_{n}"), F.col("document_value").alias(n))
    pair = F.broadcast(best.select("document_a", "document_b"))
    ends = unit("b").join(F.broadcast(best.select("document_b").distinct()), "document_b", "left_semi")
    diffs = unit("a").join(pair, "document_a").join(ends, ["entry", "document_b"]).select("document_a", "document_b", (F.col("b") - F.col("a")).alias("d"))
    return row_statistics(diffs, ["document_a", "document_b"], min_shared).select("document_a", "document_b", "shared_entries", "median_offset")


def _offsets(found: DataFrame, offset_threshold: float, sign_agreement: float) -> DataFrame:
    out = found.withColumn("sign_agreement", agreement())
    return out.select(
        "document_a",
        "document_b",
        "shared_entries",
        "median_offset",
        "mean_offset",
        "std_offset",
        "sign_agreement",
        ((F.abs("median_offset") >= offset_threshold) & (F.col("sign_agreement") >= sign_agreement)).alias("systematic_offset"),
        (F.col("n_a") + F.col("n_b") - F.col("shared_entries")).alias("touched_entry_count"),
    )


def pair_totals(records: DataFrame, min_shared: int = 3) -> DataFrame:
    """One row: possible, observed and evaluated document pairs."""
    return _totals(Pairs(units(records, merge_identical=False).select("entry", "document")).totals(min_shared))


def _totals(counts: DataFrame) -> DataFrame:
    return counts.select(
        (F.col("documents") * (F.col("documents") - 1) / 2).cast("bigint").alias("document_pair_possible_count"),
        F.col("observed").alias("observed_document_pair_count"), F.col("evaluated").alias("document_pair_count"),
    )


def posteriors(doc: DataFrame, fit: DataFrame, prior_df: float | None = None) -> DataFrame:
    """Moments of each entry with the scale of its mean and of a new unit; ``fit`` is one row with tau.

    Without ``prior_df`` the Gaussian model; with it the moderated t model, in
    which an entry's own variance weighs its degrees of freedom against the prior's.
    """
    m = moments(doc).join(F.broadcast(fit.select("tau")))
    if prior_df is None:
        variance, df = F.col("tau") * F.col("tau"), F.lit(None).cast("double")
    else:
        own = F.when(F.col("n_units") > 1, F.greatest("variance", F.lit(VARIANCE_FLOOR))).otherwise(0.0)
        df = F.lit(float(prior_df)) + F.col("n_units") - 1
        variance = (prior_df * F.col("tau") * F.col("tau") + (F.col("n_units") - 1) * own) / df
    return m.select(
        "entry", "n_units", "mean", "median", "variance", "tau", df.alias("posterior_df"),
        F.sqrt(variance / F.col("n_units")).alias("posterior_scale"),
        F.sqrt(variance * (1 + 1 / F.col("n_units"))).alias("predictive_scale"),
    )


def held_out(doc: DataFrame) -> DataFrame:
    """Each unit against the mean and variance of the entry's other units."""
    w = Window.partitionBy("entry")
    n, s = F.count(F.lit(1)).over(w), F.sum("document_value").over(w)
    rest = (s - F.col("document_value")) / (n - 1)
    squares = F.var_pop("document_value").over(w) * n
    table = doc.withColumns({"n": n, "center": F.when(n > 1, rest), "squares": squares, "middle": s / n}).where("n >= 2")
    # squares of the others around their own mean: all squares less what this unit adds to them
    spread = F.col("squares") - (F.col("document_value") - F.col("middle")) ** 2 * F.col("n") / (F.col("n") - 1)
    own = F.when(F.col("n") > 2, F.greatest(spread / (F.col("n") - 2), F.lit(1e-4))).otherwise(0.0)
    return table.select("entry", "document", F.col("document_value").alias("observed"), "center", own.alias("own"), (F.col("n") - 1).alias("remaining"))


def largest_units(doc: DataFrame) -> DataFrame:
    """Per entry: documents of the unit with most records (the lower value on ties) and its share of the records."""
    top = F.max_by("documents", F.struct("n_records", -F.col("document_value")))
    return doc.groupBy("entry").agg(top.alias("top"), (F.max("n_records") / F.sum("n_records")).alias("top_unit_record_fraction")).select("entry", F.array_join("top", ";").alias("top_unit_documents"), "top_unit_record_fraction")


def discordance(doc: DataFrame, flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entry, discordant_document_pairs, discordant_documents) of entries with both documents of a flagged pair,
    and (entry, touched) of entries with either."""
    each = doc.select("entry", F.explode("documents").alias("document")).distinct()
    either = flagged.select(F.explode(F.array("document_a", "document_b")).alias("document")).distinct()
    touched = each.join(either, "document").select("entry").distinct().withColumn("touched", F.lit(True))
    both = each.withColumnRenamed("document", "document_a").join(flagged, "document_a").join(each.withColumnRenamed("document", "document_b"), ["entry", "document_b"])
    named = both.groupBy("entry").agg(
        F.count(F.lit(1)).alias("discordant_document_pairs"),
        F.array_join(F.array_sort(F.array_union(F.collect_set("document_a"), F.collect_set("document_b"))), ";").alias("discordant_documents"),
    )
    return named, touched


# The evidence models.
MODELS = ("gaussian", "exclude-flagged", "moderated_t")


def support(
    records: DataFrame, lower: float, upper: float, level: float = 0.8, offset_display: str = "none",
    min_shared: int = 3, offset_threshold: float = 1.0, sign_agreement: float = 0.8,
    model: str = "gaussian", fit: dict | None = None, assumed_sigma: float | None = None, merge_identical: bool = True,
) -> DataFrame:
    """How well independent documents support each entry's class.

    The displayed class is that of the record median.  Its consensus probability
    is ``class_confidence``, its predictive one ``class_reproducibility``.  An
    entry is supported from ``level`` on; with ``offset_display="uncertain"``
    entries that touch a systematic pair are uncertain whatever their support.

    ``gaussian`` pools one variance; ``exclude-flagged`` leaves out units with a
    document of a systematic pair, and entries without any other keep the fit of all;
    ``moderated_t`` weighs each entry's own variance against a prior, fitted by
    ``models.fit_predictive_variance`` or given as ``fit`` (tau, prior_df).
    ``assumed_sigma`` replaces the fit, and adds its two columns.
    """
    if not 0.5 < level < 1:
        raise ValueError("level must lie between 0.5 and 1")
    if model not in MODELS or offset_display not in ("none", "uncertain"):
        raise ValueError("model is one of gaussian, exclude-flagged, moderated_t; offset_display none or uncertain")
    if min_shared < 2 or offset_threshold <= 0 or not 0.5 < sign_agreement <= 1:
        raise ValueError("min_shared from 2, offset_threshold above 0, sign_agreement above 0.5 and up to 1")
    if assumed_sigma is not None and (fit is not None or not 0 < assumed_sigma < float("inf")):
        raise ValueError("assumed_sigma is finite, positive and stands without fit")
    plain = stored_units(records)
    flagged = systematic_pairs(plain, min_shared, offset_threshold, sign_agreement)
    flagged = cut(flagged)  # read by several joins below
    hits = marked(plain, flagged) if model == "exclude-flagged" else plain.withColumn("hit", F.lit(False))
    # read for the fit, the moments, the largest units and the discordant documents
    doc = cut(merged(hits, marks=("hit",)) if merge_identical else hits.withColumns({"documents": F.array("document"), "hit": F.coalesce("hit", F.lit(False))}))
    one = lambda tau: records.sparkSession.range(1).select(F.lit(float(tau)).alias("tau"))
    prior_df = None
    if assumed_sigma is not None:
        first = one(assumed_sigma)
    elif model == "moderated_t" or fit is not None:
        if fit is None:
            from sourcewise.operators.models import fit_predictive_variance

            fit = fit_predictive_variance(doc)
        first, prior_df = one(fit["tau"]), fit.get("prior_df")
    else:
        first = pooled_sd(doc)
    if model == "exclude-flagged":
        clean = doc.where(~F.col("hit"))
        lost = doc.join(clean.select("entry").distinct(), "entry", "left_anti")
        second = first if assumed_sigma is not None else pooled_sd(clean)
        post = posteriors(clean, second).join(largest_units(clean), "entry").unionByName(posteriors(lost, first, prior_df).join(largest_units(lost), "entry"))
    else:
        post = posteriors(doc, first, prior_df).join(largest_units(doc), "entry")
    known = records.select("entry", "document", clean_double(F.col("value")).alias("value")).where("entry is not null")
    # Documents are counted over all records, as rows without a value name theirs too.
    shown = ranked(known, "value", "entry").groupBy("entry").agg(F.avg("middle").alias("median_value"), F.countDistinct("document").alias("n_documents"), F.count("value").alias("n_records"))
    both, touched = discordance(doc, flagged)
    wide = post.join(shown, "entry").join(touched, "entry", "left").join(both, "entry", "left")
    names = ("inactive", "medium", "active")
    tails = {}
    for kind, scale in (("consensus", "posterior_scale"), ("new_document", "predictive_scale")):
        tails[f"p_{kind}_inactive"], tails[f"p_{kind}_active"] = class_tails(F.col("mean"), F.col(scale), lower, upper, F.col("posterior_df") if prior_df is not None else None)
    out = wide.withColumns({"activity_class": class_of(F.col("median_value"), lower, upper), **tails})
    rest = lambda kind: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col(f"p_{kind}_inactive") - F.col(f"p_{kind}_active")))
    out = out.withColumns({f"p_{kind}_medium": rest(kind) for kind in ("consensus", "new_document")})
    of = lambda kind: F.when(F.col("activity_class") == "inactive", F.col(f"p_{kind}_inactive")).when(F.col("activity_class") == "medium", F.col(f"p_{kind}_medium")).otherwise(F.col(f"p_{kind}_active"))
    out = out.withColumns({"class_confidence": of("consensus"), "class_reproducibility": of("new_document")})
    hit = F.coalesce("touched", F.lit(False)) if offset_display == "uncertain" else F.lit(False)
    enough = F.col("class_confidence") >= level
    balanced = class_of(F.col("mean"), lower, upper)
    return out.select(
        "entry", "n_records", "median_value", "activity_class", "n_documents", F.col("n_units").alias("n_evidence_units"), "top_unit_documents", "top_unit_record_fraction",
        F.col("mean").alias("document_balanced_value"), balanced.alias("document_balanced_class"),
        (balanced != F.col("activity_class")).cast("int").alias("class_changed_by_document_balance"), F.col("posterior_scale").alias("consensus_scale"),
        *(f"p_{kind}_{name}" for name in names for kind in ("consensus", "new_document")), "class_confidence", "class_reproducibility",
        F.coalesce("discordant_document_pairs", F.lit(0)).alias("discordant_document_pairs"), F.coalesce("discordant_documents", F.lit("")).alias("discordant_documents"),
        F.coalesce("touched", F.lit(False)).alias("offset_pair_touched"),
        F.when(enough & ~hit, "supported").otherwise("uncertain").alias("class_status"),
        F.when(hit, "offset_pair").when(enough, "supported").otherwise("low_support").alias("status_reason"),
        *([F.lit(float(assumed_sigma)).alias("sigma_doc"), F.lit(None).cast("int").alias("sigma_doc_degrees_of_freedom")] if assumed_sigma is not None else []),
    )


def support_fit(records: DataFrame, min_shared: int = 3, offset_threshold: float = 1.0, sign_agreement: float = 0.8) -> DataFrame:
    """One row that describes the Gaussian fit: sigma, degrees of freedom, pair counts, and the warning that applies."""
    plain = stored_units(records)
    doc = merged(plain)
    fit, top = pooled_sd(doc), dominant_entry(doc)
    flagged, counts = _pairs(plain, stored=True).statistics_and_totals(min_shared, offset_threshold, sign_agreement)
    ends = flagged.select(F.explode(F.array("document_a", "document_b")).alias("document")).distinct()
    pairs = flagged.agg(F.count(F.lit(1)).alias("discordant_document_pair_count")).join(ends.agg(F.count(F.lit(1)).alias("flagged_document_count")))
    out = fit.join(_totals(counts)).join(pairs).join(top, F.lit(True), "left")
    share = F.greatest(F.coalesce("df_share", F.lit(0.0)), F.coalesce("ss_share", F.lit(0.0)))
    warning = F.when(F.col("method") == "literature_fallback", "too few entries with several units").when(share > 0.3, F.concat(F.lit("one entry dominates: "), F.col("entry").cast("string")))
    return out.select(
        F.col("tau").alias("sigma_doc"), F.when(F.col("method") != "literature_fallback", F.col("degrees_of_freedom")).alias("sigma_doc_degrees_of_freedom"), F.col("n_entries").alias("multi_unit_entry_count"),
        "document_pair_possible_count", "observed_document_pair_count", "document_pair_count", "discordant_document_pair_count", "flagged_document_count", "method", warning.alias("warning"),
    )
