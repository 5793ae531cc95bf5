"""Quality rules whose cutoffs come from quantile sketches per language and source.

Every document gets a few measures in one pass of built-in expressions.  A
sketch counts the documents of a (language, source) in bins of fixed width, so
sketches merge by adding counts, in any order, to the same sketch: the cutoffs
do not depend on how rows are partitioned.  A quantile is the middle of a bin,
half a width from a value of exactly that rank at most.  Partial counts leave each
task, so a source that holds a third of all rows costs one small sketch per task.

A cutoff is the group's median, plus ``spread`` times the distance from its 10 %
quantile to its median, plus a margin: the lower half of a group stays clean
while junk is a minority.  Cutoffs of small groups lean on those of their
language, and these on those of everything: a level of n documents weighs n
against ``PRIOR`` for the level above.  The cutoffs are joined back and filter the
documents.

Defined results.  A null text counts as empty: no words, base_failed, not kept.
Null languages and sources form groups of their own.  Repeated rows are scored
one by one.  An empty table gives no rows.  Two different 8-word windows are told
apart by 64-bit hashes.  Other columns of the input are left alone and may have
any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcewise.llm.common import Workspace, documents, let, text_or_empty

#: Documents that the level above counts for.
PRIOR = 200.0
#: measure: (spread, margin) of its upper cutoff, bins per unit, greatest value told apart.
RULES = {
    "symbol_share": (4.0, 0.02, 4096, 1),
    "upper_share": (4.0, 0.10, 4096, 1),
    "adjacent_share": (4.0, 0.15, 4096, 1),
    "dup_line_share": (4.0, 0.40, 4096, 1),
    "mean_word_chars": (8.0, 1.50, 64, 1024),
}
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def _paired(hashes: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` places on."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))


def _covered(windows: Column) -> Column:
    """Words in 8-word windows whose hash occurs twice or more."""

    def repeated(ordered: Column) -> Column:
        again = F.filter(
            ordered,
            lambda e, i: (e["h"] == F.get(ordered, i + 1)["h"]) | (e["h"] == F.get(ordered, i - 1)["h"]),
        )
        places = F.array_sort(F.transform(again, lambda e: e["i"]))
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(8), F.coalesce(F.get(p, k + 1) - x, F.lit(8)))),
                F.lit(0).cast("bigint"),
                lambda n, x: n + x,
            ),
        )

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(
        let(ordered, repeated)
    )


def _word_measures(words: Column, repeats: bool) -> Column:
    def of(h: Column) -> Column:
        same = F.filter(h, lambda x, i: x == F.get(h, i - 1))
        few = [F.size(h).cast("bigint").alias("n_words"), F.size(same).cast("bigint").alias("n_adjacent")]
        if not repeats:
            return F.struct(*few)
        windows = let(_paired(h, 1), lambda h2: let(_paired(h2, 2), lambda h4: _paired(h4, 4)))
        windows = F.slice(windows, F.lit(1), F.greatest(F.size(h) - 7, F.lit(0)))
        return F.struct(*few, let(windows, _covered).alias("n_repeat_words"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def measures(docs: DataFrame, carried: list[str] | None = None, repeats: bool = True) -> DataFrame:
    """The carried columns of ``docs`` (all by default) as column ``row``, with the measures beside it; ``repeats``: n_repeat_words too."""
    text = text_or_empty()
    words = F.array_remove(F.split(text, BLANK), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = lambda c: F.length(c).cast("bigint")
    base = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in (docs.columns if carried is None else carried))).alias("row"),
        F.col("lang").alias("lang"),
        F.col("source").alias("source"),
        _word_measures(words, repeats).alias("w"),
        n(F.translate(text, SPACES, "")).alias("word_chars"),
        (n(text) - n(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        (n(text) - n(F.regexp_replace(text, r"\p{Lu}", ""))).alias("n_upper"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("l"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return base.select(
        "row",
        "lang",
        "source",
        F.col("w.n_words").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.dup").alias("n_dup_lines"),
        *([F.col("w.n_repeat_words").alias("n_repeat_words")] if repeats else []),
        share(F.col("n_symbols"), F.col("word_chars")).alias("symbol_share"),
        share(F.col("n_upper"), F.col("word_chars")).alias("upper_share"),
        share(F.col("w.n_adjacent"), F.col("w.n_words")).alias("adjacent_share"),
        share(F.col("l.dup"), F.col("l.n")).alias("dup_line_share"),
        share(F.col("word_chars"), F.col("w.n_words")).alias("mean_word_chars"),
    )


def sketches(scored: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): how many documents of a group have a measure in a bin."""

    def binned(m: str) -> Column:
        _, _, per_unit, most = RULES[m]
        return F.struct(F.lit(m).alias("measure"), F.floor(F.least(F.col(m), F.lit(float(most))) * per_unit + 0.5).alias("bin"))

    each = scored.select("lang", "source", F.explode(F.array(*(binned(m) for m in RULES))).alias("b"))
    return each.groupBy("lang", "source", F.col("b.measure").alias("measure"), F.col("b.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _level(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Documents and plain cutoff of each measure at one level; a group has a bounded number of bins."""
    bins = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    bins = bins.withColumn("total", F.sum("n").over(group)).withColumn("below", F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    at = bins.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("below") * 2 >= F.col("total"), F.col("bin"))).alias("middle"),
        F.min(F.when(F.col("below") * 10 >= F.col("total"), F.col("bin"))).alias("low"),
    )
    cut = F.lit(None).cast("double")
    for m, (spread, margin, per_unit, _) in RULES.items():
        value = F.col("middle") / per_unit + spread * ((F.col("middle") - F.col("low")) / per_unit) + margin
        cut = F.when(F.col("measure") == m, value).otherwise(cut)
    return at.select(*(F.col(k).alias(f"{tag}_{k}") for k in keys), F.col("measure").alias(f"{tag}_measure"), F.col("total").alias(f"{tag}_n"), cut.alias(f"{tag}_cut"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): the upper cutoff of each measure."""
    whole, by_lang, own = _level(sketch, [], "all"), _level(sketch, ["lang"], "of"), _level(sketch, ["lang", "source"], "cut")

    def leaning(tag: str, above: Column) -> Column:
        return (F.col(f"{tag}_n") * F.col(f"{tag}_cut") + PRIOR * above) / (F.col(f"{tag}_n") + PRIOR)

    table = own.join(by_lang, F.col("cut_lang").eqNullSafe(F.col("of_lang")) & (F.col("cut_measure") == F.col("of_measure")))
    table = table.join(whole, F.col("cut_measure") == F.col("all_measure"))
    table = table.select("cut_lang", "cut_source", "cut_measure", leaning("cut", leaning("of", F.col("all_cut"))).alias("most"))
    return table.groupBy("cut_lang", "cut_source").agg(*(F.max(F.when(F.col("cut_measure") == m, F.col("most"))).alias(f"most_{m}") for m in RULES))


def judged(docs: DataFrame, carried: list[str] | None = None, stored: bool = False) -> DataFrame:
    """Measures of every row of ``docs`` with base_failed and kept.

    With ``stored``, the measures are written once with the carried columns; else
    they are computed for the sketches and again for the verdicts, so that no copy
    of the texts is made.
    """
    work = Workspace(docs.sparkSession, "quality")
    scored = work.put(measures(docs, carried), "scored") if stored else measures(docs, carried)
    sketch = work.put(sketches(scored if stored else measures(docs, [], repeats=False)), "sketches")
    limits = work.put(cutoffs(sketch), "cutoffs", "sketches")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    within = F.lit(True)
    for m in RULES:
        within = within & (F.col(m) <= F.col(f"most_{m}"))
    return (
        scored.join(
            limits,
            F.col("lang").eqNullSafe(F.col("cut_lang")) & F.col("source").eqNullSafe(F.col("cut_source")),
            "left",
        )
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & within)
    )


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judged(docs).where("kept").select("row.*")


def _sql() -> str:
    """The rows of ``op9_quality_rules`` in SQL."""
    of = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / {b} END"
    shares = {
        "symbol_share": of("n_symbols", "word_chars"), "upper_share": of("n_upper", "word_chars"), "adjacent_share": of("n_adjacent", "n_words"),
        "dup_line_share": of("n_dup_lines", "n_lines"), "mean_word_chars": of("word_chars", "n_words"),
    }
    bins = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS m, {spread}::DOUBLE AS spread, {margin}::DOUBLE AS margin, {per_unit} AS per_unit, floor(least({m}, {most}::DOUBLE) * {per_unit} + 0.5)::BIGINT AS b FROM s"
        for m, (spread, margin, per_unit, most) in RULES.items()
    )

    def level(tag: str, keys: str) -> str:
        per = f"{keys}m, spread, margin, per_unit"
        return f"""{tag} AS (SELECT {per}, max(total) AS n, min(CASE WHEN below * 2 >= total THEN b END) / per_unit + spread * ((min(CASE WHEN below * 2 >= total THEN b END) - min(CASE WHEN below * 10 >= total THEN b END)) / per_unit) + margin AS cut
 FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}m) AS total, sum(n) OVER (PARTITION BY {keys}m ORDER BY b ROWS UNBOUNDED PRECEDING) AS below FROM (SELECT {per}, b, count(*) AS n FROM bins GROUP BY {per}, b)) GROUP BY {per})"""

    blank = r"\x20\x09-\x0D"
    within = " AND ".join(f"{m} <= max_{m}" for m in RULES)
    return rf"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^{blank}]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{blank}]')) AS lines FROM d),
wins AS (SELECT k, i, array_to_string(list_slice(words, i, i + 7), ' ') AS win FROM (SELECT k, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
again AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS p FROM wins JOIN (SELECT k, win FROM wins GROUP BY k, win HAVING count(*) > 1) USING (k, win)) GROUP BY k),
m AS (SELECT k, doc_id, lang, source, len(words) AS n_words, length(regexp_replace(t, '[{blank}]', '', 'g')) AS word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
 length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper, len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_adjacent,
 len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words FROM w LEFT JOIN again USING (k)),
s AS (SELECT *, {", ".join(f"{sql} AS {name}" for name, sql in shares.items())} FROM m),
bins AS ({bins}),
{level("whole", "")}, {level("langs", "lang, ")}, {level("own", "lang, source, ")},
cuts AS (SELECT o.lang, o.source, o.m, (o.n * o.cut + {PRIOR}::DOUBLE * ((l.n * l.cut + {PRIOR}::DOUBLE * a.cut) / (l.n + {PRIOR}::DOUBLE))) / (o.n + {PRIOR}::DOUBLE) AS most
 FROM own o JOIN langs l ON o.lang IS NOT DISTINCT FROM l.lang AND o.m = l.m JOIN whole a ON o.m = a.m),
limits AS (SELECT lang, source, {", ".join(f"max(CASE WHEN m = '{m}' THEN most END) AS max_{m}" for m in RULES)} FROM cuts GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {within} AS kept, {", ".join(RULES)}
FROM s JOIN limits ON s.lang IS NOT DISTINCT FROM limits.lang AND s.source IS NOT DISTINCT FROM limits.source"""


OP9_SQL = _sql()


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), carried=["doc_id"], stored=True).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        *RULES,
    )
