"""Licence scan: MinHash bands over overlapping windows, then exact shingle containment.

Words are runs of ASCII letters, digits and other non-ASCII characters, lower
case; shingles are five words.  For each scale s = 1, 2, 4, ... a text is cut
into windows of three half-scales that start every half-scale (s = 1: single
shingles), so a run of up to s shingles lies whole in some window.  A template
of any length belongs to the least scale that holds it (scales double up to the
longest template), so it makes up a third or more of
such a window's shingles.  With one permutation a band and ``BANDS`` bands, the
window and the template share a band value with a chance of at least
1 - (2/3)**32 = 0.999997.  Band values are exchanged by an equal join; pairs
are then kept by exact containment: ``LEAST`` of the template's distinct
shingles stand within the window and half a scale on either side.

A window can only share a band value with a template if it holds the shingle
that is the template's minimum under that band's permutation.  So a document's
windows are signed only around such shingles, found by a literal set whose size
is templates times bands; the outcome is that of signing every window.

Only built-in expressions run.  Shingles are told apart by 64-bit hashes.

A licence with several wordings, as ``MIT`` and ``MIT-full``, is reported for each that is found.

Defined results.  Null, empty and shorter texts match nothing.  Repeated rows
and null or repeated doc_ids are handled row by row.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcewise.llm.common import Workspace, documents, let, text_or_empty
from sourcewise.llm.license_texts import TEMPLATES

BANDS, LEAST = 32, 0.8


def scales(most: int) -> list[int]:
    """1, 2, 4, ... up to the first that holds ``most`` shingles."""
    return [1 << k for k in range(max(0, most - 1).bit_length() + 1)]


def shingles(text: Column) -> Column:
    """64-bit hashes of the five-word shingles of a text."""
    words = F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")

    def pair(h: Column, step: int) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def of(h: Column) -> Column:
        four = let(pair(h, 1), lambda h2: pair(h2, 2))
        five = let(four, lambda f: F.transform(f, lambda x, i: F.xxhash64(x, F.get(h, i + 4))))
        return F.slice(five, F.lit(1), F.greatest(F.size(h) - 4, F.lit(0)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def permuted(h: Column, band: int) -> Column:
    return F.xxhash64(h, F.lit(band))


def _sign(window: Column) -> Column:
    """Array of (band, value): the least permuted hash of the window in each band."""

    def least(b: int) -> Column:
        def one(h: Column) -> Column:
            return permuted(h, b)

        return F.struct(F.lit(b).alias("band"), F.array_min(F.transform(window, one)).alias("value"))

    return F.array(*(least(b) for b in range(BANDS)))


def _minima(h: Column) -> Column:
    """The shingle that is least in each band."""

    def least(b: int) -> Column:
        def one(x: Column) -> Column:
            return F.struct(permuted(x, b).alias("p"), x.alias("h"))

        return F.array_min(F.transform(h, one))["h"]

    return F.array(*(least(b) for b in range(BANDS)))


def templates(spark: SparkSession, texts: dict[str, str]) -> tuple[DataFrame, list[int]]:
    """(license, scale, size, h, signature, minima) of each template of five words or more, and all scales up to the longest."""
    rows = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in texts.items()))
    table = spark.range(1).select(F.explode(rows).alias("t")).select("t.license", F.array_distinct(shingles(F.col("t.text"))).alias("h")).where(F.size("h") > 0)
    steps = scales(table.agg(F.max(F.size("h"))).first()[0] or 1)
    scale = F.lit(None).cast("int")
    for s in reversed(steps):
        scale = F.when(F.size("h") <= s, s).otherwise(scale)
    return table.select("license", scale.alias("scale"), F.size("h").alias("size"), "h", _sign(F.col("h")).alias("signature"), _minima(F.col("h")).alias("minima")), steps


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """(row_key, doc_id, found): found holds (license, containment, first word, end word), best first of each licence."""
    spark = docs.sparkSession
    work = Workspace(spark, "licenses")
    known, steps = templates(spark, TEMPLATES if texts is None else texts)
    known = work.put(known, "templates")
    probes = [r[0] for r in known.select(F.explode("minima")).distinct().collect()]

    base = docs.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", shingles(text_or_empty()).alias("h"))
    near = F.filter(F.transform("h", lambda x, i: F.when(x.isin(probes), i)), lambda i: i.isNotNull()) if probes else F.array().cast("array<int>")
    hit = F.exists("h", lambda x: x.isin(probes)) if probes else F.lit(False)
    base = base.select("row_key", "doc_id", F.when(hit, F.col("h")).alias("h"), F.when(hit, near).alias("near"))
    base = work.put(base, "base")

    def windows(p: Column) -> Column:
        each = []
        for s in steps:
            half = max(1, s // 2)
            last = (p / half).cast("int")
            first = F.greatest(last - (0 if s == 1 else 2), F.lit(0))
            each.append(F.transform(F.sequence(first, last), _window(s)))
        return F.concat(*each)

    placed = F.array_distinct(F.flatten(F.transform("near", windows)))
    cut = base.where("h is not null").select("row_key", "h", F.explode(placed).alias("w"))
    half = F.greatest(F.lit(1), (F.col("w.scale") / 2).cast("int"))
    start = F.col("w.k") * half
    width = F.when(F.col("w.scale") == 1, 1).otherwise(3 * half)
    margin = F.when(F.col("w.scale") == 1, 0).otherwise(half)
    region = F.greatest(start - margin, F.lit(0))
    window = cut.select(
        "row_key", F.col("w.scale").alias("scale"), region.alias("at"),
        F.slice("h", start + 1, width).alias("window"), F.slice("h", region + 1, start + width + margin - region).alias("region"),
    )
    signed = window.select("row_key", "scale", "at", "region", F.explode(let(F.col("window"), _sign)).alias("s")).select("row_key", "scale", "at", "region", "s.band", "s.value")
    bands = known.select("license", "scale", "size", F.col("h").alias("t"), F.explode("signature").alias("s")).select("license", "scale", "size", "t", "s.band", "s.value")
    pairs = signed.join(bands, ["scale", "band", "value"]).dropDuplicates(["row_key", "scale", "at", "license"])
    share = F.size(F.array_intersect("t", "region")) / F.col("size")
    inside = F.filter(F.transform("region", lambda x, i: F.when(F.array_contains("t", x), i)), lambda i: i.isNotNull())
    spans = pairs.select("row_key", "license", share.alias("share"), "at", inside.alias("inside")).where(F.col("share") >= LEAST)
    spans = spans.select("row_key", "license", "share", (F.col("at") + F.array_min("inside")).alias("first"), (F.col("at") + F.array_max("inside") + 5).alias("end"))
    best = spans.groupBy("row_key", "license").agg(F.max(F.struct("share", (-F.col("first")).alias("back"), "end")).alias("b"))
    found = best.groupBy("row_key").agg(
        F.array_sort(F.collect_list(F.struct("license", F.col("b.share").alias("share"), (-F.col("b.back")).alias("first"), F.col("b.end").alias("end")))).alias("found")
    )
    none = F.array().cast("array<struct<license:string,share:double,first:int,end:int>>")
    return base.select("row_key", "doc_id").join(found, "row_key", "left").select("row_key", "doc_id", F.coalesce("found", none).alias("found"))


def _window(scale: int):
    return lambda k: F.struct(F.lit(scale).alias("scale"), k.alias("k"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, licences found, and their word spans as license:first:end."""
    spans = F.transform("found", lambda x: F.concat_ws(":", x["license"], x["first"].cast("string"), x["end"].cast("string")))
    return scan(documents(spark, sf_dir)).select(
        "doc_id",
        F.size("found").cast("bigint").alias("n_licenses"),
        F.array_join(F.transform("found", lambda x: x["license"]), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("containment"),
        F.array_join(spans, ",").alias("spans"),
    )
