"""Personal data in whole texts: fixed patterns, then bootstrapped contextual extraction.

Base spans come from four regular expressions and their checks.  They are the
seeds, with long hexadecimal keys as a fifth kind, ``secret``.  Every token
that holds a digit or an @ is a candidate instance.  It has three lexical
patterns: the two tokens before it (lower case, digits as 0, no + or ( at the end) and its shape (digit
runs, mixed runs, punctuation) with its length, the same without the length and
with joined mixed runs as one, and the token before, that shape and the token
after.  Patterns and instances form a
bipartite graph.
Each round a pattern's confidence is the mean confidence of its distinct
instances, and an instance's is 1 - prod(1 - confidence) over its accepted
patterns; seeds stay at 1.  Patterns need ``MIN_SUPPORT`` instances' worth of
evidence and ``MIN_CONFIDENCE``.  Instances that reach ``MIN_CONFIDENCE`` by
accepted patterns, and don't overlap a base span, are added as spans.  A token
that is a whole base span somewhere (a phone's + aside) is added wherever else it
stands outside base spans, with confidence 1.

Only built-in expressions run.  Candidates leave each document as small rows;
counts are aggregated before they are shuffled, so a pattern or value that
holds a third of all candidates costs one row for each task.

Positions are code points.  All regular expressions are written so that no
start inside a run is tried twice: a match starts where the last one ended or
where no character of its first run stands before it, which finds the same
leftmost matches.

Defined results.  A null or empty text has no spans.  Repeated rows, null or
repeated doc_ids are handled row by row; repeated rows count their values once
in the graph.  Other columns are carried along or ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcewise.llm.common import Workspace, documents, let, text_or_empty

#: Fixed patterns by kind, in the order in which spans are listed.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A token with a digit or an @: letters, digits and inner punctuation.
CANDIDATE = r"(?:\G|(?<![A-Za-z0-9]))(?=[^\s0-9@]*+[0-9@])[A-Za-z0-9]++(?:[._@%+:/-]++[A-Za-z0-9]++)*+"
SECRET = "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,64}$"
KINDS = ("email", "ip", "card", "phone", "secret")
ROUNDS, MIN_CONFIDENCE, MIN_SUPPORT, MIN_CHARS = 3, 0.8, 3.0, 6
SPANS = "array<struct<start:bigint,end:bigint,value:string>>"
_BLOCK = 256


def _before(values: Column, zero: Column, op) -> Column:
    """For each element, ``op`` folded over the elements before it, in blocks so that long arrays stay cheap."""

    def of(v: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), ((F.size(v) - 1) / _BLOCK).cast("int")),
            lambda b: F.aggregate(F.slice(v, b * _BLOCK + 1, _BLOCK), zero, op),
        )
        sums = F.aggregate(blocks, F.array(zero), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

        def inner(s: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                b = (i / _BLOCK).cast("int")
                return F.aggregate(F.slice(v, b * _BLOCK + 1, i - b * _BLOCK), F.get(s, b), op)

            return F.transform(v, one)

        return F.when(F.size(v) == 0, v).otherwise(let(sums, inner))

    return let(values, of)


def _located(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` with their code-point spans, and the text since the match before."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,gap:string>>")

    def of(found: Column) -> Column:
        def placed(gaps: Column) -> Column:
            sizes = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("bigint"))

            def spans(before: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    start = F.get(before, i) + F.length(F.get(gaps, i))
                    return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"), F.get(gaps, i).alias("gap"))

                return F.transform(found, one)

            return let(_before(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x), spans)

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), placed))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), of)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def term(c: Column, i: Column) -> Column:
        twice = c.cast("int") * (1 + i % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Array of (start, end, value) of each base kind."""
    none = F.array().cast(SPANS)
    plain = lambda x: F.transform(x, lambda s: F.struct(s["start"], s["end"], s["value"]))

    def kind(needle: Column, pattern: str, valid) -> Column:
        return F.when(needle, plain(F.filter(_located(text, pattern), lambda s: valid(s["value"])))).otherwise(none)

    digit = text.rlike("[0-9]")
    size = lambda v: F.length(_digits(v))
    return {
        "email": kind(F.contains(text, F.lit("@")), EMAIL, lambda v: F.lit(True)),
        "ip": kind(digit, IP, lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": kind(digit, CARD, lambda v: size(v).between(16, 19) & luhn(_digits(v))),
        "phone": kind(F.contains(text, F.lit("+")), PHONE, lambda v: size(v).between(8, 15)),
    }


def candidates(text: Column) -> Column:
    """Tokens with a digit or an @: span, value and patterns."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,patterns:array<string>>>")

    def plain(x: Column) -> Column:
        return F.lower(F.regexp_replace(F.trim(x), "[0-9]", "0"))

    def of(located: Column) -> Column:
        tail = F.substring(text, (F.element_at(located, -1)["end"] + 1).cast("int"), F.lit(48))

        def one(s: Column, i: Column) -> Column:
            words = F.slice(F.concat(F.array(F.lit(""), F.lit("")), F.split(plain(F.regexp_replace(F.substring(s["gap"], -48, 48), r"[\s+(]+$", "")), r"\s+")), -2, 2)
            after = F.when(i + 1 < F.size(located), F.substring(F.get(located, i + 1)["gap"], 1, 48)).otherwise(tail)
            after = F.element_at(F.split(plain(after), r"\s+"), 1)
            shape = F.regexp_replace(F.regexp_replace(s["value"], "(?<![A-Za-z0-9])[0-9]+(?![A-Za-z0-9])", "9"), "[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*", "x")

            def patterns(w: Column) -> Column:
                context = F.array_join(w, " ")
                coarse = F.regexp_replace(shape, "x(?:[._-]++x)++", "x")
                length = F.length(s["value"]).cast("string")
                return F.array(
                    F.concat_ws("\x1f", context, shape, length),
                    F.concat_ws("\x1f", context, coarse),
                    F.concat_ws("\x1f", F.lit("around"), F.get(w, 1), coarse, after),
                )

            return F.struct(s["start"], s["end"], s["value"], let(words, patterns).alias("patterns"))

        return F.when(F.size(located) == 0, none).otherwise(F.filter(F.transform(located, one), lambda s: F.length(s["value"]) >= MIN_CHARS))

    return F.when(text.rlike("[0-9@]"), let(_located(text, CANDIDATE), of)).otherwise(none)


def scan(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Per row: the carried columns as ``row``, base spans by kind, and candidates with their seed kind."""
    text = text_or_empty()
    found = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in carried)).alias("row"),
        *(c.alias(k) for k, c in base_spans(text).items()),
        candidates(text).alias("found"),
    )

    def seeded(c: Column) -> Column:
        kind = F.lit(None).cast("string")
        kind = F.when(c["value"].rlike(SECRET), F.lit("secret")).otherwise(kind)
        sure = F.lit(False)
        for k in ("phone", "card", "ip", "email"):
            over = F.exists(F.col(k), lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
            kind = F.when(over, F.lit(k)).otherwise(kind)
            same = F.exists(F.col(k), lambda s: (c["start"] - s["start"]).between(0, int(k == "phone")) & (s["end"] == c["end"]))
            sure = F.when(over, same).otherwise(sure)
        return c.withField("seed", kind).withField("sure", sure)

    return found.withColumn("found", F.transform("found", seeded)).withColumn("row_key", F.monotonically_increasing_id())


def bootstrap(work: Workspace, occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, confidence) of the values that accepted patterns discover.

    ``occurrences``: value, patterns, seed, sure (the value is a whole base span).
    All joins are on value or pattern, over rows that are already distinct.
    """
    each = occurrences.select("value", F.explode("patterns").alias("pattern"), "seed", "sure")
    edges = work.put(each.groupBy("value", "pattern").agg(F.max("seed").alias("seed"), F.max("sure").alias("sure")), "edges")
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    seeds = edges.where("seed is not null").groupBy("value", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("confidence"))
    known = seeds
    for k in range(rounds):
        support = edges.join(known, "value").groupBy("pattern", "kind").agg(F.sum("confidence").alias("evidence"))
        patterns = (
            support.where(F.col("evidence") >= MIN_SUPPORT)
            .join(totals, "pattern")
            .select("pattern", "kind", (F.col("evidence") / F.col("n")).alias("trust"))
            .where(F.col("trust") >= MIN_CONFIDENCE)
        )
        patterns = work.put(patterns, f"patterns{k}")
        doubt = F.exp(F.sum(F.log(1 - 0.95 * F.least(F.col("trust"), F.lit(1.0)))))
        fresh = edges.where("seed is null").join(patterns, "pattern").groupBy("value", "kind").agg((1 - doubt).alias("confidence"))
        known = work.put(seeds.unionByName(fresh.where(F.col("confidence") > 0.5)), f"known{k}")
    accepted = known.join(seeds.select("value").distinct(), "value", "left_anti").where(F.col("confidence") >= MIN_CONFIDENCE * 0.95)
    best = accepted.groupBy("value").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("confidence"))
    whole = edges.where("seed = 'secret' or sure").groupBy("value").agg(F.max("seed").alias("kind"), F.lit(1.0).alias("confidence"))
    return work.put(best.unionByName(whole), "found")


def detect(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: carried columns as ``row``, base spans by kind, and ``added`` spans with kinds."""
    work = Workspace(docs.sparkSession, "pii")
    scanned = work.put(scan(docs, docs.columns if carried is None else carried), "scanned")
    each = scanned.where(F.size("found") > 0).select("row_key", F.explode("found").alias("c")).select("row_key", "c.*")
    found = bootstrap(work, each)
    fresh = each.where("seed is null or seed = 'secret'").join(found, "value").select("row_key", F.struct("start", "end", "value", "kind").alias("s"))
    added = fresh.groupBy(F.col("row_key").alias("at_key")).agg(F.array_sort(F.collect_set("s")).alias("added"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,kind:string>>")
    return scanned.join(added, F.col("row_key") == F.col("at_key"), "left").select(
        "row", *KINDS[:4], F.coalesce("added", none).alias("added")
    )


def _written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _all_written() -> Column:
    parts = []
    for k in KINDS:
        added = F.transform(F.filter("added", _of_kind(k)), lambda s: F.struct(s["start"], s["end"], s["value"]))
        own = F.array_sort(F.concat(F.col(k), added)) if k in KINDS[:4] else added
        parts.append(_written(k, own))
    return F.array_join(F.concat(*parts), ",")


def _marked(kind: str):
    return lambda s: F.struct(s["start"], (-s["end"]).alias("back"), F.lit(kind).alias("kind"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, as in ``[email]``; null texts stay null.

    Of overlapping spans the first (then the longest) is replaced; the rest of
    a later one that reaches past its end is removed with it.
    """
    found = detect(docs)
    every = F.concat(
        *(F.transform(F.col(k), _marked(k)) for k in KINDS[:4]),
        F.transform("added", lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["kind"])),
    )
    text = F.col("row.text")

    def cut(spans: Column) -> Column:
        def pieces(reach: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                done = F.get(reach, i)
                between = F.substring(text, (done + 1).cast("int"), F.greatest(s["start"] - done, F.lit(0)).cast("int"))
                return F.concat(between, F.when(s["start"] >= done, F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit("")))

            last = F.array_max(F.transform(spans, lambda s: -s["back"]))
            tail = F.substring(text, (last + 1).cast("int"), F.length(text))
            return F.concat(F.array_join(F.transform(spans, piece), ""), tail)

        ends = F.transform(spans, lambda s: -s["back"])
        return let(_before(ends, F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, x)), pieces)

    clean = let(F.array_sort(every), lambda s: F.when(F.size(s) == 0, text).otherwise(cut(s)))
    return found.withColumn("clean", clean).select(
        *((F.col("clean") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns)
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(documents(spark, sf_dir), carried=["doc_id"])
    base = F.array_join(F.concat(*(_written(k, F.col(k)) for k in KINDS[:4])), ",")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:4]),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        _all_written().alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
        (sum((F.size(k) for k in KINDS[:4]), F.size("added")) > 0).alias("has_findings"),
    )
