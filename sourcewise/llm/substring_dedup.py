"""Substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of each text: the hash of a position is
the sum of table values of the last 32 bytes, each shifted by its distance, so
it depends on those bytes alone.  A chunk ends at the least hash from
``LEAST`` to ``LEAST + SPAN`` bytes on, the first of equals, and never inside a
character.  An insertion moves the cuts near it only, and text that repeats a few
words is cut at the same phase wherever it stands.

Chunks are deduplicated by a 64-bit digest: one aggregate per digest gives the
number of occurrences, whether they stand in several documents, and the first
place (least doc_id, then position), and is joined back to the occurrences.  A chunk
that holds a third of all rows is one partial row per task in the aggregate, and
is joined by broadcast, not by a shuffle.  Where a
repeated chunk has a neighbour that is no copy, its text is compared with the
text beside the first occurrence, to the first difference: the characters that
agree belong to the run, over first occurrences too.  ``BEFORE`` and ``AFTER`` characters travel with each
such chunk; where all of them agree, the two whole texts are compared.  The first
occurrence is extended as far as any copy whose run ends at that chunk agrees.

Neighbouring repeated chunks, so extended, form runs; runs of at least ``RUN_WORDS``
words or ``RUN`` code points (51 words have more) and runs over a whole text are
reported, so short common phrases and chance digests are left alone.  ``shared``
runs repeat in another document; ``removed`` ones repeat anywhere, as lines do in
one text.  A copied passage is missed only if its two copies share no chunk.

Defined results.  Null and empty texts have no chunks and no runs.  Every row
counts as a document: an exact copy is one run over the whole text, however short.
Rows with null doc_id come last in the order.  Other columns are carried or
ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcewise.llm.common import Workspace, documents, join_uneven, let

LEAST, BITS, RUN_WORDS, RUN = 16, 4, 50, 100
#: Occurrences of a chunk from which it may count as hot.
HOT_CHUNKS = 20_000
SPAN, BEFORE, AFTER = 32, 192, 64
MOST = LEAST + SPAN
_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**32, 256, np.uint32)
_PAD = 32
_BLANK = np.isin(np.arange(256), [0, 9, 10, 11, 12, 13, 32])
CHUNKED = "row_key bigint, doc_id bigint, n_chars bigint, ends array<int>, words array<int>, digests array<bigint>, text string"
EDGES = "digest bigint, row_key bigint, i int, first boolean, start int, end int, room_before int, room_after int, before string, after string"
REACH = "row_key bigint, i int, first_key bigint, first_i int, l int, r int, start int, end int, first_start int, first_end int, room_before int, room_after int, l_words int, r_words int, open boolean"


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte over the 32 bytes that end there."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        later = h[k:] + (h[:-k] << np.uint32(k))
        h = np.concatenate((h[:k], later))
    return h


def cut(data: np.ndarray, candidates: np.ndarray, rank: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of one text, in bytes; candidates are the sorted positions after which the hash is low."""
    n, at, ends = len(data), 0, []
    rank = gear(data) if rank is None else rank
    starts_char = (data & 0xC0) != 0x80
    wanted, ranks = candidates.tolist(), rank[candidates - 1].tolist()
    i = 0
    while n - at > LEAST:
        while i < len(wanted) and wanted[i] < at + LEAST:
            i += 1
        last, best, k = at + LEAST + SPAN, -1, i
        while k < len(wanted) and wanted[k] <= last:
            if best < 0 or ranks[k] < ranks[best]:
                best = k
            k += 1
        if best >= 0:
            end = wanted[best]
        else:
            end = n if last > n else at + LEAST + int(rank[at + LEAST - 1 : last].argmin())
        while end < n and not starts_char[end]:
            end += 1
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def _chunks(batches):
    mask = np.uint32((1 << BITS) - 1) << np.uint32(32 - BITS)
    for batch in batches:
        for i in range(0, batch.num_rows, 300):
            part = batch.slice(i, 300)
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()]
            sizes = np.array([len(x) for x in raw], np.int64)
            every = np.frombuffer(b"".join(bytes(_PAD) + x for x in raw), np.uint8)
            rank = gear(every)
            hot = np.flatnonzero((rank & mask) == 0) + 1
            starts = np.cumsum(sizes + _PAD) - sizes
            first, last = np.searchsorted(hot, starts, "right"), np.searchsorted(hot, starts + sizes, "right")
            blank = _BLANK[every]
            begun = np.concatenate(([0], np.cumsum(~blank[1:] & blank[:-1])))  # words begun up to each byte; texts stand behind zero bytes
            chars, all_ends, all_words, digests = [], [], [], []
            for k, x in enumerate(raw):
                data = every[starts[k] : starts[k] + sizes[k]]
                ends = cut(data, hot[first[k] : last[k]] - starts[k], rank[starts[k] : starts[k] + sizes[k]])
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                chars.append(int(points[-1]))
                all_ends.append(points[ends].astype(np.int32))
                all_words.append((begun[starts[k] + np.array(ends, np.int64) - 1] - begun[starts[k] - 1]).astype(np.int32) if ends else np.zeros(0, np.int32))
                digests.append([xxhash.xxh3_64_intdigest(x[a:b]) for a, b in zip([0, *ends], ends, strict=False)])
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in digests])))
            flat = np.array([v for x in digests for v in x], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1).cast(pa.int64()), pa.array(chars, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(all_ends), pa.int32())),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(all_words), pa.int32())),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64())),
                    part.column(2).cast(pa.string()),
                ],
                names=["row_key", "doc_id", "n_chars", "ends", "words", "digests", "text"],
            )


def chunked(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (row_key, doc_id, text): its chunks' ends in code points, digests and its text."""
    return docs.select("row_key", "doc_id", "text").mapInArrow(_chunks, CHUNKED)


def _same(a: str, b: str) -> int:
    """How many characters agree from the start."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def _begun(text: str) -> int:
    """Words that begin in a text, but for one at its very start, which may go on from before."""
    return len(text.split()) - (text[:1].strip() != "")


def _table(rows: list[tuple], like: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [x.split() for x in like.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _walls(marks: list[dict], places: list[tuple[int, int]], size: int) -> tuple[list[int], list[int]]:
    """How far each repeated chunk may go on: to the next one on either side that is a copy too.

    A first occurrence is no wall, nor, for a chunk that repeats another row, one
    that repeats its own text only.
    """
    sides = []
    for order, edge, far in ((range(len(marks)), 0, 1), (range(len(marks) - 1, -1, -1), size, 0)):
        own = row = edge
        found = [edge] * len(marks)
        for k in order:
            found[k] = row if marks[k]["across"] else own
            if not marks[k]["first"]:
                own = places[k][far]
                row = own if marks[k]["across"] else row
        sides.append(found)
    return sides[0], sides[1]


def _edges(batches):
    """Repeated chunks beside text that isn't repeated, and all first occurrences, with the text around them."""
    for batch in batches:
        for at in range(0, batch.num_rows, 300):
            rows = []
            for key, ends, digests, text, marks in zip(*(c.to_pylist() for c in batch.slice(at, 300).columns), strict=True):
                places = [(ends[m["i"] - 1] if m["i"] else 0, ends[m["i"]]) for m in marks]
                left, right = _walls(marks, places, len(text))
                for m, (start, end), wall, stop in zip(marks, places, left, right, strict=True):
                    before, after = start - wall, stop - end
                    if m["first"]:
                        sides = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
                    elif before or after:
                        sides = text[start - min(before, BEFORE) : start], text[end : end + min(after, AFTER)]
                    else:
                        continue
                    rows.append((digests[m["i"]], key, m["i"], m["first"], start, end, before, after, *sides))
            yield _table(rows, EDGES)


def _reach(batches):
    """How far the text beside a repeated chunk agrees with that beside its first occurrence; open where more could."""
    for batch in batches:
        rows = []
        for *place, before, after, first_before, first_after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            l, r = _same(before[::-1], first_before[::-1]), _same(after, first_after)  # noqa: E741
            more = l == BEFORE < place[-2] or r == AFTER < place[-1]
            rows.append((*place[:4], l, r, *place[4:], len(before[len(before) - l :].split()), _begun(after[:r]), more))
        yield _table(rows, REACH)


def _far_reach(batches):
    """The same for whole texts, a pair at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            *place, text, first = (c[at].as_py() for c in batch.columns)
            start, end, first_start, first_end, before, after = place[4:]
            l, r = _same(text[start - before : start][::-1], first[:first_start][::-1]), _same(text[end : end + after], first[first_end:])  # noqa: E741
            yield _table([(*place[:4], l, r, *place[4:], len(text[start - l : start].split()), _begun(text[end : end + r]), False)], REACH)


def extended(work: Workspace, table: DataFrame, marks: DataFrame) -> DataFrame:
    """(at_key, reach): by row, how far its repeated chunks (i) go on to the left (l) and right (r)."""
    met = table.join(marks, F.col("row_key") == F.col("at_key"))
    edges = work.put(met.select("row_key", "ends", "digests", "text", "marks").mapInArrow(_edges, EDGES), "edges")
    firsts = edges.where("first").select("digest", *(F.col(c).alias(f"first_{c}") for c in ("row_key", "i", "start", "end", "before", "after")))
    place = ["row_key", "i", F.col("first_row_key").alias("first_key"), "first_i", "start", "end", "first_start", "first_end", "room_before", "room_after"]
    pairs = edges.where("not first").join(firsts, "digest").select(*place, "before", "after", "first_before", "first_after")
    near = work.put(pairs.mapInArrow(_reach, REACH), "near")
    work.drop("edges")
    rest = near.where("open").drop("l", "r", "l_words", "r_words", "open")
    texts = table.select(F.col("row_key").alias("text_key"), "text")
    both = rest.join(texts, F.col("row_key") == F.col("text_key")).drop("text_key").join(texts.withColumnRenamed("text", "first_text"), F.col("first_key") == F.col("text_key")).drop("text_key")
    reach = work.put(near.where("not open").unionByName(both.mapInArrow(_far_reach, REACH)), "reach")
    work.drop("near")
    sides = ["l", "r", "l_words", "r_words"]
    first = reach.groupBy("first_key", "first_i").agg(*(F.max(c).alias(c) for c in sides)).toDF("at_key", "i", *sides)
    every = reach.select(F.col("row_key").alias("at_key"), "i", *sides).unionByName(first).where("l > 0 or r > 0")
    return every.groupBy("at_key").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct(*sides)))).alias("reach"))


def _runs(chunks: Column, size: Column) -> Column:
    """Chunks (start, end, words) that meet, joined to spans that are long enough or over the whole text."""
    begins = F.filter(F.transform(chunks, lambda c, i: F.when((i == 0) | (c["start"] > F.get(chunks, i - 1)["end"]), i)), lambda i: i.isNotNull())

    def joined(at: Column) -> Column:
        def one(begin: Column, k: Column) -> Column:
            own = F.slice(chunks, begin + 1, F.coalesce(F.get(at, k + 1), F.size(chunks)) - begin)
            return F.struct(
                F.get(chunks, begin)["start"].alias("start"), F.try_element_at(own, F.lit(-1))["end"].alias("end"),
                F.aggregate(own, F.lit(0), lambda n, c: n + c["words"]).alias("words"),
            )

        return F.transform(at, one)

    long = lambda s: (s["words"] >= RUN_WORDS) | (s["end"] - s["start"] >= RUN) | ((s["start"] == 0) & (s["end"] == size))
    return F.transform(F.filter(let(begins, joined), long), lambda s: F.struct(s["start"], s["end"]))


def repeats(work: Workspace, keyed: DataFrame) -> DataFrame:
    """(row_key, doc_id, n_chars, n_chunks, n_shared, shared, removed) of every row.

    ``shared`` are runs of chunks that occur in another row too, and ``removed``
    runs of chunks that are not the first occurrence of all.
    """
    table = work.put(chunked(keyed), "chunked")
    each = table.select("row_key", "doc_id", F.posexplode(F.arrays_zip("digests", "ends")).alias("i", "c")).select(
        "row_key", "doc_id", "i", F.col("c.digests").alias("digest")
    )
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "i")
    repeated = each.groupBy("digest").agg(F.count(F.lit(1)).alias("k"), F.min(place).alias("first"), (F.min("row_key") < F.max("row_key")).alias("across")).where("k > 1")
    repeated = work.put(repeated.select("digest", "k", "across", F.col("first.row_key").alias("first_key"), F.col("first.i").alias("first_i")), "repeated")
    again = join_uneven(each.select("row_key", "i", "digest"), repeated, "digest", "k", HOT_CHUNKS)
    again = again.select("row_key", F.struct("i", ((F.col("first_key") == F.col("row_key")) & (F.col("first_i") == F.col("i"))).alias("first"), "across").alias("x"))
    marks = work.put(again.groupBy(F.col("row_key").alias("at_key")).agg(F.array_sort(F.collect_list("x")).alias("marks")), "marks", "repeated")
    none = F.array().cast("array<struct<i:int,first:boolean,across:boolean>>")
    marked = marks.join(extended(work, table, marks), "at_key", "left")
    whole = table.drop("text").join(marked, F.col("row_key") == F.col("at_key"), "left").withColumn("marks", F.coalesce("marks", none))

    def start(m: Column) -> Column:
        return F.when(m["i"] == 0, 0).otherwise(F.get("ends", m["i"] - 1))

    def placed(of: Column) -> Column:
        """Chunks with their extensions, each up to its neighbours among ``of``; words of an extension that is cut short don't count."""

        def one(m: Column, k: Column) -> Column:
            more = F.try_element_at("reach", m["i"])
            least = F.when(k == 0, 0).otherwise(F.get("ends", F.get(of, k - 1)["i"]))
            most = F.coalesce(start(F.get(of, k + 1)), F.col("n_chars").cast("int"))
            begin, end = start(m) - F.coalesce(more["l"], F.lit(0)), F.get("ends", m["i"]) + F.coalesce(more["r"], F.lit(0))
            words = F.get("words", m["i"]) - F.when(m["i"] == 0, 0).otherwise(F.get("words", m["i"] - 1))
            words += F.when(begin >= least, F.coalesce(more["l_words"], F.lit(0))).otherwise(0) + F.when(end <= most, F.coalesce(more["r_words"], F.lit(0))).otherwise(0)
            return F.struct(F.greatest(begin, least).alias("start"), F.least(end, most).alias("end"), words.alias("words"))

        return F.transform(of, one)

    def found(kind) -> Column:
        return let(F.filter("marks", kind), lambda of: let(placed(of), lambda c: _runs(c, size)))

    size = F.col("n_chars").cast("int")
    return whole.select(
        "row_key", "doc_id", "n_chars", F.size("digests").cast("bigint").alias("n_chunks"), F.size("marks").cast("bigint").alias("n_shared"),
        found(lambda x: x["across"]).alias("shared"), found(lambda x: ~x["first"]).alias("removed"),
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated passages: every run but its first occurrence is cut from ``text``."""
    work = Workspace(docs.sparkSession, "substring-dedup")
    stored = work.put(docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")), "stored")
    found = repeats(work, stored.select("row_key", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")))
    text = F.col("row.text")

    def kept(spans: Column) -> Column:
        part = F.transform(spans, lambda s, i: let(F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"]), lambda a: F.substring(text, a + 1, s["start"] - a)))
        return F.concat(F.array_join(part, ""), F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text)))

    some = found.where(F.size("removed") > 0).select("row_key", "removed")
    clean = F.when(F.col("removed").isNull(), text).otherwise(kept(F.col("removed")))
    return stored.join(some, "row_key", "left").withColumn("clean", clean).select(*((F.col("clean") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def _length(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def _written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: repeated passages as start:end (code points), all of them and those cut, and their lengths."""
    work = Workspace(spark, "substring-dedup")
    found = repeats(work, documents(spark, sf_dir).select("doc_id", "text", F.monotonically_increasing_id().alias("row_key")))
    return found.select(
        "doc_id", "n_chars", "n_chunks", "n_shared",
        (F.size("shared") > 0).alias("has_repeat"), _length("shared").alias("shared_chars"), _length("removed").alias("removed_chars"),
        _written("shared").alias("shared_spans"), _written("removed").alias("removed_spans"),
    )
