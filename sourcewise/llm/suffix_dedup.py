"""Repeats of at least ``LEAST`` bytes by an enhanced suffix array in buckets.

Texts are packed into shards of ``SHARD_BYTES`` or more.  Every window of ``LEAST``
bytes is keyed by the least hash of its ``GRAM``-byte pieces, so equal windows have
equal keys wherever they stand, and neighbouring windows mostly share theirs: a
text is a row of segments, each the windows in a row that share a key.  A shard
sends each distinct key once; keys that occur twice or more go back to their
shards, and only their segments are sorted.

A bucket is the suffixes of the segments of one key.  It is an enhanced suffix
array: suffixes are grouped by their first ``LEAST`` bytes (those whose left
neighbours all agree belong to a longer repeat and are set aside), sorted by the
rest, and the common prefixes of neighbours are scanned with a stack, which gives
the tree of common-prefix intervals.  An interval whose suffixes have different
bytes to their left, or begin a segment, is a repeat; it is handed on with all its
occurrences.  A key with over ``HOT`` occurrences has its windows as buckets of
their own, so a bucket holds ``HOT`` segments at most, or one row per shard.

``repeats`` joins the pieces of one repeat over the segments: pieces with the same
occurrences, side by side, are one.  A repeat of which a part stands in more
places than the whole comes in parts, each with all the places of that part.  A
stretch that repeats a few bytes over and over is one key throughout: it is cut
every ``RUN`` windows, and ``repeats`` tells its parts apart at these cuts only.
``removed`` cuts what also starts in a row with a smaller id.

Defined results.  Null and empty texts have no bytes and no windows; texts under
``LEAST`` bytes have no repeats.  A null doc_id counts as the greatest one, so
rows without an id lose what any other row holds, and nothing to each other; so do
rows of one doc_id.  Texts of any length are taken whole.  Empty tables give no
rows.  Other columns are ignored whatever their names.  Windows are told apart by
two 64-bit hashes (key and window); what follows them is compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcewise.llm.common import Workspace, documents, parts_of

LEAST, GRAM = 50, 16
#: A shard has the first many bytes at least and the second at most (or one text); between them, so many shards a table.
SHARD_BYTES, MOST_SHARD_BYTES, SHARD_COUNT, HOT = 384 << 10, 64 << 20, 50_000, 20_000
#: Windows of a segment at most, windows that are hashed at once, rows of the suffix array that are sorted at once.
RUN, BLOCK, SORTED_ROWS = 64, 1 << 17, 10_000
#: Texts are cut in so many slices of the shards, one after the other, so a part of them is on its way at a time.
SLICES = 2
LAST = (1 << 63) - 1
SHARDS = "shard bigint, ids array<bigint>, ends array<int>, data binary"
KEYS = "key bigint, shard bigint, j int, c int"
MARKED = "shard bigint, ids array<bigint>, ends array<int>, data binary, starts array<int>, sizes array<int>, keys array<bigint>, fine array<boolean>"
SEGMENTS = "key bigint, piece binary, shard bigint, j int, n int, least bigint, most bigint"
PIECES = "shard bigint, j int, start int, end int, least bigint, piece_id bigint"
REMOVED = "doc_id bigint, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary"
PLACES = "piece_id bigint, shard bigint, at int, size int, doc_id bigint, row int, start int"

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the ``size`` bytes from each place on; the hash of a power of two comes from two halves."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    half = (data.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    half ^= half >> np.uint64(29)
    whole, at, step, left = None, 0, 1, size
    while left:
        if left & 1:
            whole = half[at : at + n].copy() if whole is None else whole * _ODD[3] + half[at : at + n]
            at += step
        left >>= 1
        if left:
            half = half[:-step] * (_ODD[1] + np.uint64(2 * step)) + half[step:]
            half ^= half >> np.uint64(32)
            step *= 2
    whole *= _ODD[2]
    whole ^= whole >> np.uint64(31)
    return whole


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row."""
    n, step = len(values) - width + 1, 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[:n], values[width - step : width - step + n])


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, windows, keys) of the segments of a shard; none spans two texts."""
    n = len(data) - LEAST + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = np.concatenate([lowest(hashes(data[a : min(a + BLOCK, n) + LEAST - 1], GRAM), LEAST - GRAM + 1) for a in range(0, n, BLOCK)])
    inside = np.ones(n, bool)
    for back in range(1, LEAST):
        at = ends - back
        inside[at[(at >= 0) & (at < n)]] = False
    same = inside[1:] & inside[:-1] & (key[1:] == key[:-1])
    first = np.flatnonzero(inside & np.concatenate(([True], ~same)))
    last = np.flatnonzero(inside & np.concatenate((~same, [True])))
    parts = (last - first) // RUN + 1
    begun = np.cumsum(parts) - parts
    starts = np.repeat(first, parts) + RUN * (np.arange(parts.sum()) - np.repeat(begun, parts))
    sizes = np.minimum(np.repeat(last, parts) + 1 - starts, RUN)
    return starts, sizes, key[starts]


def _packed(batches, most: int):
    """Shards in the order of the rows; a shard has one text at least."""
    part, k = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0

    def shard():
        ends = np.cumsum([len(t) for t in texts])
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 24) + k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends.astype(np.int32)], pa.list_(pa.int32())), pa.array([b"".join(texts)], pa.binary())],
            names=["shard", "ids", "ends", "data"],
        )

    for batch in batches:
        for row, text in zip(batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1), strict=True):
            raw = text.as_py()
            ids.append(row)
            texts.append((raw or "").encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size >= most or len(ids) >= 1 << 16:
                yield shard()
                ids, texts, size, k = [], [], 0, k + 1
    if ids:
        yield shard()


def _rows(batches):
    """The rows of batches, one by one: a row holds a whole shard."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield [c[k] for c in batch.columns]


def _numbers(value) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.zeros(0, np.int64)


def _bytes(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8)


def _keys(batches):
    for shard, ends, data in _rows(batches):
        keys, count = np.unique(segments(_bytes(data), _numbers(ends))[2], return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), shard.as_py())), pa.array(np.arange(len(keys), dtype=np.int32)), pa.array(count.astype(np.int32))],
            names=["key", "shard", "j", "c"],
        )


def _marked(batches):
    """The shards with those of their segments whose keys are repeated."""
    for shard, ids, ends, data, js, fine in _rows(batches):
        starts, sizes, keys = segments(_bytes(data), _numbers(ends))
        every, place = np.unique(keys, return_inverse=True)
        state = np.zeros(len(every), np.int8)
        state[_numbers(js)] = 1 + _numbers(fine).astype(np.int8)
        state = state[place] if len(place) else state
        kept = state > 0
        lists = [starts[kept].astype(np.int32), sizes[kept].astype(np.int32), keys[kept].view(np.int64), state[kept] > 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard.as_py()]), pa.array([ids.as_py()], pa.list_(pa.int64())), pa.array([_numbers(ends)], pa.list_(pa.int32())), pa.array([data.as_py()], pa.binary()),
             *(pa.array([x], pa.list_(t)) for x, t in zip(lists, (pa.int32(), pa.int32(), pa.int64(), pa.bool_()), strict=True))],
            names=[x.split()[0] for x in MARKED.split(", ")],
        )


def distinct(ids, ends, data, starts, sizes, keys, fine):
    """Of a marked shard: (key, piece) of its distinct pieces, and of every occurrence its piece, place and row.

    Segments of hot keys are cut into their windows.
    """
    raw, hot = _bytes(data), _numbers(fine).astype(bool)
    starts, sizes = _numbers(starts).astype(np.int64), _numbers(sizes).astype(np.int64)
    keys = _numbers(keys) if keys.is_valid else np.zeros(len(starts), np.int64)
    cut = np.where(hot, sizes, 1)
    offset = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
    at, size, key = np.repeat(starts, cut) + offset, np.where(np.repeat(hot, cut), 1, np.repeat(sizes, cut)), np.repeat(keys, cut)
    if hot.any():
        many = np.repeat(hot, cut)
        key = key.copy()
        every = np.concatenate([hashes(raw[a : a + BLOCK + LEAST - 1], LEAST) for a in range(0, len(raw) - LEAST + 1, BLOCK)])
        key[many] = every[at[many]].view(np.int64)
    buffer, found = memoryview(raw), {}
    piece = np.array([found.setdefault((k, bytes(buffer[a:b])), len(found)) for k, a, b in zip(key.tolist(), at.tolist(), (at + size + LEAST - 1).tolist(), strict=True)], np.int64)
    row = np.searchsorted(_numbers(ends), at, "right")
    return list(found), piece, at, row


def _ranks(ids) -> np.ndarray:
    return np.array([LAST if x is None else x for x in ids.as_py()], np.int64)


def _segments(batches):
    """The distinct pieces of each shard."""
    for shard, ids, ends, data, *marks in _rows(batches):
        found, piece, _, row = distinct(ids, ends, data, *marks)
        rank = _ranks(ids)[row] if len(row) else np.zeros(0, np.int64)
        least, most = np.full(len(found), LAST), np.full(len(found), -LAST - 1)
        np.minimum.at(least, piece, rank)
        np.maximum.at(most, piece, rank)
        n = np.bincount(piece, minlength=len(found)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary()), pa.array(np.full(len(found), shard.as_py())),
             pa.array(np.arange(len(found), dtype=np.int32)), pa.array(n), pa.array(least), pa.array(most)],
            names=[x.split()[0] for x in SEGMENTS.split(", ")],
        )


def intervals(lcp: list[int], first: int, last: int):
    """(length, left, right) of the common-prefix intervals of suffixes ``first`` to ``last``; lcp[i] is between i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(first + 1, last + 2):
        depth, left = (lcp[i], i - 1) if i <= last else (-1, i - 1)
        while stack and stack[-1][0] > depth:
            length, left = stack.pop()
            yield length, left, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))


def _joined(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` bytes the spans cover."""
    return np.cumsum(np.bincount(begin, minlength=n) - np.bincount(end, minlength=n)) > 0


def runs(row, start, end, low, size, least, most):
    """Fewer spans (row, start, end, low) that cut the same bytes from every occurrence of the rows.

    A row is among the places of its repeats, so ``low`` is its own least id or a
    smaller one.  What stands at a smaller id goes from all its occurrences, be the
    id what it may (``-LAST - 1``); the rest goes from all but those of its least id.
    """
    first = np.concatenate(([0], np.cumsum(size + 1)))  # a byte between rows keeps their runs apart
    n, begin, end = int(first[-1]) + 1, first[row] + start, first[row] + end
    smaller, own = low < least[row], low < most[row]
    sure, cut = _joined(begin[smaller], end[smaller], n), _joined(begin[own], end[own], n)
    out = []
    for cover, more in ((sure, False), (cut, True)):
        edges = np.flatnonzero(np.diff(cover.view(np.int8), prepend=np.int8(0)))
        a, b = edges[::2], edges[1::2]
        if more:
            known = np.concatenate(([0], np.cumsum(sure)))
            new = known[b] - known[a] < b - a
            a, b = a[new], b[new]
        r = np.searchsorted(first, a, "right") - 1
        out.append((r, a - first[r], b - first[r], least[r] if more else np.full(len(r), -LAST - 1)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def tree(keys, data, offsets, n, least, most, every: bool):
    """Repeats in the suffixes of many rows: (row, start, end, least id, repeat) of each row that holds one.

    Rows stand sorted by key.  Without ``every``, only rows from which something is
    to be removed are given, as ``runs``.
    """
    size = np.diff(offsets) - LEAST + 1
    row = np.repeat(np.arange(len(size)), size)
    o = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = offsets[:-1][row] + o
    window = hashes(data, LEAST)[at] + keys.view(np.uint64)[row] * _ODD[0]
    order = np.argsort(window)
    window = window[order]
    begin = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
    left = np.where(o > 0, data[at - 1].astype(np.int16), np.int16(256))[order]
    high = np.maximum.reduceat(left, begin)
    diverse = (high == 256) | (high != np.minimum.reduceat(left, begin))
    who = row[order]
    if every:
        repeated = np.add.reduceat(n[who], begin) > 1
    else:
        repeated = np.minimum.reduceat(least[who], begin) < np.maximum.reduceat(most[who], begin)
    count = np.diff(np.append(begin, len(order)))
    kept = np.repeat(diverse & repeated, count)
    group = np.repeat(np.arange(len(begin)), count)[kept]
    order, left = order[kept], left[kept]
    if not len(order):
        return (np.zeros(0, np.int64),) * 5
    rest = offsets[row[order] + 1] - at[order] - LEAST
    wide = -(-max(int(rest.max()), 1) // 8) * 8
    cell = np.arange(wide)
    tail = np.concatenate((data, np.zeros(wide + LEAST, np.uint8)))[(at[order] + LEAST)[:, None] + cell]
    tail[cell >= rest[:, None]] = 0
    words = tail.view(">u8").astype(np.uint64)
    rank = np.lexsort((rest, *words.T[::-1], group))
    order, left, rest, group, tail = order[rank], left[rank], rest[rank], group[rank], tail[rank]
    differ = tail[1:] != tail[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), wide)
    lcp = np.concatenate(([0], np.minimum(lcp, np.minimum(rest[1:], rest[:-1]))))
    ends = np.flatnonzero(np.concatenate((group[1:] != group[:-1], [True])))
    steps, several = lcp.tolist(), (n[row[order]] > 1).tolist()
    found, first = [], 0
    turns = np.concatenate(([0], np.cumsum((left[1:] != left[:-1]) | (left[1:] == 256)))).tolist()
    opening, full = (left == 256).tolist(), rest.tolist()
    for last in ends.tolist():
        for length, a, b in intervals(steps, first, last):
            if opening[a] or turns[b] > turns[a]:
                found.append((length, a, b))
        for i in range(first, last + 1):
            if several[i] and opening[i] and full[i] > max(steps[i] if i > first else -1, steps[i + 1] if i < last else -1):
                found.append((full[i], i, i))
        first = last + 1
    length, a, b = np.array(found, np.int64).reshape(-1, 3).T
    lows = np.append(least[row[order]], LAST)
    low = np.minimum.reduceat(lows, np.stack((a, b + 1), 1).ravel())[::2] if len(a) else np.zeros(0, np.int64)
    span = b - a + 1
    member = np.repeat(a, span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
    suffix, start = order[member], o[order[member]]
    name = (hashes(data, LEAST)[at[order[a]]] * _ODD[1] + keys.view(np.uint64)[row[order[a]]] * _ODD[3] + length.astype(np.uint64) * _ODD[2]).view(np.int64)
    # repeats that share their first bytes and length differ in what lies between
    if every:
        name ^= np.fromiter((xxhash.xxh3_64_intdigest(tail[k, :s].tobytes()) for k, s in zip(a.tolist(), length.tolist(), strict=True)), np.uint64, len(a)).view(np.int64)
    out = row[suffix], start, start + np.repeat(length, span) + LEAST, np.repeat(low, span), np.repeat(name, span)
    if every:
        return out
    r, start, end, low, _ = out
    r, start, end, low = runs(r, start, end, low, np.diff(offsets), least, most)
    return r, start, end, low, np.zeros(len(r), np.int64)


def _tree(every: bool):
    names = [x.split()[0] for x in PIECES.split(", ")]

    def whole_buckets(batches):
        """Tables that end with a bucket, as rows come sorted by key."""
        held = []
        for batch in batches:
            for at in range(0, batch.num_rows, SORTED_ROWS):
                held.append(batch.slice(at, SORTED_ROWS))
                if sum(x.num_rows for x in held) < SORTED_ROWS:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                keys = table.column(0).to_numpy()
                end = int(np.searchsorted(keys, keys[-1]))
                if end:
                    yield table.slice(0, end)
                held = table.slice(end).to_batches()
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        for table in whole_buckets(batches):
            table = table.combine_chunks()
            if not table.num_rows:
                continue
            pieces = table.column(1).combine_chunks()
            pieces = pieces.chunk(0) if isinstance(pieces, pa.ChunkedArray) else pieces
            ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
            data = np.frombuffer(pieces.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            key, shard, j, n, least, most = (table.column(k).to_numpy() for k in (0, 2, 3, 4, 5, 6))
            r, a, b, low, name = tree(key, data, ends - ends[0], n, least, most, every)
            yield pa.RecordBatch.from_arrays([pa.array(shard[r]), pa.array(j[r]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(low), pa.array(name)], names=names)

    return run


def _removed(batches):
    """The bytes of each text that stand in a row with a smaller id, and the others."""
    for _, ids, ends, data, *marks, js, froms, tos, lows in _rows(batches):
        raw, last, rank = _bytes(data), _numbers(ends), _ranks(ids)
        cover = np.zeros(len(raw) + 1, np.int32)
        j = _numbers(js).astype(np.int64)
        if len(j):
            found, piece, at, row = distinct(ids, ends, data, *marks)
            order = np.argsort(j, kind="stable")
            j, a, b, low = j[order], _numbers(froms)[order], _numbers(tos)[order], _numbers(lows)[order]
            first = np.searchsorted(j, np.arange(len(found) + 1))
            count = np.diff(first)[piece]
            which = np.repeat(first[piece], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            whose = np.repeat(np.arange(len(piece)), count)
            cut = low[which] < rank[row[whose]]
            which, whose = which[cut], whose[cut]
            np.add.at(cover, at[whose] + a[which], 1)
            np.add.at(cover, at[whose] + b[which], -1)
        gone = np.cumsum(cover[:-1]) > 0
        rows = []
        for key, begin, end in zip(ids.as_py(), [0, *last[:-1].tolist()], last.tolist(), strict=True):
            own = gone[begin:end]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
            spans = [{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
            rows.append((key, end - begin, spans, raw[begin:end][~own].tobytes() if spans else raw[begin:end].tobytes()))
        kinds = pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "spans", "kept"])


def _places(batches):
    """Every occurrence of the pieces of repeats."""
    for shard, ids, ends, data, *marks, js, froms, tos, names in _rows(batches):
        found, piece, at, row = distinct(ids, ends, data, *marks)
        j, a, b, name = _numbers(js).astype(np.int64), _numbers(froms), _numbers(tos), _numbers(names)
        order = np.argsort(j, kind="stable")
        j, a, b, name = j[order], a[order], b[order], name[order]
        first = np.searchsorted(j, np.arange(len(found) + 1))
        count = np.diff(first)[piece]
        which = np.repeat(first[piece], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        whose = np.repeat(np.arange(len(piece)), count)
        begin, r = at[whose] + a[which], row[whose]
        base = np.concatenate(([0], _numbers(ends)[:-1]))[r]
        kinds = [x.split()[1] for x in PLACES.split(", ")]
        columns = name[which], np.full(len(which), shard.as_py()), begin, (b - a)[which], None, r, begin - base
        doc_ids = ids.as_py()
        yield pa.RecordBatch.from_arrays(
            [pa.array([doc_ids[x] for x in r.tolist()], pa.int64()) if c is None else pa.array(c.astype(np.int64 if k == "bigint" else np.int32)) for c, k in zip(columns, kinds, strict=True)],
            names=[x.split()[0] for x in PLACES.split(", ")],
        )


def marked(work: Workspace, docs: DataFrame) -> DataFrame:
    """The shards of ``docs`` (doc_id, text) with the segments whose keys stand in two places or more."""
    most = max(SHARD_BYTES, min(MOST_SHARD_BYTES, parts_of(docs, SHARD_COUNT)))
    shards = _put(work, docs.select("doc_id", "text").mapInArrow(lambda batches: _packed(batches, most), SHARDS), "shards")
    keys = shards.select("shard", "ends", "data").mapInArrow(_keys, KEYS)
    met = keys.withColumn("n", F.sum("c").over(Window.partitionBy("key"))).where("n > 1")
    back = met.groupBy("shard").agg(F.collect_list(F.struct("j", (F.col("n") > HOT).alias("fine"))).alias("x"))
    back = _put(work, back.select("shard", F.col("x.j").alias("js"), F.col("x.fine").alias("fine")), "back")
    return _put(work, shards.join(back, "shard", "left").select("shard", "ids", "ends", "data", "js", "fine").mapInArrow(_marked, MARKED), "marked", "shards", "back")


def pieces(work: Workspace, shards: DataFrame, every: bool, column: str) -> DataFrame:
    """Repeats within segments, by shard: arrays of distinct piece, start, end, and ``column`` (least id or repeat)."""
    names = ["j", "start", "end", column]
    each = shards.mapInArrow(_segments, SEGMENTS).repartition("key").sortWithinPartitions("key").mapInArrow(_tree(every), PIECES)
    each = _put(work, each.select("shard", *names), "pieces")
    found = each.groupBy("shard").agg(F.collect_list(F.struct(*names)).alias("x")).select("shard", *(F.col(f"x.{c}").alias(f"x_{c}") for c in names))
    return _put(work, found, "found", "pieces")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _put(work: Workspace, df: DataFrame, name: str, *used: str) -> DataFrame:
    """``work.put`` with small Arrow batches, as a row holds a whole shard."""
    before = work.spark.conf.get(_BATCH)
    work.spark.conf.set(_BATCH, "8m")
    try:
        return work.put(df, name, *used)
    finally:
        work.spark.conf.set(_BATCH, before)


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: the spans of bytes that repeat a row with a smaller id, and the bytes that stay."""
    work = Workspace(docs.sparkSession, "suffix-dedup")
    shards = marked(work, docs)
    found = pieces(work, shards, False, "least")
    # pieces are told apart by their bytes alone, so the keys may stay behind
    bare = shards.withColumn("keys", F.lit(None).cast("array<bigint>"))
    done = []
    for part in range(SLICES):
        own = F.pmod(F.xxhash64("shard"), F.lit(SLICES)) == part
        both = bare.where(own).join(found.where(own), "shard", "left").select(*shards.columns, "x_j", "x_start", "x_end", "x_least")
        done.append(_put(work, both.mapInArrow(_removed, REMOVED), f"removed-{part}"))
    work.drop("marked")
    work.drop("found")
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out


def repeats(docs: DataFrame) -> DataFrame:
    """(repeat, length, n_places, doc_id, shard, row, start): every maximal repeat with all its occurrences.

    ``shard`` and ``row`` tell rows of one id apart; ``start`` and ``length`` are in bytes.
    """
    work = Workspace(docs.sparkSession, "suffix-repeats")
    shards = marked(work, docs)
    found = pieces(work, shards, True, "piece_id")
    both = shards.join(found, "shard").select(*shards.columns, "x_j", "x_start", "x_end", "x_piece_id")
    places = work.put(both.mapInArrow(_places, PLACES), "places")
    where = F.struct("shard", "row", "start")
    first = places.groupBy("piece_id", "size").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n_places"))
    near = places.select("piece_id", "size", F.xxhash64("shard", "row").alias("h"), "start").join(first, ["piece_id", "size"])
    apart = F.xxhash64("h", F.col("start") - F.col("first.start")).cast("decimal(38,0)")
    shape = near.groupBy("piece_id", "size", "first", "n_places").agg(F.sum(apart).alias("shape"))
    same = Window.partitionBy("first.shard", "first.row", "n_places", "shape").orderBy("first.start", "size", "piece_id")
    reach = F.max(F.col("first.start") + F.col("size")).over(same.rowsBetween(Window.unboundedPreceding, -1))
    chained = shape.withColumn("new", F.when(F.col("first.start") + LEAST - 1 <= reach, 0).otherwise(1)).withColumn("k", F.sum("new").over(same))
    chain = Window.partitionBy("first.shard", "first.row", "n_places", "shape", "k")
    length = (F.max(F.col("first.start") + F.col("size")).over(chain) - F.min("first.start").over(chain)).alias("length")
    heads = chained.select("piece_id", "size", "new", "n_places", length).where("new = 1").drop("new")
    return places.join(heads, ["piece_id", "size"]).select(F.xxhash64("piece_id", "size").alias("repeat"), "length", "n_places", "doc_id", "shard", "row", "start")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes removed, runs of them, and the digest of what stays."""
    found = removed(documents(spark, sf_dir))
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as pairs of hexadecimal digits, flagged where an earlier id holds the same one; touching windows form a run.
OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, 9223372036854775807) AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
 w AS (SELECT k, r, p, md5(substr(x, 2 * p + 1, 100)) AS h FROM d, unnest(range(0, greatest(length(x) // 2 - 49, 0))) AS u(p)),
 least_id AS (SELECT h, min(r) AS low FROM w GROUP BY h HAVING count(*) > 1),
 hit AS (SELECT k, p FROM w JOIN least_id USING (h) WHERE low < r),
 step AS (SELECT k, p, CASE WHEN p - lag(p) OVER (PARTITION BY k ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM hit),
 run AS (SELECT k, p, sum(new) OVER (PARTITION BY k ORDER BY p) AS i FROM step),
 span AS (SELECT k, i, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY k, i),
 part AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM span),
 kept AS (SELECT k, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS parts, max(b) AS last FROM part JOIN d USING (k) GROUP BY k)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(coalesce(parts, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""
