"""Byte-level BPE encoding and decoding of whole texts.

A task splits its texts by the tokenizer's pattern and keeps every distinct
word once.  It hands on rows of bounded size: the words that are new to the
task, as arrays of bytes with the ranks of their pairs, and for each document the
numbers of its words.  Spark higher-order functions fold the ranked merges over the bytes of each
distinct word.  The state is one long for each piece: the rank of the pair that
starts at the piece, the piece's first byte and the piece's id, so the least
element is the leftmost pair of the lowest rank, and joining it gives the id
that is the rank.  The rank map is a literal: two arrays in which each pair of
ids has one possible slot, so a lookup reads at most two elements (a Spark map
would be searched from its start).  A last pass puts the ids of the words
together and decodes every document from its ids by joining the pieces.

The fold takes n steps over the n bytes of a word, so words of over ``LONG_WORD``
bytes, such as unbroken runs without a space, are merged in the same order by a heap
in the task that splits the texts, in about n log n steps.

There is no shuffle, nothing grows with the corpus, and a lost executor repeats
only its own tasks.

Defined results.  A null or empty text has no ids, and the digests are those of
no bytes.  Rows with null or repeated doc_id each give their row.  An empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcewise.llm.common import documents, let, parts_of

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Words after which a row ends, distinct words after which a task forgets them, input bytes that one task takes.
ROW_WORDS, TASK_WORDS, TASK_BYTES = 250_000, 400_000, 128 << 20
#: Bytes of a word beyond which a heap merges it.
LONG_WORD = 1_000
#: Slots (primes) of the two arrays of the rank map; the rank of a pair that has none.
SLOTS, NONE = (131_101, 149_993), 1 << 20


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    """Byte string to rank, from a tiktoken rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def pair_ranks(path: str) -> dict[int, int]:
    """Rank of each pair of ids that joins to a token; a pair is 65536 * left + right."""
    ranks = ranks_of(path)
    if max(ranks.values()) >= 65_536:
        raise ValueError("ids must fit in 16 bits")
    found = {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
            if left is not None and right is not None:
                found[65_536 * left + right] = rank
    return found


def _slot(pair: int, which: int) -> int:
    """Slot of a pair in an array."""
    return pair % SLOTS[which]


@cache
def rank_arrays(path: str) -> tuple[list[int], list[int]]:
    """Both arrays of the rank map: every pair stands in its slot of one of them, as 65536 * pair + rank."""
    arrays = tuple([-1] * n for n in SLOTS)
    for pair, rank in pair_ranks(path).items():
        moving, which = 65_536 * pair + rank, 0
        for _ in range(10_000):
            at = _slot(moving >> 16, which)
            moving, arrays[which][at] = arrays[which][at], moving
            if moving < 0:
                break
            which = 1 - which
        else:
            raise ValueError("the rank map's slots don't hold these pairs")
    return arrays


def _literal(spark: SparkSession, values: list[int]) -> Column:
    """An array literal of longs, handed to the JVM in one piece."""
    jvm, raw = spark._jvm, np.array(values, ">i8").tobytes()
    longs = spark.sparkContext._gateway.new_array(jvm.long, len(values))
    jvm.java.nio.ByteBuffer.wrap(raw).asLongBuffer().get(longs)
    return Column(jvm.org.apache.spark.sql.functions.lit(longs))


@cache
def byte_pair_ranks(path: str) -> np.ndarray:
    """Rank of each pair of bytes, by left byte and right byte; ``NONE`` where it has none."""
    ranks, pairs = ranks_of(path), pair_ranks(path)
    ids = [ranks[bytes([b])] for b in range(256)]
    return np.array([[pairs.get(65_536 * a + b, NONE) for b in ids] for a in ids], np.int64)


def first_states(raw: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """State of every byte before the first merge, for words that lie one after the other: the rank of the pair that it begins, its place in its word, its id."""
    ranks = ranks_of(path)
    ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    pair = np.full(len(raw), NONE, np.int64)
    pair[:-1] = byte_pair_ranks(path)[raw[:-1], raw[1:]]
    sizes = np.diff(offsets)
    pair[offsets[1:][sizes > 0] - 1] = NONE  # the last byte of a word begins no pair
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], sizes)
    return pair << 40 | place << 16 | ids[raw]


def fold_merges(words: Column, spark: SparkSession, path: str) -> Column:
    """Token ids of each word; a word is the state of its bytes before the first merge (``first_states``).

    The literal stands in the plan once, as plans are also written as text.
    """
    return let(F.array(*(_literal(spark, x) for x in rank_arrays(path))), lambda tables: _fold(words, tables))


def _fold(words: Column, tables: Column) -> Column:
    first, second = tables[0], tables[1]

    def rank(left: Column, right: Column) -> Column:
        def found(pair: Column) -> Column:
            one, two = (F.get(x, (pair % n).cast("int")) for x, n in ((first, SLOTS[0]), (second, SLOTS[1])))
            return (
                F.when(F.shiftright(one, 16) == pair, one.bitwiseAND(65_535))
                .when(F.shiftright(two, 16) == pair, two.bitwiseAND(65_535))
                .otherwise(F.lit(NONE).cast("bigint"))
            )

        return let(left * 65_536 + right, found)

    def packed(pair_rank: Column, rest: Column) -> Column:
        return F.shiftleft(pair_rank, 40).bitwiseOR(rest)

    piece = lambda x: x.bitwiseAND(65_535)
    rest = lambda x: x.bitwiseAND((1 << 40) - 1)

    def merged(state: Column, least: Column) -> Column:
        token = F.shiftright(least, 40)

        def at(p: Column) -> Column:
            def value(x: Column, i: Column) -> Column:
                own = rest(least).bitwiseAND(~65_535).bitwiseOR(token)
                return (
                    F.when(i == p, packed(rank(token, piece(F.get(state, p + 2))), own))
                    .when(i == p - 1, packed(rank(piece(x), token), rest(x)))
                    .otherwise(x)
                )

            return F.transform(F.filter(state, lambda x, i: i != p + 1), value)

        return let((F.array_position(state, least) - 1).cast("int"), at)

    def step(state: Column, _: Column) -> Column:
        return let(F.array_min(state), lambda least: F.when(least >= NONE << 40, state).otherwise(merged(state, least)))

    def of(word: Column) -> Column:
        end = F.aggregate(F.slice(word, F.lit(2), F.size(word)), word, step)
        return F.transform(end, lambda x: piece(x).cast("int"))

    return F.transform(words, of)


def heap_merges(word: list[int], ranks: dict[int, int]) -> list[int]:
    """Token ids of one word, given as its bytes' ids: of the pairs of lowest rank the leftmost is joined, until none has a rank."""
    ids, n = list(word), len(word)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    rank = ranks.get
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(65_536 * ids[i] + ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, left, right = heapq.heappop(heap)
        j = after[i] if ids[i] >= 0 else n
        if j >= n or ids[i] != left or ids[j] != right:
            continue  # one of both has been joined to another piece since
        ids[i], ids[j], after[i] = r, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (x := rank(65_536 * r + ids[after[i]])) is not None:
                heapq.heappush(heap, (x, i, r, ids[after[i]]))
        if before[i] >= 0 and (x := rank(65_536 * ids[before[i]] + r)) is not None:
            heapq.heappush(heap, (x, before[i], ids[before[i]], r))
    return [x for x in ids if x >= 0]


BATCH_SCHEMA = "forget boolean, keys array<bigint>, n_words array<int>, at array<int>, words array<array<bigint>>, long_at array<int>, long_ids array<array<int>>"


def _rows(pattern: str, path: str):
    def gather(batches):
        find = regex.compile(pattern).findall
        ranks, pairs = ranks_of(path), pair_ranks(path)
        byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        number: dict[str, int] = {}
        keys, counts, at, new, forget = [], [], [], [], True

        def row():
            raw = [w.encode("utf-8", "surrogatepass") for w in new]
            long = [i for i, x in enumerate(raw) if len(x) > LONG_WORD]
            merged = [heap_merges(byte_ids[np.frombuffer(raw[i], np.uint8)].tolist(), pairs) for i in long]
            for i in long:
                raw[i] = b""
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int32)
            flat = first_states(np.frombuffer(b"".join(raw), np.uint8), offsets, path)
            words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            whole = pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), words)
            cols = [
                pa.array([forget]),
                pa.array([keys], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int32())),
                pa.array([np.concatenate(at)], pa.list_(pa.int32())),
                whole,
                pa.array([long], pa.list_(pa.int32())),
                pa.array([merged], pa.list_(pa.list_(pa.int32()))),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["forget", "keys", "n_words", "at", "words", "long_at", "long_ids"])

        total = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = find(text or "")
                for w in found:
                    if w not in number:
                        number[w] = len(number)
                        new.append(w)
                keys.append(key)
                counts.append(len(found))
                at.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                total += len(found)
                if total >= ROW_WORDS:
                    yield row()
                    keys, counts, at, new, total, forget = [], [], [], [], 0, False
                    if len(number) >= TASK_WORDS:
                        number, forget = {}, True
        if keys:
            yield row()

    return gather


class _Words:
    """Ids of the words of a task, in the order in which rows bring them."""

    def __init__(self):
        self.flat, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(self, batches):
        """(document keys, word counts, word numbers) of each row, once its words are known."""
        for batch in batches:
            for row in range(batch.num_rows):
                forget, (keys, counts, at, ids) = batch.column(0)[row].as_py(), (batch.column(k)[row].values for k in range(1, 5))
                if forget:
                    self.__init__()
                offsets = ids.offsets.to_numpy().astype(np.int64)
                flat = ids.values.to_numpy(zero_copy_only=False)
                self.starts = np.concatenate((self.starts, offsets[:-1] - offsets[0] + len(self.flat)))
                self.sizes = np.concatenate((self.sizes, np.diff(offsets)))
                self.flat = np.concatenate((self.flat, flat[offsets[0] : offsets[-1]].astype("<u4")))
                first = len(self.starts) - len(offsets) + 1
                for at_word, merged in zip(batch.column(5)[row].as_py(), batch.column(6)[row].values, strict=True):
                    self.starts[first + at_word], self.sizes[first + at_word] = len(self.flat), len(merged)
                    self.flat = np.concatenate((self.flat, merged.values.to_numpy().astype("<u4")))
                yield keys, counts.to_numpy().astype(np.int64), at.to_numpy()

    def ids(self, at: np.ndarray) -> np.ndarray:
        return self.flat[_ragged(self.starts[at], self.sizes[at])]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of runs that begin at ``starts`` and have ``sizes``, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _documents(path: str):
    def assemble(batches):
        pieces = [b""] * (max(ranks_of(path).values()) + 1)
        for piece, rank in ranks_of(path).items():
            pieces[rank] = piece
        words = _Words()
        for keys, counts, at in words.rows(batches):
            ends = np.cumsum(counts)
            n_ids, id_digests, text_digests = [], [], []
            for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                ids = words.ids(at[a:b])
                n_ids.append(len(ids))
                id_digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_digests.append(hashlib.sha256(b"".join([pieces[t] for t in ids.tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [keys.cast(pa.int64()), pa.array(n_ids, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return assemble


def word_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows of a task's documents as word numbers, with the ids of the words that are new to the task.

    Input splits are put together up to ``TASK_BYTES`` a task, as far as all
    cores stay busy: the more text a task has, the fewer of its words are new.
    """
    spark = docs.sparkSession
    plain = docs.select("doc_id", "text")
    tasks = max(2 * spark.sparkContext.defaultParallelism, parts_of(plain, TASK_BYTES))
    rows = plain.coalesce(tasks).mapInArrow(_rows(pattern, path), BATCH_SCHEMA)
    return rows.select("forget", "keys", "n_words", "at", fold_merges(F.col("words"), spark, path).alias("ids"), "long_at", "long_ids")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and array ``ids`` of every document."""

    def rows(batches):
        words = _Words()
        for keys, counts, at in words.rows(batches):
            ids = [words.ids(x) for x in np.split(at, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return word_ids(docs, path, pattern).mapInArrow(rows, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with binary column ``bytes``: the pieces of its ids, joined by a literal array."""
    ranks = ranks_of(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    hexes = let(table, lambda t: F.transform("ids", lambda i: F.get(t, i)))
    return encoded.withColumn("bytes", F.unhex(F.array_join(hexes, "")))


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Token count and the digests of ids and decoded bytes of every document."""
    path = path or public_tokenizers.path(RANKS)
    rows = word_ids(docs, path, pattern or public_tokenizers.PATTERN)
    return rows.mapInArrow(_documents(path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
