"""Token-id files with a minimal perfect hash index, read back by key.

Documents are range-partitioned and sorted by doc_id, encoded, and written as
raw files: a file holds blocks, a block holds a header, its document keys, their
end offsets, and the ids of all its documents as unsigned 16-bit integers (32
bits for larger vocabularies).  Spark's text writer puts the bytes down, so
tasks commit their files as for any table, on any store that Spark can write,
and a lost executor leaves no half-written file behind.  Rows of one key may
stand in several blocks and files, so no key is too frequent.

The index hashes every distinct key to a bucket of bounded size, and each bucket
stores a minimal perfect hash of its keys: a displacement for each small group
of keys places every key in a slot of its own, with no slot left over.  A slot
stores a 32-bit fingerprint of its key and where the key's rows stand: file, byte
offset of the block, place in the block, number of rows.  A keyed read takes one
displacement and one slot, goes to the block's bytes, compares the stored key and
takes the ids between two end offsets, so an absent key is always told.

The ids are those of the plain library: a special token's string in a text
becomes its id, as the tokenizer file says.

Defined results.  A null or empty text has the end id alone.  Rows of one
doc_id stand next to each other, in the order of their text digests; null ids
come first, have no slot, as they are no keys, and are read by their places.  An
empty table gives no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import struct

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcewise.llm.common import Workspace, documents, freed, parts_of

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Bytes of input for each file, tokens after which a block ends, words that a worker remembers, keys in an index bucket.
FILE_BYTES, BLOCK_TOKENS, CACHE_WORDS, BUCKET_KEYS = 16 << 20, 1_000_000, 200_000, 20_000
#: Texts that are encoded together; their words are numbered.
TEXTS = 500
#: New words are encoded this many at a time, joined by spaces and told apart by offsets (those of letters by the ids that end a word); not so
#: those with characters from the first combining mark on, which normalisation may move.
JOINED, FIRST_MARK = 256, "\u0300"
#: Block header: magic, bytes of an id, documents, ids.
HEADER = struct.Struct("<4sIQQ")
MAGIC = b"TIDS"

_tokenizers: dict[str, tuple[object, dict[str, bytes], list[str], np.ndarray]] = {}


#: A word that ends in an ASCII letter and one of these is split between them by the tokenizer, so it is looked up as two.
STOPS = (".", ",")


def _of_letters(tokenizer):
    """The tokenizer without the steps that leave small letters before ``FIRST_MARK`` as they are, and which ids end a word; (None, None) if it has others."""
    from tokenizers import Tokenizer, pre_tokenizers

    steps, suffix = json.loads(tokenizer.to_str()), getattr(tokenizer.model, "end_of_word_suffix", None)
    kinds = [[x["type"] for x in (steps[k] or {}).get(f"{k.replace('_', '')}s", [])] for k in ("normalizer", "pre_tokenizer")]
    if kinds != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] or not suffix:
        return None, None
    light, ends = Tokenizer(tokenizer.model), np.zeros(tokenizer.get_vocab_size(), bool)
    light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends[[i for w, i in tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
    return light, ends


def _encoder(path: str):
    """Function from texts to their ids (arrays of unsigned 32 bits), remembering words between the batches of a worker.

    The tokenizer drops white space and never joins across a space, so the ids
    of a text are those of its space-separated words, one after the other: Arrow
    numbers the words of a batch, each distinct one is looked up once, and its ids
    are put wherever it stands.  Texts that hold the string of a special token are
    encoded whole.
    """
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _tokenizers[path] = (tokenizer, {}, [t.content for t in tokenizer.get_added_tokens_decoder().values()], *_of_letters(tokenizer))
    tokenizer, known, special, light, ends_word = _tokenizers[path]
    whole = lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4")
    parts = lambda words: [words[i : i + JOINED] for i in range(0, len(words), JOINED)]

    def keep(part: list[str], ids: np.ndarray, at: np.ndarray) -> None:
        raw, at = ids.tobytes(), (4 * at).tolist()
        known.update(zip(part, [raw[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))

    def by_offsets(words: list[str]) -> None:
        for part, e in zip(parts(words), tokenizer.encode_batch([" ".join(p) for p in parts(words)], add_special_tokens=False), strict=True):
            begins, offsets = np.cumsum([0] + [len(w) + 1 for w in part]), np.array([a for a, _ in e.offsets], np.int64)
            keep(part, np.array(e.ids, "<u4"), np.searchsorted(offsets, begins))

    def by_ends(words: list[str]) -> None:
        joined = [" ".join(p).lower() for p in parts(words)]
        for part, e in zip(parts(words), light.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            keep(part, ids, np.append(0, np.flatnonzero(ends_word[ids]) + 1))

    def learn(new: set[str]) -> None:
        low = {w for w in new if w.isascii() or max(w) < FIRST_MARK}
        letters = [w for w in low if w.isalpha() and (w.isascii() or w.lower().isalpha())] if light else []
        marked = list(new.difference(low))
        if letters:
            by_ends(letters)
        by_offsets(list(low.difference(letters)))
        for w, e in zip(marked, tokenizer.encode_batch(marked, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()

    def ids_of(words: list[str]) -> list[bytes]:
        if len(known) > CACHE_WORDS:
            known.clear()
        known[""] = b""
        stopped, plain = [], []
        for w in words:
            if w not in known:
                (stopped if w.endswith(STOPS) and w[-2:-1].isalpha() and w[-2:-1].isascii() else plain).append(w)
        learn({w[:-1] for w in stopped}.union(plain, STOPS if stopped else ()).difference(known))
        parted = {w: known[w[:-1]] + known[w[-1]] for w in stopped}
        return [parted[w] if w in parted else known[w] for w in words]

    def encode(texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        odd = np.zeros(len(texts), bool)
        for x in special:
            odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(~odd), texts, ""), "\n", " "), " ")
        coded = pc.list_flatten(split).dictionary_encode()
        found = ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.array([len(x) for x in found], np.int64) // 4
        first, code = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        ends = np.append(0, np.cumsum(sizes[code]))
        at = np.arange(ends[-1], dtype=np.int64)
        at += np.repeat(first[code] - ends[:-1], sizes[code])
        ids = np.frombuffer(b"".join(found), "<u4")[at]
        bounds = ends[split.offsets.to_numpy()].tolist()
        return [whole(texts[i].as_py()) if odd[i] else ids[a:b] for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]

    return encode


def pack(keys: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """One block: header, keys, null flags, end offsets, raw ids."""
    ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
    known = np.array([0 if k is None else k for k in keys], "<i8")
    null = np.array([k is None for k in keys], np.uint8)
    raw = np.concatenate(ids).astype(f"<u{width}")
    return b"".join([HEADER.pack(MAGIC, width, len(keys), len(raw)), known.tobytes(), null.tobytes(), ends.astype("<i8").tobytes(), raw.tobytes()])


def unpack(content: memoryview, at: int):
    """(keys, null flags, end offsets, ids, where the next block begins) of the block at a byte offset of a file."""
    magic, width, n, n_ids = HEADER.unpack_from(content, at)
    if magic != MAGIC:
        raise ValueError("no block starts here")
    at += HEADER.size
    keys = np.frombuffer(content, "<i8", n, at)
    null = np.frombuffer(content, np.uint8, n, at + 8 * n)
    ends = np.frombuffer(content, "<i8", n, at + 9 * n)
    ids = np.frombuffer(content, f"<u{width}", n_ids, at + 17 * n)
    return keys, null.astype(bool), ends, ids, at + 17 * n + width * n_ids + 1  # the writer ends each row with a line feed


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """Write the id files of ``docs`` below ``folder``, in ascending doc_id order over the files' names."""
    files = parts_of(docs, FILE_BYTES)

    def blocks(batches):
        from tokenizers import Tokenizer

        width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 65_536 else 4
        encode = _encoder(path)
        keys, ids, total = [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                keys += part.column(0).to_pylist()
                new = [np.append(x, end_id).astype(f"<u{width}") for x in encode(part.column(1))]
                ids += new
                total += sum(map(len, new))
                if total >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_arrays([pa.array([pack(keys, ids, width)], pa.binary())], names=["block"])
                    keys, ids, total = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([pack(keys, ids, width)], pa.binary())], names=["block"])

    tie = F.xxhash64("text")
    keyed = docs.select("doc_id", "text", tie.alias("tie"), F.monotonically_increasing_id().alias("row_key"))  # the row key lets equal rows part
    ordered = keyed.repartitionByRange(files, "doc_id", "tie", "row_key").sortWithinPartitions("doc_id", "tie", "row_key")
    rows = ordered.select("doc_id", "text").mapInArrow(blocks, "block binary")
    rows.select(F.col("block").cast("string")).write.mode("overwrite").text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of the id files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "content")


RUNS = "doc_id bigint, file int, at bigint, place int, rows int, n_ids bigint"


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring rows of one key in a block: the key, where they stand, how many rows and ids."""

    def each(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content, at = memoryview(content.as_buffer()), 0
                while at < len(content):
                    keys, null, ends, _, after = unpack(content, at)
                    new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (null[1:] != null[:-1]))))
                    stop = np.append(new[1:], len(keys))
                    sizes = ends[stop - 1] - np.where(new > 0, ends[new - 1], 0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[new], pa.int64(), mask=null[new]), pa.array(np.full(len(new), file, np.int32)), pa.array(np.full(len(new), at, np.int64)),
                            pa.array(new.astype(np.int32)), pa.array((stop - new).astype(np.int32)), pa.array(sizes.astype(np.int64)),
                        ],
                        names=["doc_id", "file", "at", "place", "rows", "n_ids"],
                    )
                    at = after

    return _files(spark, folder).mapInArrow(each, RUNS)


#: Files whose blocks are summed in one task.
SPAN = 1024


def bases(found: DataFrame) -> DataFrame:
    """(file, at, base): ids before each block.  Sums run within spans of files, and over the sums of the spans."""
    blocks = found.groupBy("file", "at").agg(F.sum("n_ids").alias("n")).withColumn("span", F.floor(F.col("file") / SPAN))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = blocks.groupBy("span").agg(F.sum("n").alias("n"))
    spans = spans.select("span", before(Window.orderBy("span")).alias("first"))
    own = blocks.withColumn("inner", before(Window.partitionBy("span").orderBy("file", "at")))
    return own.join(spans, "span").select("file", "at", (F.col("first") + F.col("inner")).alias("base"))


# The index


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of key and seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _slots(keys: np.ndarray, shift: np.ndarray, m: int) -> np.ndarray:
    """Slot of each key under its group's displacement; a negative displacement names the slot."""
    with np.errstate(over="ignore"):
        hashed = (_mix(keys, 2) + shift.astype(np.uint64) * (_mix(keys, 3) | np.uint64(1))) >> np.uint64(11)
    return np.where(shift < 0, -shift - 1, (hashed % np.uint64(m)).astype(np.int64))


#: Slots that the groups of one size try at once.
TRIES = 50_000


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """Displacements that place the distinct ``keys`` in slots 0..m-1, one to one."""
    m = len(keys)
    n_groups = max(1, m // 4)
    group = (_mix(keys, 1) % np.uint64(n_groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=n_groups))
    sizes = np.diff(np.concatenate(([0], ends)))
    shifts, taken = np.zeros(n_groups, np.int64), np.zeros(m, bool)
    for size in range(int(sizes.max()), 1, -1):
        left = np.flatnonzero(sizes == size)
        own = keys[order[(ends[left] - size)[:, None] + np.arange(size)]]
        base, stride = _mix(own, 2), _mix(own, 3) | np.uint64(1)
        first = np.zeros(len(left), np.int64)
        while len(left):
            # all groups of this size try some displacements at once; of those that want one slot the first takes it
            each = np.arange(len(left))
            tries = first[:, None] + np.arange(min(1024, max(8, TRIES // (len(left) * size))))
            with np.errstate(over="ignore"):
                at = (((base[:, None, :] + tries[:, :, None].astype(np.uint64) * stride[:, None, :]) >> np.uint64(11)) % np.uint64(m)).astype(np.int64)
            fit = ~taken[at].any(axis=2) & (np.diff(np.sort(at, axis=2), axis=2) != 0).all(axis=2)
            k = fit.argmax(axis=1)
            some, wanted = fit[each, k], at[each, k]
            owner = np.full(m, len(left))
            np.minimum.at(owner, wanted[some].ravel(), np.repeat(each[some], size))
            won = some & (owner[wanted] == each[:, None]).all(axis=1)
            shifts[left[won]] = tries[each, k][won]
            taken[wanted[won]] = True
            first = np.where(some, first + k + 1, first + tries.shape[1])[~won]
            left, own, base, stride = left[~won], own[~won], base[~won], stride[~won]
    singles = np.flatnonzero(sizes == 1)
    shifts[singles] = -np.flatnonzero(~taken)[: len(singles)] - 1
    return shifts


INDEX_SCHEMA = "bucket bigint, m int, shifts binary, prints binary, first binary, file binary, at binary, place binary, rows binary"
PLACES = "doc_id bigint, file int, at bigint, place int, rows int"
_KINDS = {"file": "<i4", "at": "<i8", "place": "<i4", "rows": "<i4"}


def _buckets(n_keys: int) -> int:
    return max(1, n_keys // BUCKET_KEYS)


def build_index(found: DataFrame, n_keys: int) -> DataFrame:
    """One row per bucket: its perfect hash, the slots' fingerprints, and the places of each slot's key from ``first`` on."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys, run_key = np.unique(rows["doc_id"].to_numpy(np.int64), return_inverse=True)
        m = len(keys)
        shifts = perfect_hash(keys)
        slot = _slots(keys, shifts[(_mix(keys, 1) % np.uint64(len(shifts))).astype(np.int64)], m)
        prints = np.zeros(m, "<u4")
        prints[slot] = (_mix(keys, 4) >> np.uint64(32)).astype("<u4")
        of = slot[run_key]
        order = np.lexsort((rows["place"], rows["at"], rows["file"], of))
        first = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=m)))).astype("<i4")
        stored = {c: [rows[c].to_numpy()[order].astype(k).tobytes()] for c, k in _KINDS.items()}
        return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "m": [m], "shifts": [shifts.astype("<i8").tobytes()], "prints": [prints.tobytes()], "first": [first.tobytes()], **stored})

    keyed = found.where("doc_id is not null").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(_buckets(n_keys))))
    return keyed.select("bucket", "doc_id", *_KINDS).groupBy("bucket").applyInPandas(build, INDEX_SCHEMA)


def lookup(index: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """Places of the rows of every distinct key; each key reads one displacement and one slot."""
    wanted = keys.where("doc_id is not null").select("doc_id").distinct().withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(_buckets(n_keys))))

    def find(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(rows):
            return pd.DataFrame({"doc_id": np.zeros(0, np.int64), **{c: np.zeros(0, k) for c, k in _KINDS.items()}})
        x = own.iloc[0]
        shifts, prints, first = np.frombuffer(x["shifts"], "<i8"), np.frombuffer(x["prints"], "<u4"), np.frombuffer(x["first"], "<i4")
        doc = rows["doc_id"].to_numpy(np.int64)
        slot = _slots(doc, shifts[(_mix(doc, 1) % np.uint64(len(shifts))).astype(np.int64)], int(x["m"]))
        known = prints[slot] == (_mix(doc, 4) >> np.uint64(32)).astype("<u4")
        doc, slot = doc[known], slot[known]
        n = first[slot + 1] - first[slot]
        at = np.repeat(first[slot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return pd.DataFrame({"doc_id": np.repeat(doc, n), **{c: np.frombuffer(x[c], k)[at] for c, k in _KINDS.items()}})

    return wanted.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, PLACES)


FETCHED = "doc_id bigint, file int, at bigint, inner bigint, ids binary"


def fetch(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    """The rows at ``places``: doc_id, file, block, position in the block's ids, and ids (little-endian unsigned 32 bits).

    A file's bytes meet the places wanted in it; each place is gone to directly,
    and left out if another key is stored there.
    """
    wanted = places.groupBy("file").agg(F.collect_list(F.struct("doc_id", "at", "place", "rows")).alias("wanted"))

    def take(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file, content = batch.column(0)[i].as_py(), memoryview(batch.column(1)[i].as_buffer())
                one = batch.column(2)[i].values
                columns = [one.field(k).to_pylist() for k in range(4)]
                blocks, out, size = {}, [], 0
                for key, at, place, rows in sorted(zip(*columns, strict=True), key=lambda x: x[1:]):
                    if at not in blocks:
                        blocks = {at: unpack(content, at)}
                    keys, null, ends, ids, _ = blocks[at]
                    for p in range(place, min(place + rows, len(keys))):
                        if (None if null[p] else int(keys[p])) == key:
                            begin = int(ends[p - 1]) if p else 0
                            out.append((key, file, at, begin, ids[begin : int(ends[p])].astype("<u4").tobytes()))
                            size += len(out[-1][-1])
                    if size > 4 << 20:
                        yield _rows(out)
                        out, size = [], 0
                yield _rows(out)

    return _files(spark, folder).join(wanted, "file").select("file", "content", "wanted").mapInArrow(take, FETCHED)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [()] * 5
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "file", "at", "inner", "ids"])


def stored(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Write ``docs``, build the index, and read every document back by its key."""
    spark = docs.sparkSession
    work = Workspace(spark, "token-files")
    folder = folder or f"{work.path}/ids"
    with freed(spark):
        write(docs, folder, path)
    found = work.put(runs(spark, folder), "runs")
    n_keys = found.count()
    starts = work.put(bases(found), "bases")
    index = work.put(build_index(found, n_keys), "index")
    places = lookup(index, docs.select("doc_id"), n_keys).unionByName(found.where("doc_id is null").select("doc_id", *_KINDS))
    read = fetch(spark, folder, places).select("doc_id", "file", "at", "inner", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return read.join(starts, ["file", "at"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
