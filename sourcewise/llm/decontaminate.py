"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` walks the documents once.  A task gathers documents into
shards of bounded size and inverts each: for every word of the shard, the
sorted positions at which it occurs.  A shard is one row of a stored table, so
the index is spread over the cluster, is never shuffled, and no word's list
grows past what one shard holds.  It knows nothing of any benchmark: one index
serves all of them, block by block.

``search`` reads the index back.  The words of a benchmark's windows get their
numbers of occurrences in the whole corpus.  In a shard, only windows whose
rarest word occurs there are looked at: the lists are taken from that word on,
shifted by the word's offset in the window, and intersected.  An exact match has
every word in its place.  A proximity match has, for some place of the window,
every word within ``slop`` words of its own place, in the same document.

Words: A-Z are lower-cased, and a word is a run of characters other than
U+0000-002F, U+003A-0060 and U+007B-007F.  In UTF-8 these are the bytes 0-9,
a-z and 80-FF, so a byte table and a split find them.

Defined results.  A null or empty text has no words: n_words 0, nothing hit.
A benchmark item without words has no window.  Items with null ids are
searched, and their id is written as ``null``.  Repeated documents each get
their row; repeated items count once per distinct item_id.  Empty tables give no
rows, or rows without hits.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcewise.llm.common import Workspace, documents, text_or_empty

WINDOW, SLOP, SHARE = 13, 2, 20
#: Characters of text in a shard, and documents in it, before the next begins.
SHARD_CHARS, SHARD_DOCS = 12_000_000, 20_000
#: Benchmark words of one search (about 100 bytes each on the driver and in each worker); more are searched block by block.
BLOCK_WORDS = 2_000_000
#: Contaminated documents up to which their keys (8 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_KEYS = 200_000
_TABLE = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)
#: ``terms``: the shard's words, joined by spaces; ``sizes``: how often each occurs; ``steps``: differences of the
#: positions (word numbers in the shard), word by word.
INDEX_SCHEMA = "keys array<bigint>, n_words array<int>, terms binary, sizes array<int>, steps array<int>"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Queries:
    """The windows of a block of benchmark items over numbered terms: what a search ships to the workers."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.term: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.term.setdefault(w, len(self.term)) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add("null" if item is None else str(item))
        self.windows = list(found)
        self.items = [sorted(found[w]) for w in self.windows]

    def by_rarest(self, frequency: np.ndarray) -> dict[int, list[tuple]]:
        """Windows by their rarest term, as (terms, offsets, length, items), rarest first; windows of terms that never occur are left out."""
        out: dict[int, list[tuple]] = {}
        n = frequency.tolist()
        for w, own in zip(self.windows, self.items, strict=True):
            order = sorted(range(len(w)), key=lambda i: (n[w[i]], w[i], i))
            if n[w[order[0]]]:
                out.setdefault(w[order[0]], []).append(([w[i] for i in order], order, len(w), own))
        return out


class _Numbers(dict):
    """Number of each word, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _invert(batches):
    number, keys, words, counts, chars = _Numbers(), [], [], [], 0

    def shard():
        every = np.concatenate(words)
        order = np.argsort(every, kind="stable").astype(np.int32)
        sizes = np.bincount(every, minlength=len(number)).astype(np.int32)
        steps = np.diff(order, prepend=np.int32(0))
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        return pa.RecordBatch.from_arrays(
            [one(keys, pa.int64()), one(counts, pa.int32()), pa.array([b" ".join(number)], pa.binary()), one(sizes, pa.int32()), one(steps, pa.int32())],
            names=["keys", "n_words", "terms", "sizes", "steps"],
        )

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = words_of(text)
            keys.append(key)
            counts.append(len(own))
            words.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
            chars += len(text or "")
            if chars >= SHARD_CHARS or len(keys) >= SHARD_DOCS:
                yield shard()
                number, keys, words, counts, chars = _Numbers(), [], [], [], 0
    if keys:
        yield shard()


def build_index(work: Workspace, docs: DataFrame, key: str = "doc_id", name: str = "index") -> DataFrame:
    """The stored index of ``docs``: one row per shard, with its documents' keys and word counts and all its positional lists."""
    rows = docs.select(key, "text").mapInArrow(_invert, INDEX_SCHEMA)
    return work.put(rows.withColumn("shard", F.monotonically_increasing_id()), name)


def term_frequency(index: DataFrame, term: dict[bytes, int]) -> np.ndarray:
    """Occurrences of each benchmark term in the corpus; at most one row a term reaches the driver."""

    def counts(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids = [term.get(t, -1) for t in batch.column(0)[row].as_py().split()]
                at = np.array(ids, np.int64)
                known = np.flatnonzero(at >= 0)
                sizes = batch.column(1)[row].values.to_numpy()[known]
                yield pa.RecordBatch.from_arrays([pa.array(at[known]), pa.array(sizes, pa.int64())], names=["t", "n"])

    rows = index.select("terms", "sizes").mapInArrow(counts, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(term), np.int64)
    for t, n in rows:
        out[t] = n
    return out


def _near(positions: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each range from ``low`` to ``high``, whether the sorted list has a position in it."""
    i = np.searchsorted(positions, low)
    return (i < len(positions)) & (positions[np.minimum(i, len(positions) - 1)] <= high)


def phrase_starts(lists: list[np.ndarray], offsets: list[int], begins: np.ndarray, ends: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of exact matches, and (starts, documents) of proximity matches, exact ones among them.

    Lists and offsets come rarest first; ``begins`` and ``ends`` are the
    documents' bounds.  The rarest word of a proximity match stands within
    ``slop`` of its place, so other words are within twice that of where it
    puts them, which leaves few places to look at closely.
    """
    length = len(offsets)
    doc = np.searchsorted(begins, lists[0], "right") - 1
    starts = lists[0].astype(np.int64) - offsets[0]
    for positions, offset in zip(lists[1:], offsets[1:], strict=True):
        if not len(starts):
            break
        at = starts + offset
        keep = _near(positions, np.maximum(at - 2 * slop, begins[doc]), np.minimum(at + 2 * slop, ends[doc] - 1))
        starts, doc = starts[keep], doc[keep]
    exact = starts[(starts >= begins[doc]) & (starts + length <= ends[doc])]
    for positions, offset in zip(lists, offsets, strict=True):
        exact = exact[_near(positions, exact + offset, exact + offset)] if len(exact) else exact
    places = np.unique(np.stack([np.repeat(doc, 2 * slop + 1), (starts[:, None] + np.arange(-slop, slop + 1)).ravel()], 1), axis=0) if len(starts) else np.zeros((0, 2), np.int64)
    doc, starts = places[:, 0], places[:, 1]
    for positions, offset in zip(lists, offsets, strict=True):
        if not len(starts):
            break
        at = starts + offset
        keep = _near(positions, np.maximum(at - slop, begins[doc]), np.minimum(at + slop, ends[doc] - 1))
        starts, doc = starts[keep], doc[keep]
    return exact, starts, doc


HITS_SCHEMA = "shard bigint, place int, spans array<struct<a:int,b:int>>, items array<string>, near array<string>"


def _search(queries: Queries, frequency: np.ndarray, slop: int):
    plans, term = queries.by_rarest(frequency), queries.term

    def look(batches):
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            for row in range(batch.num_rows):
                counts, sizes, steps = (batch.column(k)[row].values.to_numpy() for k in (1, 3, 4))
                positions, stops = np.cumsum(steps, dtype=np.int64), np.cumsum(sizes)
                found = ((term[t], i) for i, t in enumerate(batch.column(2)[row].as_py().split()) if t in term)
                lists = {t: positions[stops[i] - sizes[i] : stops[i]] for t, i in found}
                ends = np.cumsum(counts, dtype=np.int64)
                begins = ends - counts
                # Documents without words begin where the next one does; the last of equal beginnings holds the position.
                spans, hits, near = {}, {}, {}
                for rarest in plans.keys() & lists.keys():
                    for ids, offsets, length, own in plans[rarest]:
                        if not all(t in lists for t in ids):
                            continue
                        exact, loose, docs = phrase_starts([lists[t] for t in ids], offsets, begins, ends, slop)
                        for d in np.unique(docs).tolist():
                            near.setdefault(d, set()).update(own)
                        for x in exact.tolist():
                            d = int(np.searchsorted(begins, x, "right")) - 1
                            p = x - int(begins[d])
                            spans.setdefault(d, []).append((p, p + length))
                            hits.setdefault(d, set()).update(own)
                order = sorted(near)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[row].as_py()] * len(order), pa.int64()),
                        pa.array(order, pa.int32()),
                        pa.array([[{"a": a, "b": b} for a, b in _union(spans.get(d, []))] for d in order], kind),
                        pa.array([sorted(hits.get(d, ())) for d in order], pa.list_(pa.string())),
                        pa.array([sorted(near[d]) for d in order], pa.list_(pa.string())),
                    ],
                    names=["shard", "place", "spans", "items", "near"],
                )

    return look


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def search(index: DataFrame, queries: Queries, slop: int = SLOP) -> DataFrame:
    """Documents with a match, by shard and place in it: merged word spans of exact matches, and the items matched exactly and nearly."""
    look = _search(queries, term_frequency(index, queries.term), slop)
    return index.select("shard", "n_words", "terms", "sizes", "steps").mapInArrow(look, HITS_SCHEMA)


def _blocks(items, most: int):
    """Items in blocks of about ``most`` words; only one block is held at a time."""
    block, n = [], 0
    for item in items:
        k = len(words_of(item[1]))
        if block and n + k > most:
            yield block
            block, n = [], 0
        block.append((item[0], item[1]))
        n += k
    if block:
        yield block


def matches(work: Workspace, index: DataFrame, benchmark: DataFrame, slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per indexed document: key, n_words, merged spans of exact matches, items, and items with a proximity match only."""
    spark, hits = index.sparkSession, None
    for k, block in enumerate(_blocks(benchmark.select("item_id", "text").toLocalIterator(), block_words)):
        found = work.put(search(index, Queries(block), slop), f"hits{k}")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], HITS_SCHEMA)
    # Spans of one document from all blocks: sorted, then folded into their union.
    none = F.array().cast("array<struct<a:int,b:int>>")
    united = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        none,
        lambda acc, s: F.when(
            s["a"] <= F.try_element_at(acc, F.lit(-1))["b"],
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(acc, F.lit(-1))["b"], s["b"]).alias("b"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    whole = hits.groupBy("shard", "place").agg(united.alias("spans"), every("items").alias("items"), every("near").alias("near"))
    docs = index.select("shard", F.posexplode(F.arrays_zip("keys", "n_words")).alias("place", "d"))
    strings = F.array().cast("array<string>")
    return docs.join(whole, ["shard", "place"], "left").select(
        F.col("d.keys").alias("key"), F.col("d.n_words").cast("bigint").alias("n_words"),
        F.coalesce("spans", none).alias("spans"), F.coalesce("items", strings).alias("items"),
        F.coalesce(F.array_except("near", "items"), strings).alias("near"),
    )


def contamination(found: DataFrame) -> DataFrame:
    """The contract's columns from ``matches``: hit words, items, their digest, the verdict; n_near: items near to a passage only."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"])
    return found.select("key", "n_words", n_hit.alias("n_hit"), "items", "near").select(
        F.col("key").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).alias("contaminated"),
        F.size("near").cast("bigint").alias("n_near"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents, with their own columns.

    The verdict depends on the text alone, so texts are known by 64-bit hashes;
    a clean one goes by mistake with a chance of 2**-64 for each contaminated one.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    name = next(c for c in ("text_key" + "_" * n for n in range(len(docs.columns) + 1)) if c.lower() not in {x.lower() for x in docs.columns})
    key = F.xxhash64(text_or_empty()).alias(name)
    index = build_index(work, docs.select(key, "text"), name)
    bad = contamination(matches(work, index, benchmark)).where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    bad = work.put(bad, "bad", "index")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad
    return docs.withColumn(name, key).join(bad, name, "left_anti").drop(name)


#: The rows of ``op6_decontaminate`` by plain window matching; proximity matches are looked for around each window's rarest word.
OP6_SQL = r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, list_slice(w, i, i + least(13, len(w)) - 1) AS win FROM bi),
lens AS (SELECT DISTINCT len(win) AS n FROM bw),
di AS (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= n),
hits AS (SELECT k, i, n, item FROM (SELECT k, i, n, list_slice(w, i, i + n - 1) AS win FROM di) JOIN bw USING (win)),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hits) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k),
dp AS (SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
freq AS (SELECT word, count(*) AS n FROM dp GROUP BY word),
wins AS (SELECT row_number() OVER () AS wid, win FROM (SELECT DISTINCT win FROM bw)),
rare AS (SELECT wid, arg_min(word, (n, word, o)) AS word, arg_min(o, (n, word, o)) AS o FROM (SELECT wid, unnest(win) AS word, unnest(range(0, len(win))) AS o FROM wins) JOIN freq USING (word) GROUP BY wid),
places AS (SELECT DISTINCT k, wid, s FROM (SELECT k, wid, unnest(range(p - o - 2, p - o + 3)) AS s FROM dp JOIN rare USING (word))),
near AS (SELECT k, wid FROM places JOIN wins USING (wid) JOIN d USING (k)
 WHERE len(list_filter(range(0, len(win)), lambda i: list_contains(list_slice(w, greatest(s + i - 2, 1), greatest(s + i + 2, 0)), win[i + 1]))) = len(win)),
close AS (SELECT k, count(*) AS n_near FROM (SELECT DISTINCT k, item FROM near JOIN wins USING (wid) JOIN bw USING (win) EXCEPT SELECT k, item FROM hits) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k) LEFT JOIN close USING (k)"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "decontaminate")
    index = build_index(work, documents(spark, sf_dir))
    return contamination(matches(work, index, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
