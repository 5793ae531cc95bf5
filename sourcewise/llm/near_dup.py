"""Near-duplicate documents by BagMinHash signatures of five-word shingles.

A document is a multiset of five-word shingles (words: runs without ASCII white
space, ASCII letters lower-cased; a document of one to four words is one
shingle).  The weight axis is cut into the intervals (0,1], (1,2], (2,4],
(4,8], ..., the levels of the hierarchy; counts are whole, so none is split further.
Each interval of each shingle carries a Poisson process of points, independent of
those of the others, whose rate is the interval's length, with a place inside the interval and a
signature component for each point.  A document takes the points that lie below
its shingle's count, and each component keeps the earliest point.  The chance
that two documents keep the same point is their weighted Jaccard similarity.
Points are made in order, and a process stops once it is later than every
component, so heavy counts and long documents need few points.

Bands of the signature are exchanged as 64-bit keys.  Documents with the same
words are one node, so copies never meet in a bucket.  In each bucket every node is
compared with the bucket's head, the node that meets most others; similarities are exact, on the full
multisets.  Then, in buckets whose nodes are not all in one component, each
node outside the bucket's main component is compared with the nodes of other
components that the triangle inequality leaves possible: 1 - similarity is a
metric, so two nodes whose distances to the head differ by more than
1 - threshold can't be linked.  No bucket is capped, and a bucket of n near copies
costs n comparisons.  So the links found connect every class, but two members of
a class need not have been compared; ``n_spanning`` counts the found ones.

Defined results.  Rows without words (null, empty, white space) are classes of
their own.  class_id is the least doc_id of the class (null if all are null).
Repeated rows are copies.  Other columns are carried or ignored whatever their
names.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcewise.llm.common import Workspace, documents, join_uneven
from sourcewise.llm.components import components

WORDS, THRESHOLD = 5, 0.8
#: Bands and components in each: a pair at the threshold meets with a chance of 1 - (1 - 0.8**6)**32 = 0.99994.
BANDS, ROWS = 32, 6
#: Pairs whose estimated similarity is lower are not compared; at 192 components it is 5.5 standard errors below the threshold (chance 2e-8).
LEAST_ESTIMATE = 0.64
#: Buckets of up to SMALL nodes are paired by a join, larger ones in tiles of TILE x TILE.
SMALL, TILE = 40, 600
CHUNK_WORDS, CACHE_WORDS = 200_000, 200_000
#: Rows of a band or a text from which it may count as hot.
HOT_BAND = 1_000
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(document number, shingle hash) of every shingle in document order, and each document's digest."""
    docs = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    digest = [xxhash.xxh3_128_digest(b" ".join(w)) for w in docs]
    sizes = np.array([len(w) for w in docs], np.int64)
    h = np.fromiter(map(_known.__getitem__, chain.from_iterable(docs)), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        rolled = h[: max(0, len(h) - WORDS + 1)].copy()
        for k in range(1, WORDS):
            rolled = rolled * _STEP + h[k : len(h) - WORDS + 1 + k]
        rolled = _mix(rolled)
    doc = np.repeat(np.arange(len(docs)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(h))
    full = np.flatnonzero(left >= WORDS)
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    small = np.array([xxhash.xxh3_64_intdigest(b" ".join(docs[d]), seed=1) for d in short.tolist()], np.uint64)
    own, value = np.concatenate([doc[full], short]), np.concatenate([rolled[full], small])
    return own, value, digest


def _counted(own: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with counts, ordered by document and shingle."""
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return own[at], value[at], np.diff(np.append(at, len(own)))


def bag_minhash(own: np.ndarray, value: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs x m) of multisets given as distinct (document, shingle, count)."""
    # One process for each interval that starts below the count: interval k > 0 is (2**(k-1), 2**k].
    tops = np.ceil(np.log2(count)).astype(np.int64) + 1
    at = np.repeat(np.arange(len(own)), tops)
    level = np.arange(len(at)) - np.repeat(np.cumsum(tops) - tops, tops)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    length = np.maximum(low, 1)
    part = (count[at] - low) / length  # share of the interval below the count
    doc, x = own[at], np.zeros(len(at))
    with np.errstate(over="ignore"):
        seed = _mix(value[at] + level.astype(np.uint64) * _STEP)
    best = np.full(n_docs * m, np.iinfo(np.uint64).max, np.uint64)
    worst = np.full(n_docs, np.iinfo(np.uint64).max, np.uint64)
    while len(doc):
        with np.errstate(over="ignore"):
            seed = seed + _STEP
            a = _mix(seed)
            b = _mix(a ^ _B)
        x = x - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        key = (x.view(np.uint64) & np.uint64(0xFFFFFFFFFF000000)) | (b & np.uint64(0xFFFFFF))
        live = key < worst[doc]
        inside = live & ((b >> np.uint64(40)).astype(np.float64) * 2.0**-24 < part)
        component = ((b >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.int64) % m
        np.minimum.at(best, doc[inside] * m + component[inside], key[inside])
        touched = np.unique(doc[live])
        worst[touched] = best.reshape(n_docs, m)[touched].max(axis=1)
        seed, x, doc, length, part = seed[live], x[live], doc[live], length[live], part[live]
    return best.reshape(n_docs, m)


SIGNED = "row_key bigint, content binary, n bigint, bands array<bigint>, sketch binary"


def _sign(batches):
    m = BANDS * ROWS
    for batch in batches:
        texts = batch.column(1).to_pylist()
        begin = 0
        while begin < len(texts):
            stop, size = begin, 0
            while stop < len(texts) and (stop == begin or size < 6 * CHUNK_WORDS):
                size += len(texts[stop] or "")
                stop += 1
            own, value, digest = shingles(texts[begin:stop])
            n = np.bincount(own, minlength=stop - begin)
            signature = bag_minhash(*_counted(own, value), stop - begin, m)
            with np.errstate(over="ignore"):
                mixed = _mix(signature)
                bands = mixed[:, ::ROWS].copy()
                for k in range(1, ROWS):
                    bands = bands * _STEP + mixed[:, k::ROWS]
                bands = _mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            sketch = (mixed >> np.uint64(48)).astype("<u2")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, stop - begin), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), lists, pa.array([x.tobytes() for x in sketch], pa.binary())],
                names=["row_key", "content", "n", "bands", "sketch"],
            )
            begin = stop


def _bags(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            own, value, _ = shingles(part.column(1).to_pylist())
            order = np.lexsort((value, own))
            ends = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=part.num_rows))))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["content", "bag"])


def _similar(batches):
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        out = []
        for i in range(batch.num_rows):
            out.append(_overlap(a[i].values.to_numpy(), b[i].values.to_numpy()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])


def _estimate(batches):
    for batch in batches:
        m = BANDS * ROWS
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, m) for k in (2, 3))
        keep = (x == y).mean(axis=1) >= LEAST_ESTIMATE
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _verified(work: Workspace, pairs: DataFrame, sketches: DataFrame, bags: DataFrame, name: str) -> DataFrame:
    """(a, b, similarity) of the pairs that may reach the threshold."""
    both = pairs.join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b")
    likely = work.put(both.select("a", "b", "x", "y").mapInArrow(_estimate, "a binary, b binary"), f"{name}-likely")
    held = likely.join(bags.toDF("a", "p"), "a").join(bags.toDF("b", "q"), "b")
    return work.put(held.select("a", "b", "p", "q").mapInArrow(_similar, "a binary, b binary, similarity double"), name, f"{name}-likely")


def _small_pairs(mixed: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of a node outside its bucket's main component and a node of another component."""
    x = mixed.where("root <> main and not is_head").select("band", F.col("content").alias("a"), F.col("root").alias("root_a"), F.col("away").alias("away_a"))
    y = mixed.where("not is_head").select("band", F.col("content").alias("b"), F.col("root").alias("root_b"), F.col("away").alias("away_b"))
    pairs = x.join(y, "band").where((F.col("root_a") != F.col("root_b")) & ~F.coalesce(_too_far(F.col("away_a"), F.col("away_b"), threshold), F.lit(False)))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _too_far(away_a, away_b, threshold: float):
    """Whether the distances to the head rule a link out; null where one is not known.

    A node whose distance is not known had an estimate below LEAST_ESTIMATE, so
    its distance is over 1.2 * (1 - threshold), by 5 standard errors.
    """
    reach = 1 - threshold
    near_a, near_b = away_a <= 0.2 * reach, away_b <= 0.2 * reach
    return (F.abs(away_a - away_b) > reach + 1e-9) | (away_a.isNull() & near_b) | (away_b.isNull() & near_a)


def _overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets given as sorted arrays."""
    u, n = np.unique(x, return_counts=True)
    v, k = np.unique(y, return_counts=True)
    _, p, q = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[p], k[q]).sum())
    return common / (len(x) + len(y) - common)


def _large_links(work: Workspace, mixed: DataFrame, sketches: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the links between different components in large buckets.

    Buckets of one head are taken together, so a group of near copies that
    meets in many bands is compared once.  It is dealt out in tiles of about
    ``TILE`` x ``TILE`` nodes, so none is gathered in one task.  A tile rules
    pairs out by signatures and by distances to the head, then compares the
    multisets, and writes links only.
    """
    each = mixed.select("head", "content", "root", "away").distinct()
    parts = each.groupBy("head", "root").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("head").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("k"))
    each = work.put(each.join(main, "head"), "large")
    held = each.join(sketches, "content").join(bags, "content").withColumn("tiles", F.ceil(F.col("k") / TILE).cast("int"))
    own = F.pmod(F.xxhash64("content"), F.col("tiles")).cast("int")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    columns = ["head", "tx", "ty", "content", "root", "away", "sketch", "bag"]
    x = held.where("root <> main").select("*", own.alias("tx"), F.explode(every).alias("ty")).select(columns)
    y = held.select("*", own.alias("ty"), F.explode(every).alias("tx")).select(*(F.col(c).alias(c) for c in columns))

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            sketch = np.frombuffer(b"".join(b["sketch"]), "<u2").reshape(len(b), -1)
            root, away, content, bag = b["root"].to_numpy(), b["away"].to_numpy(float), b["content"].to_numpy(), b["bag"].to_numpy()
            for row in a.itertuples():
                alike = (sketch == np.frombuffer(row.sketch, "<u2")).mean(axis=1) >= LEAST_ESTIMATE
                if alike.any() and row.away is not None:
                    with np.errstate(invalid="ignore"):
                        alike &= ~(np.abs(away - row.away) > 1 - threshold + 1e-9)
                for i in np.flatnonzero(alike).tolist():
                    if root[i] != row.root and (s := _overlap(row.bag, bag[i])) >= threshold:
                        out.append((*sorted((row.content, content[i])), s))
        return pd.DataFrame(out, columns=["a", "b", "similarity"]).astype({"similarity": "float64"})

    keys = ["head", "tx", "ty"]
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInPandas(tile, "a binary, b binary, similarity double").distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD, carried: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The stored rows of ``docs`` as (row_key, row), with the carried columns (all by default), and their classes as
    (row_key, doc_id, class_id, class_size, n_spanning, first).  Every other table is deleted after its last use."""
    work = Workspace(docs.sparkSession, "near-dup")
    names = docs.columns if carried is None else carried
    stored = work.put(docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct(*(docs[f"`{c}`"] for c in names)).alias("row")), "stored")
    texts = stored.select("row_key", F.col("row.text").alias("text"))
    signed = work.put(texts.mapInArrow(_sign, SIGNED), "signed")

    heads = signed.where("n > 0").groupBy("content").agg(F.min("row_key").alias("row_key"))
    nodes = work.put(signed.join(heads.select("row_key"), "row_key", "left_semi").select("content", "row_key", "bands", "sketch"), "nodes")
    doc_ids = stored.select("row_key", F.col("row.doc_id").alias("doc_id"))
    rows = signed.select("row_key", F.when(F.col("n") > 0, F.col("content")).alias("content")).join(doc_ids, "row_key")
    rows = work.put(rows, "rows", "signed")
    placed = nodes.select("content", F.explode("bands").alias("band"))
    sizes = placed.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = work.put(join_uneven(placed, sizes, "band", "k", HOT_BAND), "shared")
    met = nodes.join(shared.select("content").distinct(), "content", "left_semi").select("content", "row_key", "sketch")
    met = work.put(met, "met", "nodes")
    sketches = met.select("content", "sketch")
    bags = texts.join(met.select("row_key", "content"), "row_key").select("content", "text").mapInArrow(_bags, "content binary, bag array<bigint>")
    bags = work.put(bags, "bags")
    # A bucket's head is the node that meets most others, as the text that copies were edited from does.
    degree = shared.groupBy("content").agg(F.sum("k").alias("degree"))
    heads_of = shared.join(degree, "content").groupBy("band").agg(F.max_by("content", F.struct("degree", "content")).alias("head"), F.max("k").alias("k"))
    heads_of = work.put(heads_of, "heads")
    members = work.put(join_uneven(shared.drop("k"), heads_of, "band", "k", HOT_BAND), "members", "shared", "heads")

    star = members.where("content <> head").select(F.col("content").alias("a"), F.col("head").alias("b")).distinct()
    tested = _verified(work, star, sketches, bags, "star")
    links = tested.where(F.col("similarity") >= threshold)
    roots = components(work, links.select("a", "b"), "star-components")

    # Buckets that hold several components: nodes outside the main one meet the nodes of other components.
    far = tested.select(F.col("a").alias("content"), F.col("b").alias("head"), (1 - F.col("similarity")).alias("away"))
    rooted = members.join(roots.select(F.col("node").alias("content"), "root"), "content", "left").join(far, ["content", "head"], "left")
    rooted = rooted.select(
        "band", "k", "head", "content", F.coalesce("root", "content").alias("root"),
        F.when(F.col("content") == F.col("head"), 0.0).otherwise(F.col("away")).alias("away"), (F.col("content") == F.col("head")).alias("is_head"),
    )
    rooted = work.put(rooted, "rooted", "members", "star-components")
    parts = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = work.put(rooted.join(main, "band"), "mixed", "rooted")
    small, large = mixed.where(F.col("k") <= SMALL), mixed.where(F.col("k") > SMALL)
    cross = work.put(_small_pairs(small, threshold).distinct(), "cross")
    more = _verified(work, cross, sketches, bags, "more").where(F.col("similarity") >= threshold)
    more = more.unionByName(work.put(_large_links(work, large, sketches, bags, threshold), "large-links"))
    every = work.put(links.unionByName(more).select("a", "b").distinct(), "links", "star", "cross", "more", "mixed", "large", "large-links", "bags", "met")
    final = components(work, every, "components")

    ends = every.select(F.explode(F.array("a", "b")).alias("content")).groupBy("content").agg(F.count(F.lit(1)).alias("n_spanning"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    contents = rows.where("content is not null").groupBy("content").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("k"))
    contents = contents.join(final.select(F.col("node").alias("content"), "root"), "content", "left").join(ends, "content", "left")
    contents = contents.select("content", F.coalesce("root", "content").alias("root"), "least", "k", F.coalesce("n_spanning", F.lit(0)).alias("n_spanning"))
    contents = work.put(contents, "contents", "components", "links")
    groups = contents.groupBy("root").agg(F.min("least").alias("first"), F.sum("k").alias("class_size"))
    known = work.put(contents.join(groups, "root").select("content", "first", "class_size", "n_spanning", "k"), "known", "contents")
    columns = ["row_key", "doc_id", "class_id", "class_size", "n_spanning", "first"]
    shared_rows = join_uneven(rows.where("content is not null"), known, "content", "k", HOT_BAND).select(
        "row_key", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", "n_spanning", (F.col("first.row_key") == F.col("row_key")).alias("first")
    )
    alone = rows.where("content is null").select("row_key", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(0).cast("bigint").alias("n_spanning"), F.lit(True).alias("first"))
    return stored, work.put(shared_rows.select(columns).unionByName(alone), "classes", "rows", "known")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one of the least doc_id, with its own columns."""
    stored, out = classes(docs)
    return stored.join(out.where("first").select("row_key"), "row_key", "left_semi").select("row.*")


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``first`` marks the document that stays; n_spanning counts the links found at a text, which connect its class."""
    return classes(documents(spark, sf_dir), carried=["doc_id", "text"])[1].drop("row_key")
