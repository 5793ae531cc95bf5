"""Phrase collocations by suffix automata of shards.

Texts of one language are packed into shards of about ``SHARD_WORDS`` words, as
codes of a dictionary of their own, with breaks between pieces.  A shard counts
what it holds and sends every distinct string once; equal strings of all shards
meet by a 96-bit hash, and their sum goes back to the shards that hold them.  So
a word that stands everywhere is one row per shard.

A shard's strings are those of its suffix automaton, cut at a depth: prefixes are
sorted by their last words read backwards, so that a state (strings that end at the same places)
is a run of the order, its number of end places the length of that run, and its
suffix link the run of the next shorter string around it.  States are read out as
substrings with counts, which are added over all shards.  It is done in rounds, for
words, pairs, triples, and four to ``LONGEST`` words: strings that are too rare break
the codes of the next round, as no longer frequent phrase can hold one.

A candidate that stands in a longer one with the same count is dropped by the
links of the longer one: to its first and to its last words.  Every longer phrase
reaches it over phrases of one word more each, which count as much.  Scores
are exact: products are decimals of 38 digits.

Defined results.  A null text is empty, a null language ``und``.  Repeated rows
count each time; ties are ranked by count, then by the bytes of the phrase.  An
empty table gives no rows.  Texts of any length are taken whole.  Other columns are
ignored whatever their names.
"""

from __future__ import annotations

import string
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcewise.llm.common import Workspace, documents

LEAST, LONGEST, TOP = 100, 5, 2000
SHARD_WORDS, UNKNOWN = 1 << 21, "und"
#: Parts into which a language's phrases are dealt before the last ranking.
RANK_PARTS = 64
SHARDS = "shard bigint, lang string, words array<string>, counts array<int>, codes binary"
STATE = "shard bigint, lang string, words array<string>, codes binary, names array<struct<phrase:string,f:bigint>>"
#: ``h2j`` has 32 more bits of the hash above the string's number in its shard, so rows compress well.
COUNTS = "h1 bigint, h2j bigint, shard bigint, c int"
#: A round's strings meet in so many slices (words by their hash, others by that of their last two words), one after
#: the other, so a part of them is sorted and on disk at a time.  A string's number has its slice above ``NUMBER`` bits.
SLICES, NUMBER = 4, 29
HEAD = struct.Struct("<QB")
_TABLE = bytes.maketrans(string.ascii_uppercase.encode() + b".,;:!?\n\x0b\x0c\r\t", string.ascii_lowercase.encode() + b"\n" * 10 + b" ")
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Codes(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word):
        self[word] = code = len(self) - 2
        return code


def coded(text: str, codes: _Codes) -> np.ndarray:
    """Word codes of a text with -1 between pieces and at the end."""
    raw = text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(b"\n", b" \n ")
    parts = raw.split(b" ")
    found = np.fromiter(map(codes.__getitem__, parts), np.int32, len(parts))
    return np.append(found[found != -2], np.int32(-1))


def _packed(batches, most: int):
    part, k = TaskContext.get().partitionId(), 0
    langs: dict[str, tuple[_Codes, list[np.ndarray]]] = {}
    size = 0

    def shards():
        nonlocal k
        for lang, (codes, texts) in langs.items():
            every = np.concatenate(texts)
            words = list(codes)[2:]
            counts = np.bincount(every[every >= 0], minlength=len(words)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + k]), pa.array([lang]), pa.array([[w.decode("utf-8", "surrogatepass") for w in words]], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int32())), pa.array([stored(every)], pa.binary())],
                names=[x.split()[0] for x in SHARDS.split(", ")],
            )
            k += 1

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            codes, texts = langs.setdefault(lang.as_py(), (_Codes({b"": -2, b"\n": -1}), []))
            texts.append(coded(text.as_py() or "", codes))
            size += len(texts[-1])
            if size >= most:
                yield from shards()
                langs, size = {}, 0
    yield from shards()


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield [c[k] for c in batch.columns]


def _ints(value) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.zeros(0, np.int64)


def stored(codes: np.ndarray) -> bytes:
    """Codes as bytes for tables and shuffles: how many, bytes of each (2 where they fit), and these, compressed."""
    width = 2 if codes.max(initial=0) < 1 << 15 else 4
    return HEAD.pack(len(codes), width) + pa.Codec("zstd", compression_level=1).compress(codes.astype(f"<i{width}").tobytes(), asbytes=True)


def _codes(value) -> np.ndarray:
    raw = value.as_buffer()
    n, width = HEAD.unpack_from(raw)
    plain = pa.Codec("zstd").decompress(raw[HEAD.size :], decompressed_size=n * width) if n else b""
    return np.frombuffer(plain, f"<i{width}").astype(np.int32, copy=False)


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each word of a language."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    raw = b"".join(xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass"), seed) for w in words)
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


def phrase_hashes(words: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Two hashes of phrases from those of their words, in order."""
    out = words[columns[0]].copy()
    for c in columns[1:]:
        for s in (0, 1):
            x = (out[:, s] + np.uint64(1)) * _ODD[s]
            out[:, s] = (x ^ (x >> np.uint64(29))) + words[c, s]
    return out


def _counts(shard: int, hashes: np.ndarray, counts: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    h2j = (hashes[:, 1] & np.uint64(0xFFFFFFFF00000000)) | numbers.astype(np.uint64)
    return pa.RecordBatch.from_arrays(
        [pa.array(hashes[:, 0].view(np.int64)), pa.array(h2j.view(np.int64)), pa.array(np.full(len(numbers), shard)), pa.array(counts.astype(np.int32))],
        names=[x.split()[0] for x in COUNTS.split(", ")],
    )


def _word_counts(part: int):
    def run(batches):
        for shard, lang, words, counts in _rows(batches):
            h = word_hashes(lang.as_py(), words.as_py())
            own = np.flatnonzero(h[:, 0] % np.uint64(SLICES) == part)
            yield _counts(shard.as_py(), np.ascontiguousarray(h[own, :]), _ints(counts)[own], own)

    return run


def slices(codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The slice of the strings of two words or more that end at each place; -1 where none does."""
    out = np.full(len(codes), -1, np.int8)
    at = np.flatnonzero((codes[1:] >= 0) & (codes[:-1] >= 0)) + 1
    h = words[codes[at], 0] * _ODD[0] + words[codes[at - 1], 0]
    out[at] = ((h * _ODD[1]) >> np.uint64(40)) % np.uint64(SLICES)
    return out


def states(codes: np.ndarray, shortest: int, longest: int, mine: np.ndarray | None = None):
    """(words, count, shorter, which) of the strings of the automaton with ``shortest`` to ``longest`` words.

    ``words`` are the strings of one length, a row each, and ``count`` their end
    places; ``shorter`` is the number of end places of the string that the suffix
    link leads to, or of the string's own state where that holds the shorter string
    too; ``which`` is the row of the string that ends at each place, or -1.

    ``mine`` takes only strings that end at the places it marks, which must be all
    places of a string or none; ``shorter`` then counts within these places.
    """
    back = np.full((longest, len(codes)), -1, np.int32)
    live = codes >= 0
    for d in range(longest):
        back[d, d:] = np.where(live[d:], codes[: len(codes) - d], -1)
        if d + 1 < longest:
            live = live & (np.concatenate((np.full(d + 1, -1, np.int32), codes[: -d - 1])) >= 0) if len(codes) > d + 1 else np.zeros(len(codes), bool)
    place = np.arange(len(codes)) if mine is None else np.flatnonzero(mine & (back[shortest - 1] >= 0))
    back = back[:, place]
    order = np.lexsort(back[::-1])
    back, place = back[:, order], place[order]
    new, wider = np.zeros(back.shape[1], bool), None
    new[:1] = True
    for d in range(longest):
        new[1:] |= back[d, 1:] != back[d, :-1]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(order)))
        spread = np.repeat(count, count)
        if d + 1 >= shortest:
            full = back[d, first] >= 0
            which = np.full(len(codes), -1, np.int64)
            which[place] = np.repeat(np.where(full, np.cumsum(full) - 1, -1), count)
            yield back[d::-1, first[full]].T, count[full], (wider if wider is not None else spread)[first[full]], which
        wider = spread


def _string_counts(shortest: int, longest: int):
    """Counts of the distinct strings of ``shortest`` to ``longest`` words in each shard, those of one slice."""

    def of(part: int):
        def run(batches):
            for shard, lang, words, codes in _rows(batches):
                h = word_hashes(lang.as_py(), words.as_py())
                codes = _codes(codes)
                found = [(phrase_hashes(h, list(rows.T)), count) for rows, count, _, _ in states(codes, shortest, longest, slices(codes, h) == part)]
                hashes, counts = (np.concatenate([x[k] for x in found]) for k in (0, 1))
                yield _counts(shard.as_py(), hashes, counts, np.arange(len(counts)) + (part << NUMBER))

        return run

    return of


def _state(shard, lang, words, codes, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([shard.as_py()]), pa.array([lang.as_py()]), pa.array([words], pa.list_(pa.string())), pa.array([stored(codes)], pa.binary()),
         pa.array([[{"phrase": p, "f": f} for p, f in names]], pa.list_(pa.struct([("phrase", pa.string()), ("f", pa.int64())])))],
        names=["shard", "lang", "words", "codes", "names"],
    )


def runs(codes: np.ndarray, least: int) -> np.ndarray:
    """The codes without runs under ``least`` words, one break between runs."""
    live = codes >= 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], live.view(np.int8), [0]))))
    first, last = edges[::2], edges[1::2]
    long = last - first >= least
    first, size = first[long], (last - first)[long] + 1
    at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out = np.append(codes, -1)[at]
    out[np.cumsum(size) - 1] = -1
    return out


def _with_words(batches):
    """Shards with rare words broken out; frequent words are coded anew."""
    for shard, lang, words, codes, js, own, fs in _rows(batches):
        words, js = words.as_py(), _ints(js)
        new = np.full(len(words) + 1, -1, np.int32)
        new[js] = np.arange(len(js), dtype=np.int32)
        kept = [words[j] for j in js.tolist()]
        yield _state(shard, lang, kept, runs(new[_codes(codes)], 2), [(words[j], f) for j, f in zip(_ints(own).tolist(), _ints(fs).tolist(), strict=True)])


def broken(codes: np.ndarray, rare: np.ndarray, size: int) -> np.ndarray:
    """Codes in which no string of over ``size`` words holds one of ``size`` words that ends at a place in ``rare``.

    The run before ends one word early; the run after begins with the words that the rare string shares with it.
    """
    again = [np.full(len(rare), -1, np.int32), *(codes[rare - back] for back in range(size - 2, 0, -1))]
    return runs(np.insert(codes, np.repeat(rare, size - 1), np.stack(again, 1).ravel()), size + 1)


def _with_strings(shortest: int, longest: int):
    """Shards with rare strings broken apart, and the frequent strings that a shard names."""

    def run(batches):
        for shard, lang, words, codes, js, own, fs in _rows(batches):
            words, codes, js, own, fs = words.as_py(), _codes(codes), _ints(js), _ints(own), _ints(fs)
            slice_of, named, rare = slices(codes, word_hashes(lang.as_py(), words)), [], np.zeros(len(codes), bool)
            for part in range(SLICES):
                at = part << NUMBER
                for rows, _, _, which in states(codes, shortest, longest, slice_of == part):
                    held, here = ((x >= at) & (x < at + len(rows)) for x in (js, own))
                    named += [(" ".join(words[c] for c in rows[j - at]), f) for j, f in zip(own[here].tolist(), fs[here].tolist(), strict=True)]
                    good = np.zeros(len(rows) + 1, bool)
                    good[js[held] - at] = good[-1] = True
                    rare |= ~good[which]
                    at += len(rows)
            if longest == LONGEST:
                yield _state(shard, lang, [], np.zeros(0, np.int32), named)
            else:
                yield _state(shard, lang, words, broken(codes, np.flatnonzero(rare), longest), named)

    return run


def _step(work: Workspace, shards: DataFrame, count, keep, least: int, name: str, *used: str) -> DataFrame:
    """One round: counts of all shards meet, and strings with at least ``least`` go back to the shards that hold them.

    Each shard gets their numbers alone; the count goes to the one shard that names the string.
    """
    columns = [c for c in ("shard", "lang", "words", "counts" if "counts" in shards.columns else "codes") if c in shards.columns]
    every = Window.partitionBy("h1", "h2")
    slices = []
    for part in range(SLICES):
        rows = shards.select(*columns).mapInArrow(count(part), COUNTS).repartition("h1")
        rows = rows.select("h1", F.shiftright("h2j", 32).alias("h2"), "shard", F.col("h2j").bitwiseAND(0xFFFFFFFF).cast("int").alias("j"), "c")
        met = rows.withColumn("f", F.sum("c").over(every)).withColumn("own", F.min("shard").over(every) == F.col("shard")).where(F.col("f") >= least)
        lists = F.collect_list("j").alias("held"), F.collect_list(F.when(F.col("own"), F.struct("j", "f"))).alias("own")
        slices.append(work.put(met.groupBy("shard").agg(*lists), f"{name}-{part}"))
    met = slices[0]
    for other in slices[1:]:
        met = met.unionByName(other)
    back = met.groupBy("shard").agg(F.sort_array(F.flatten(F.collect_list("held"))).alias("held"), F.flatten(F.collect_list("own")).alias("own"))
    both = shards.join(back, "shard").select("shard", "lang", "words", "codes", "held", F.col("own.j").alias("own_j"), F.col("own.f").alias("own_f"))
    return work.put(both.mapInArrow(keep, STATE), name, *(f"{name}-{part}" for part in range(SLICES)), *used)


def phrase_counts(work: Workspace, docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of up to ``LONGEST`` words that occur ``least`` times or more; (lang, n)."""
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    most = SHARD_WORDS
    shards = work.put(texts.mapInArrow(lambda batches: _packed(batches, most), SHARDS), "shards")
    totals = work.put(shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, c: s + c)).alias("n")), "totals")
    words = _step(work, shards, _word_counts, _with_words, least, "words", "shards")
    every, last, used = None, words, ["words"]
    for shortest, longest in ((2, 2), (3, 3), (4, LONGEST)):
        named = last.select("lang", F.explode("names").alias("x")).select("lang", "x.phrase", "x.f")
        every = named if every is None else every.unionByName(named)
        last = _step(work, last, _string_counts(shortest, longest), _with_strings(shortest, longest), least, f"strings-{longest}")
        used.append(f"strings-{longest}")
    every = every.unionByName(last.select("lang", F.explode("names").alias("x")).select("lang", "x.phrase", "x.f"))
    return work.put(every.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"), "counts", *used), totals


def _joined(first, size):
    return F.array_join(F.slice("w", first, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``LONGEST`` words."""
    work = Workspace(docs.sparkSession, "collocations")
    counts, totals = phrase_counts(work, docs, least)
    phrases = counts.where("size > 1").withColumn("w", F.split("phrase", " ")).withColumnRenamed("f", "a")
    linked = phrases.where("size > 2").select("lang", "a", F.explode(F.array(_joined(F.lit(1), F.col("size") - 1), _joined(F.lit(2), F.col("size") - 1))).alias("phrase"))
    longer = linked.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    whole = phrases.join(longer, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a").drop("longer")
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.lit(1), F.col("k")).alias("head"), _joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    number = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("above", F.lit(1000).cast("decimal(4,0)") * (number("a") * number("n"))).withColumn("below", number("l") * number("r"))
    best = cuts.withColumn("score", F.expr("above div below")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("x"))
    rows = best.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    rows = rows.withColumn("i", F.row_number().over(dealt)).where(F.col("i") <= top).drop("i")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases by score."""
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
 f AS (SELECT lang, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase, s, count(*) AS f
  FROM w, unnest(range(1, 6)) AS a(s), unnest(range(1, len(w) - s + 2)) AS b(i) GROUP BY ALL),
 n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE s = 1 GROUP BY lang),
 c AS (SELECT lang, phrase, s, f AS a, string_split(phrase, ' ') AS w FROM f WHERE s > 1 AND f >= 100),
 part AS (SELECT lang, s AS long, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, a
  FROM c, unnest(range(2, 5)) AS x(m), unnest(range(1, s - m + 2)) AS y(i) WHERE m < s),
 up AS (SELECT lang, phrase, max(a) AS longer FROM part GROUP BY lang, phrase),
 k AS (SELECT c.*, k, array_to_string(list_slice(w, 1, k), ' ') AS head, array_to_string(list_slice(w, k + 1, s), ' ') AS rest
  FROM c LEFT JOIN up USING (lang, phrase), unnest(range(1, s)) AS z(k) WHERE longer IS NULL OR 100 * longer < 100 * a),
 sc AS (SELECT k.lang, k.phrase, k.a, l.f AS l, r.f AS r, n, k, ((1000 * k.a::HUGEINT * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM k JOIN n ON n.lang = k.lang JOIN f l ON l.lang = k.lang AND l.phrase = head JOIN f r ON r.lang = k.lang AND r.phrase = rest),
 b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
