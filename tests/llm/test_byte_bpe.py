import hashlib
import random

import numpy as np
import public_tokenizers
import regex
import tiktoken

from sourcewise.llm import byte_bpe

PATH = public_tokenizers.path(byte_bpe.RANKS)
ODD = [
    None, "", " ", "\n\n  \t x", "I'll we've 'S don't", "naïve café — 日本語のテキスト 한국어 😀😀", "a\x1cb\x1d c\x85d e f　 g", "x" * 900,
    "<|endoftext|> 12345 ½ ² Ⅷ", "\x00\x01\x7f", "é ‍​", "ab" * 300 + "!" * 70, " ".join(str(i * i) for i in range(500)),
]


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(PATH), special_tokens={})


def expected(text):
    ids = library().encode_ordinary(text or "")
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_equals_the_library_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in byte_bpe.op5_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == expected(r.text)


def test_odd_texts_and_round_trip(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "ROW_WORDS", 50)
    monkeypatch.setattr(byte_bpe, "TASK_WORDS", 70)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(ODD)] + [(3, ODD[3], 1), (None, "x y", 1)], "doc_id long, text string, ids int")
    got = byte_bpe.digests(docs).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert tuple(r)[1:] == expected("x y" if r.doc_id is None else ODD[r.doc_id])
    ids = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    for r in byte_bpe.decode(ids, PATH).collect():
        text = ("x y" if r.doc_id is None else ODD[r.doc_id]) or ""
        assert list(r.ids) == library().encode_ordinary(text)
        assert bytes(r.bytes) == text.encode()
    assert byte_bpe.digests(docs.limit(0)).count() == 0


def test_pattern_splits_alike():
    find = regex.compile(public_tokenizers.PATTERN).findall
    for text in filter(None, ODD):
        assert "".join(find(text)) == text


def test_long_words(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghinotres", k=200_000)), "a" * 30_000 + " b " + "日本語" * 4_000, "".join(rng.choices("xyzé", k=1_001)) + "!", "c" * (byte_bpe.LONG_WORD + 1), "c" * byte_bpe.LONG_WORD]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    for r in byte_bpe.digests(docs).collect():
        assert tuple(r)[1:] == expected(texts[r.doc_id % len(texts)])


def test_heap_equals_fold_and_library_on_a_megabyte():
    ranks, pairs = byte_bpe.ranks_of(PATH), byte_bpe.pair_ranks(PATH)
    word = "".join(random.Random(4).choices("aeinotrs", k=1_000_000))
    assert byte_bpe.heap_merges([ranks[bytes([b])] for b in word.encode()], pairs) == library().encode_ordinary(word)


def test_first_states_hold_the_ranks_of_the_pairs_of_bytes():
    ranks = byte_bpe.ranks_of(PATH)
    words = [b"", b"the", b"", b"a", "né".encode(), b""]
    offsets = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    got = byte_bpe.first_states(np.frombuffer(b"".join(words), np.uint8), offsets, PATH).tolist()
    want = [(ranks.get(w[i : i + 2], byte_bpe.NONE) if i + 1 < len(w) else byte_bpe.NONE) << 40 | i << 16 | ranks[w[i : i + 1]] for w in words for i in range(len(w))]
    assert got == want
