import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sourcewise.llm import token_files as t

PATH = public_tokenizers.path(t.TOKENIZER)


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    start, out = 0, []
    for key, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [t.END_ID]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = t.op7_token_files(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == expected([(r.doc_id, r.text) for r in rows])


def test_edges(spark, monkeypatch):
    odd = [None, "", "  ", "É́ é İSTANBUL ΣΑΣ", "a b c\x85d\x1ce\tf\r\ng", "see <|endoftext|> here, it's", "a<|startoftext|>b<|endoftext|>. c", "日本語 한국어 😀", "x" * 5000]
    rows = [(10 * i - 20, x) for i, x in enumerate(odd)]
    docs = spark.createDataFrame([(k, x, 7) for k, x in rows], "doc_id long, text string, start int")
    assert sorted(map(tuple, t.stored(docs, PATH).collect())) == expected(rows)
    twice = spark.createDataFrame([(None, "n"), (1, "b"), (1, "b"), (1, "b"), (2, "c")], "doc_id long, text string")
    assert sorted(map(tuple, t.stored(twice, PATH).collect()), key=lambda r: r[1]) == expected([(None, "n"), (1, "b"), (1, "b"), (1, "b"), (2, "c")])
    assert t.stored(docs.limit(0), PATH).count() == 0


def test_words_between_spaces_encode_alone():
    tokenizer = Tokenizer.from_file(PATH)
    encode = t._encoder(PATH)
    for text in ["a 's b", "don 't", "x ́y", "ǅ ﬁ ſ K", "a\x0b\x0cb 　 c", "One, two. three., four.' five!. 6. é. a.", "end."]:
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_perfect_hash_is_minimal_and_rejects_strangers():
    for n in (1, 2, 3, 10, 1000, 20_000):
        keys = np.random.default_rng(n).choice(2**40, n, replace=False) - 2**39
        shifts = t.perfect_hash(keys)
        slot = t._slots(keys, shifts[(t._mix(keys, 1) % np.uint64(len(shifts))).astype(np.int64)], n)
        assert sorted(slot.tolist()) == list(range(n))


def test_absent_keys_are_not_found(spark):
    found = spark.range(500).selectExpr("id * 3 as doc_id", "cast(id % 7 as int) as file", "id as at", "cast(id % 5 as int) as place", "1 as rows")
    index = t.build_index(found, 500)
    asked = spark.range(1500).selectExpr("id as doc_id")
    assert {tuple(r) for r in t.lookup(index, asked, 500).collect()} == {(3 * i, i % 7, i, i % 5, 1) for i in range(500)}


def test_rows_come_through_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(t, "FILE_BYTES", 2_000)
    monkeypatch.setattr(t, "BLOCK_TOKENS", 300)
    rows = [(i // 3, f"text {i} of many words " * (i % 9)) for i in range(300)] + [(7, "again and again")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    docs, folder = spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/ids"
    t.write(docs, folder, PATH)
    found = t.runs(spark, folder)
    assert found.where("doc_id = 7").count() > 1 and found.select("file").distinct().count() > 1
    n, tokenizer = found.count(), Tokenizer.from_file(PATH)
    index = t.build_index(found, n).toPandas()
    wanted = spark.createDataFrame([(7,), (40,), (9_999,)], "doc_id long")
    read = t.fetch(spark, folder, t.lookup(spark.createDataFrame(index, t.INDEX_SCHEMA), wanted, n)).collect()
    got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in read)
    assert got == sorted((k, tokenizer.encode(x, add_special_tokens=False).ids + [t.END_ID]) for k, x in rows if k in (7, 40))
    # Without the right slots nothing is read.
    wrong = index.assign(at=[np.roll(np.frombuffer(x, "<i8"), 1).tobytes() for x in index["at"]], place=[np.roll(np.frombuffer(x, "<i4"), 1).tobytes() for x in index["place"]], file=[np.roll(np.frombuffer(x, "<i4"), 1).tobytes() for x in index["file"]])
    places = t.lookup(spark.createDataFrame(wrong, t.INDEX_SCHEMA), wanted.where("doc_id = 40"), n)
    assert [r for r in t.fetch(spark, folder, places).collect() if r.doc_id == 40] == []
    assert t.lookup(spark.createDataFrame(index, t.INDEX_SCHEMA).where("false"), wanted, n).count() == 0


def test_groups_of_one_size_are_placed_together(monkeypatch):
    calls, sort = [], np.sort
    monkeypatch.setattr(t.np, "sort", lambda *a, **k: calls.append(1) or sort(*a, **k))
    for n in (0, 1, 2, 3, 50, 20_000):
        keys = np.unique(np.random.default_rng(n).integers(-(2**40), 2**40, n))
        calls.clear()
        shifts = t.perfect_hash(keys)
        group = (t._mix(keys, 1) % np.uint64(len(shifts))).astype(np.int64)
        assert sorted(t._slots(keys, shifts[group], max(1, len(keys))).tolist()) == list(range(len(keys)))
        assert len(calls) < 2_000  # not one or more for each of 5,000 groups


def test_words_are_looked_up_once_and_letters_encode_as_in_the_file(monkeypatch):
    tokenizer, encode = Tokenizer.from_file(PATH), t._encoder(PATH)
    letters = [chr(c) for c in range(0x300) if chr(c).isalpha()]
    words = letters + [f"a{x}B" for x in letters] + [f"{x}{x.upper()}z." for x in letters] + ["it's.", "3.", "x.,", ".", ",", "İİ", "ß,"]
    texts = [" ".join(words), None, "", "Word. word, WORD.\nword", *words]
    got = encode(t.pa.array(texts, t.pa.string()))
    assert [x.tolist() for x in got] == [tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]
    known = t._tokenizers[PATH][1]
    monkeypatch.setattr(t, "CACHE_WORDS", 0)
    assert [x.tolist() for x in encode(texts)] == [x.tolist() for x in got] and len(known) < 2_000
    assert "it's." not in known and "it's" in known
