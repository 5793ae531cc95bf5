import random
import re
from collections import Counter

import numpy as np

from sourcewise.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, shard long, words int, n int"


def plain(rows, least, top):
    """The contract by loops."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for s in range(1, min(5, len(w) - i) + 1):
                    f[lang, tuple(w[i : i + s])] += 1
    found = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    inside = {(lang, p[i : i + s]) for (lang, p), a in found.items() for s in range(2, len(p)) for i in range(len(p) - s + 1) if 100 * a >= 100 * f[lang, p[i : i + s]]}
    out = []
    for (lang, p), a in found.items():
        if (lang, p) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out.sort()
    rank, done = Counter(), []
    for lang, score, a, phrase, l, r in out:  # noqa: E741
        rank[lang] += 1
        if rank[lang] <= top:
            done.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return done


def corpus():
    rng = random.Random(11)
    vocabulary = ["the", "The", "of", "a", "été", "x\x85y", " ", "x\x1c", "\U0001f642", "B", "b"] + [f"w{k}" for k in range(40)]
    phrase = "one two three four five six"
    rows = []
    for k in range(300):
        words = rng.choices(vocabulary, weights=[9] * 11 + [1] * 40, k=rng.randint(0, 40))
        if k % 4 == 0:
            words.insert(rng.randint(0, len(words)), phrase)
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "!? "]) for w in words)
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (None, None), ("ha " * 500, "de"), (" , . ", "fr")]


def test_equals_plain_loops(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, lang, 0, 0, 0) for k, (t, lang) in enumerate(rows)] + [(3, *rows[3], 0, 0, 0)] * 2, SCHEMA)
    want = plain(rows + [rows[3]] * 2, 4, 60)
    for size in (1 << 20, 700):
        monkeypatch.setattr(co, "SHARD_WORDS", size)
        got = [tuple(r) for r in co.collocations(docs.repartition(3), 4, 60).collect()]
        assert sorted(got) == sorted(want)
    assert len(want) > 150 and any(len(r[2].split(" ")) == 5 for r in want)
    assert co.collocations(docs.limit(0)).count() == 0


def test_states_are_all_strings_with_their_end_places():
    rng = random.Random(3)
    codes = np.array([rng.choice([0, 0, 1, 2, -1]) for _ in range(400)] + [-1], np.int32)
    want = Counter()
    for i in range(len(codes)):
        for s in range(1, 6):
            part = codes[i : i + s]
            if len(part) == s and (part >= 0).all():
                want[tuple(part.tolist())] += 1
    got = {}
    for rows, count, shorter, which in co.states(codes, 1, 5):
        for end in np.flatnonzero(which >= 0).tolist():
            assert rows[which[end]].tolist() == codes[end - rows.shape[1] + 1 : end + 1].tolist()
        for w, c, up in zip(rows.tolist(), count.tolist(), shorter.tolist(), strict=True):
            got[tuple(w)] = c
            assert len(w) == 1 or up == want[tuple(w[1:])]
    assert got == dict(want)


def test_breaks_keep_all_longer_strings_without_a_rare_one():
    rng = random.Random(8)
    codes = np.array([rng.choice([0, 0, 1, 2, -1]) for _ in range(300)] + [-1], np.int32)
    strings = lambda x, s: sorted(tuple(x[i : i + s].tolist()) for i in range(len(x) - s + 1) if (x[i : i + s] >= 0).all())
    for size in (2, 3, 4):
        ends = [i for i in range(size - 1, len(codes)) if (codes[i - size + 1 : i + 1] >= 0).all()]
        rare = sorted(rng.sample(ends, len(ends) // 4))
        out = co.broken(codes, np.array(rare), size)
        for longer in range(size + 1, 7):
            want = sorted(tuple(codes[i : i + longer].tolist()) for i in range(len(codes) - longer + 1) if (codes[i : i + longer] >= 0).all() and not any(i + size - 1 <= e < i + longer for e in rare))
            assert strings(out, longer) == want


def test_exact_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits."""
    big = 3_000_000_019
    rows = [("en", "a", 1, 4 * big), ("en", "b", 1, 5 * big), ("en", "a b", 2, 2 * big)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 7_000_000_001 * 10)], "lang string, n long")
    before = co.phrase_counts
    co.phrase_counts = lambda work, docs, least: (counts, totals)
    try:
        got = co.collocations(spark.createDataFrame([], SCHEMA)).collect()
    finally:
        co.phrase_counts = before
    assert [r.score for r in got] == [1000 * 2 * big * 70_000_000_010 // (4 * big * 5 * big)]


def test_only_the_naming_shard_gets_a_count(spark, monkeypatch):
    """Numbers of frequent strings go to all their shards, counts to one; codes travel compressed."""
    monkeypatch.setattr(co, "SHARD_WORDS", 700)
    seen, put = {}, co.Workspace.put

    def spy(self, df, name, *used):
        out = put(self, df, name, *used)
        if name[-1].isdigit() and name[-2] == "-" and name.count("-") == (1 if name.startswith("words") else 2):
            seen[name] = out.selectExpr("explode(held) AS j").count(), out.selectExpr("explode(own) AS x").count()
        return out

    monkeypatch.setattr(co.Workspace, "put", spy)
    docs = spark.createDataFrame([(k, t, lang, 0, 0, 0) for k, (t, lang) in enumerate(corpus())], SCHEMA)
    counts, _ = co.phrase_counts(co.Workspace(spark, "collocations-test"), docs.repartition(3), 4)
    held, own = (sum(x[k] for x in seen.values()) for k in (0, 1))
    assert own == counts.count() < held
    for codes in (np.zeros(0, np.int32), np.array([5, -1, 32_766, -1], np.int32), np.array([1 << 15, 70_000, -1], np.int32), np.full(100_000, 7, np.int32)):
        raw = co.stored(codes)
        assert co._codes(co.pa.array([raw])[0]).tolist() == codes.tolist() and len(raw) < 1_000
