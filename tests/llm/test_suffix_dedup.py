import hashlib
import random

import numpy as np
import pytest

from sourcewise.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, shard int, kept int, key int"


def brute(rows):
    """Runs of bytes covered by a window that starts in a row with a smaller id."""
    last = float("inf")
    raw = [(last if k is None else k, (t or "").encode()) for k, t, *_ in rows]
    first = {}
    for k, b in raw:
        for p in range(len(b) - sd.LEAST + 1):
            w = b[p : p + sd.LEAST]
            first[w] = min(first.get(w, last), k)
    out = []
    for (k, b), row in zip(raw, rows, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - sd.LEAST + 1):
            if first[b[p : p + sd.LEAST]] < k:
                gone[p : p + sd.LEAST] = b"\1" * sd.LEAST
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((row[0], len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefgé", k=rng.randint(1, 6))) for _ in range(n))
    passage, other = words(40), words(30)
    rows = [(k, f"{words(rng.randint(0, 60))} {passage if k % 3 else other} {words(rng.randint(0, 60))}", 0, 0, 0) for k in range(40)]
    rows += [(100 + k, rows[k][1][:200] + "!" + rows[k][1][200:], 0, 0, 0) for k in range(10)]
    rows += [(7, rows[3][1], 1, 1, 1), (7, rows[7][1], 1, 1, 1), (None, rows[5][1], 0, 0, 0), (None, None, 0, 0, 0), (200, "", 0, 0, 0), (201, "short", 0, 0, 0), (5, "short", 0, 0, 0)]
    rows += [(300, "ab" * 300, 0, 0, 0), (301, "ab" * 400 + "\0" * 130, 0, 0, 0), (302, "\0" * 90 + passage[:49], 0, 0, 0), (303, words(20) + (words(400) + " ") * 2 + passage, 0, 0, 0)]
    return rows


@pytest.mark.parametrize(("hot", "shard"), [(20_000, 4 << 20), (2, 900)])
def test_removed_equals_brute_force(spark, monkeypatch, hot, shard):
    """The same rows whatever the size of shards, and with hot keys cut into windows."""
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "SHARD_BYTES", shard)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in sd.removed(docs).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert any(r[2] for r in got)


def test_repeats_have_all_their_places(spark):
    rows = [r for r in corpus() if r[0] not in (None, 7, 300, 301, 302)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    texts = sorted((r[0], (r[1] or "").encode()) for r in rows)
    found = {}
    for r in sd.repeats(docs).collect():
        found.setdefault((r.repeat, r.length, r.n_places), []).append((r.doc_id, r.start))
    assert len(found) > 20
    every = sorted({t for _, t in texts})
    strings = {}
    for (_, length, n), places in found.items():
        assert len(places) == n and length >= sd.LEAST
        own = {t[s : s + length] for k, s in places for kk, t in texts if kk == k and len(t) >= s + length}
        held = [x for x in own if all(any(t[s : s + length] == x for kk, t in texts if kk == k) for k, s in places)]
        assert held
        word = held[0]
        assert sum(t.startswith(word, p) for _, t in texts for p in range(len(t))) == n
        strings.setdefault(word, []).append(n)
    covered = lambda w: any(w in s for s in strings)
    count = {}
    for _, t in texts:
        for p in range(len(t) - sd.LEAST + 1):
            count[t[p : p + sd.LEAST]] = count.get(t[p : p + sd.LEAST], 0) + 1
    assert all(covered(w) == (n > 1) for w, n in count.items())
    passage = next(t for k, t in texts if k == 303)
    assert any(len(s) > 1000 and s in passage for s in strings) and every


def test_stack_scan_gives_the_interval_tree():
    """Intervals of sorted suffixes equal the sets that share a prefix, found by a plain loop."""
    rng = random.Random(2)
    for _ in range(30):
        s = sorted("".join(rng.choices("ab", k=8)) for _ in range(12))
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))
        lcp = [0, *(common(a, b) for a, b in zip(s, s[1:], strict=False))]
        want = {(min(lcp[a + 1 : b + 1]), a, b) for a in range(12) for b in range(a + 1, 12)}
        want = {(d, a, b) for d, a, b in want if (a == 0 or lcp[a] < d) and (b == 11 or lcp[b + 1] < d)}
        assert set(sd.intervals(lcp, 0, 11)) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert sd.removed(docs).count() == 0 and sd.repeats(docs).count() == 0


def test_runs_cut_the_same_bytes_as_the_pieces():
    rng = np.random.default_rng(5)
    for _ in range(50):
        size = rng.integers(sd.LEAST, sd.LEAST + 60, 8)
        least = rng.integers(10, 20, 8)
        most = least + rng.integers(0, 3, 8)
        row = np.sort(rng.integers(0, 8, 25))
        start = rng.integers(0, size[row] - 20)
        end = np.minimum(start + rng.integers(20, 60, 25), size[row])
        low = least[row] - rng.integers(0, 2, 25)

        def cut(pieces, at, rank):
            return {x for r, a, b, lo in zip(*(p.tolist() for p in pieces), strict=True) if r == at and lo < rank for x in range(a, b)}

        few = sd.runs(row, start, end, low, size, least, most)
        for at in range(8):
            for rank in range(least[at], most[at] + 1):
                assert cut((row, start, end, low), at, rank) == cut(few, at, rank)
