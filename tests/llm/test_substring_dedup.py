import random
import re

import numpy as np

from sourcewise.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, removed int, row_key int"


def test_gear_hash_and_cuts_equal_a_plain_loop():
    data = np.frombuffer(random.Random(1).randbytes(3000), np.uint8)
    fast = sd.gear(data)
    for i in (0, 5, 31, 32, 33, 999, 2999):
        value = 0
        for b in data[max(0, i - 31) : i + 1].tolist():
            value = ((value << 1) + int(sd._GEAR[b])) % 2**32
        assert value == fast[i]
    text = "héllo wörld " * 400
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = sd.cut(raw, np.flatnonzero(sd.gear(raw) >> np.uint32(28) == 0) + 1)
    assert ends[-1] == len(raw) and all(sd.LEAST <= b - a <= sd.MOST + 3 for a, b in zip([0, *ends], ends[:-1], strict=False))
    assert "".join(raw.tobytes()[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)) == text


def test_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdefghéß", k=rng.randint(2, 9))) for _ in range(n))
    passages = [words(51) for _ in range(60)]
    rows, holds = [], {}
    for k, p in enumerate(passages):
        for c in range(3):
            key = 10 * k + c
            head = words(rng.randint(0, 200))
            rows.append((key, f"{head} {p} {words(rng.randint(0, 200))}", 0, 0))
            holds[key] = (len(head) + 1, len(head) + 1 + len(p))
    rows += [(5000 + k, words(300), 0, 0) for k in range(100)] + [(None, None, 0, 0), (7000, "", 0, 0), (7001, rows[0][1], 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    work = sd.Workspace(spark, "test")
    found = {r.doc_id: r for r in sd.repeats(work, docs.withColumn("row_key", sd.F.monotonically_increasing_id())).collect()}
    assert len(found) == len(rows)
    for key, (a, b) in holds.items():
        assert any(s.start < b and a < s.end for s in found[key].shared)
        if key % 10 and key != 0:
            assert found[key].removed
            assert all(a - sd.MOST <= s.start and s.end <= b + sd.MOST for s in found[key].removed)
    assert all(not found[5000 + k].shared for k in range(100))
    assert [tuple(s) for s in found[7001].removed] == [(0, len(rows[0][1]))]
    clean = sd.remove_repeats(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[None] is None and texts[7001] == "" and texts[5000] == rows[180][1]
    for key, text, _, _ in rows[:180]:
        cut = "".join(text[a:b] for a, b in zip([0] + [s.end for s in found[key].removed], [s.start for s in found[key].removed] + [len(text)], strict=True))
        assert texts[key] == cut
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_insertions_move_few_cuts():
    rng = random.Random(9)
    text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(2000))
    edited = text[:4000] + "inserted" + text[4000:]
    pieces = []
    for t in (text, edited):
        raw = np.frombuffer(t.encode(), np.uint8)
        ends = sd.cut(raw, np.flatnonzero(sd.gear(raw) >> np.uint32(28) == 0) + 1)
        pieces.append({raw.tobytes()[a:b] for a, b in zip([0, *ends], ends, strict=False)})
    assert len(pieces[0] - pieces[1]) <= 8


def test_short_copies_and_whole_passages_are_found(spark):
    """Exact copies under RUN are found, a passage is covered to its last character, periodic ones too."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choices("abcdefghéß", k=rng.randint(2, 9))) for _ in range(n))
    passages = [words(51) for _ in range(80)] + [" ".join([words(1)] * 51) for _ in range(40)] + [words(51) + " " + words(1) * 300]
    rows, holds = [], {}
    for k, p in enumerate(passages):
        for c in range(2):
            key, head = 10 * k + c, words(rng.randint(1, 150))
            rows.append((key, f"{head} {c}{p}{c} {words(rng.randint(1, 150))}", 0, 0))
            holds[key] = (len(head) + 2, len(head) + 2 + len(p))
    rows += [(5000, "a short text", 0, 0), (5001, "a short text", 0, 0), (5002, "another", 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = {r.doc_id: r for r in sd.repeats(sd.Workspace(spark, "test"), docs.withColumn("row_key", sd.F.monotonically_increasing_id())).collect()}
    covered = lambda spans, a, b: sum(max(0, min(s.end, b) - max(s.start, a)) for s in spans) / (b - a)
    for key, (a, b) in holds.items():
        if key < 800:
            assert [tuple(s) for s in found[key].shared] == [(a, b)]
            assert [tuple(s) for s in found[key].removed] == [(a, b)][: key % 10]
        else:
            assert covered(found[key].shared, a, b) > 0.9
    assert [tuple(s) for k in (5000, 5001, 5002) for s in found[k].shared] == [(0, 12)] * 2
    assert [tuple(s) for k in (5000, 5001, 5002) for s in found[k].removed] == [(0, 12)]


def test_agreement_past_the_carried_text_is_read_from_whole_texts():
    place = [1, 3, 0, 2, 500, 530, 400, 430, 500, 300]
    texts = "x" + "a" * 499 + "c" * 30 + "b" * 299 + "y", "z" + "a" * 399 + "c" * 30 + "b" * 299 + "w"
    near = [*place, "a" * sd.BEFORE, "b" * sd.AFTER, "a" * sd.BEFORE, "b" * sd.AFTER]
    as_batch = lambda row: sd.pa.RecordBatch.from_arrays([sd.pa.array([x]) for x in row], names=[str(k) for k in range(len(row))])
    assert next(sd._reach(iter([as_batch(near)]))).column("open").to_pylist() == [True]
    far = next(sd._far_reach(iter([as_batch([*place, *texts])]))).to_pylist()[0]
    assert (far["l"], far["r"], far["open"]) == (399, 299, False)


def test_whole_query_equals_brute_force(spark):
    """Documents that share 51 words, character by character, are those with a repeat; spans hold what is shared."""
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    seen = {}
    for n in (40, 51):
        for key, text in texts.items():
            ends = [m.span() for m in re.finditer(r"\S+", text)]
            for (a, _), (_, b) in zip(ends, ends[n - 1 :], strict=False):
                seen.setdefault((n, text[a:b]), set()).add(key)
    by_text = {}
    for key, text in texts.items():
        by_text.setdefault(text, set()).add(key)
    must = {k for (n, _), keys in seen.items() if n == 51 and len(keys) > 1 for k in keys} | {k for t, keys in by_text.items() if t and len(keys) > 1 for k in keys}
    got = {r.doc_id: r for r in sd.op1_substring_dedup(spark, data).collect()}
    flagged = {k for k, r in got.items() if r.has_repeat}
    near = {}
    for key, text in texts.items():
        for p in range(len(text) - 59):
            near.setdefault(text[p : p + 60], set()).add(key)
    may = must | {k for keys in near.values() if len(keys) > 1 for k in keys}
    assert len(got) == len(texts) and must <= flagged <= may and 0 < len(must) <= len(may) < len(texts)
    # what is reported stands in another document too, piece by piece; runs by chance are no passages
    short = {}
    for key, text in texts.items():
        for p in range(len(text) - sd.LEAST + 1):
            short.setdefault(text[p : p + sd.LEAST], set()).add(key)
    for key in flagged:
        held = bytearray(len(texts[key]))
        for p in range(len(texts[key]) - sd.LEAST + 1):
            if len(short[texts[key][p : p + sd.LEAST]]) > 1:
                held[p : p + sd.LEAST] = b"\1" * sd.LEAST
        if len(by_text[texts[key]]) == 1:
            assert all(all(held[a:b]) for a, b in (map(int, s.split(":")) for s in got[key].shared_spans.split(",")))
    for (n, window), keys in seen.items():
        if n == 51 and len(keys) > 1:
            for k in keys:
                at = texts[k].find(window)
                spans = [tuple(map(int, s.split(":"))) for s in got[k].shared_spans.split(",")]
                assert any(a <= at and at + len(window) <= b for a, b in spans)


def test_lines_repeated_in_one_text_are_removed_but_not_shared(spark):
    line = " ".join(f"word{i}" for i in range(60)) + "\n"
    other = " ".join(f"other{i}" for i in range(200))
    docs = spark.createDataFrame([(1, other + "\n" + line * 3, 0, 0), (2, "x" * 2_000_000 + other[:20], 0, 0)], SCHEMA)
    found = {r.doc_id: r for r in sd.repeats(sd.Workspace(spark, "test"), docs.withColumn("row_key", sd.F.monotonically_increasing_id())).collect()}
    assert found[1].shared == [] and sum(s.end - s.start for s in found[1].removed) >= 2 * len(line) - 4
    assert found[2].shared == []
    assert [(s.start, s.end) for s in found[1].removed] == [(len(other) + 1 + len(line) - 2, len(other) + 1 + 3 * len(line))]  # "9\n" stands before both


def test_no_wall_at_first_occurrences():
    mark = lambda i, first, across: {"i": i, "first": first, "across": across}
    marks = [mark(0, False, False), mark(1, True, True), mark(2, False, True), mark(3, True, False), mark(4, False, False)]
    places = [(10 * k, 10 * k + 10) for k in range(5)]
    assert sd._walls(marks, places, 90) == ([0, 0, 0, 30, 30], [20, 20, 90, 40, 90])
