import random
import re

from sourcewise.llm import licenses
from sourcewise.llm.license_texts import TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall((text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(text):
    """Templates with 80 % of their distinct shingles within a stretch of their scale."""
    found, own = set(), grams(text)
    for name, t in TEMPLATES.items():
        want = set(grams(t))
        scale = licenses.scales(len(want))[-1]
        for i in range(max(1, len(own) - scale + 1)):
            if len(want & set(own[i : i + scale])) >= licenses.LEAST * len(want):
                found.add(name)
    return found


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in licenses.op10_licenses(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows) and any(got.values())
    for r in rows:
        assert got[r.doc_id] == brute(r.text)


def test_embedded_edited_and_odd_texts(spark):
    rng = random.Random(2)
    noise = lambda n: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(n))
    texts = [None, "", "MIT", "released under the", noise(3000)]
    for t in TEMPLATES.values():
        texts += [t, noise(rng.randrange(80)) + " " + t + " " + noise(60), noise(40) + "\n" + t.upper().replace(" ", "\n * ")]
        words = t.split()
        if len(words) > 60:
            words[20] = "changed"
            texts.append(noise(17) + " " + " ".join(words) + noise(5))
            texts.append(" ".join(words[: len(words) // 2]))
    texts.append(" ".join(TEMPLATES["MIT-short"] for _ in range(400)))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, texts[6], 1, "x")], "doc_id long, text string, h int, license string")
    got = licenses.scan(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[6 if r.doc_id is None else r.doc_id]
        names = {x.license for x in r.found}
        assert brute(text) <= names
        if r.doc_id == 4:
            assert not names
    assert licenses.scan(docs.limit(0)).count() == 0


def test_spans_and_containment(spark):
    text = "one two three four five " * 3 + TEMPLATES["Zlib-full"] + " six seven eight nine ten" * 3
    words = len(WORD.findall(TEMPLATES["Zlib-full"].lower()))
    half = TEMPLATES["Zlib-full"].split()
    half[60] = "changed"
    docs = spark.createDataFrame([(1, text), (2, " ".join(half)), (3, " ".join(half[: len(half) // 2]))], "doc_id long, text string")
    got = {r.doc_id: [x for x in r.found if x.license == "Zlib-full"] for r in licenses.scan(docs).collect()}
    assert [(x.share, x.first, x.end) for x in got[1]] == [(1.0, 15, 15 + words)]
    want, own = set(grams(TEMPLATES["Zlib-full"])), set(grams(" ".join(half)))
    assert [(x.share, x.first, x.end) for x in got[2]] == [(len(want & own) / len(want), 0, words)]
    assert got[3] == []


def test_templates_of_any_length(spark):
    rng = random.Random(8)
    long = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(3000))
    edited = long.split()
    edited[::100] = ["x"] * 30
    docs = spark.createDataFrame([(1, "before " + long + " after"), (2, " ".join(edited)), (3, long[: len(long) // 2]), (4, None)], "doc_id long, text string")
    got = {r.doc_id: [(x.license, round(x.share, 3)) for x in r.found] for r in licenses.scan(docs, {"long": long, "short": "released under the very short license"}).collect()}
    assert got[1] == [("long", 1.0)] and got[3] == got[4] == []
    assert [x for x, _ in got[2]] == ["long"] and got[2][0][1] < 1
