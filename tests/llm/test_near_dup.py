import random
import re
from collections import Counter

import numpy as np

from sourcewise.llm import near_dup as nd


def bag(text):
    w = re.findall(rb"[^ \t-\r]+", (text or "").encode().lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w)


def similarity(a, b):
    common = sum((a & b).values())
    return common / max(1, sum(a.values()) + sum(b.values()) - common)


def brute(rows):
    """Classes over all pairs: {row number: least row number}."""
    bags, root = [bag(t) for _, t in rows], list(range(len(rows)))
    holders = {}
    for i, b in enumerate(bags):
        for s in b:
            holders.setdefault(s, []).append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, b in enumerate(bags):
        for j in {j for s in b for j in holders[s] if j < i}:
            if find(i) != find(j) and similarity(b, bags[j]) >= 0.8:
                a, c = sorted((find(i), find(j)))
                root[c] = a
    return [rows[find(i)][0] for i in range(len(rows))]


def same(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = nd.classes(docs)[1].collect()
    assert {r.doc_id: r.class_id for r in got} == dict(zip([k for k, _ in rows], brute(rows), strict=True))
    assert sum(r.first for r in got) == len(set(brute(rows)))


def test_whole_table(spark):
    same(spark, [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()])


def test_chains_hot_groups_and_shared_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [word() for _ in range(200)]
    rows, key = [], 0
    for step in range(12):  # each is near the one before only
        text = base[:]
        for k in range(step):
            text[16 * k + 3 : 16 * k + 5] = [f"x{k}y", f"z{k}"]
        rows.append((key := key + 1, " ".join(text)))
    hot = [word() for _ in range(150)]
    for _ in range(60):
        text = hot[:]
        text[rng.randrange(150)] = word()
        rows.append((key := key + 1, " ".join(text)))
    passage = [word() for _ in range(120)]
    for _ in range(60):
        rows.append((key := key + 1, " ".join(passage + [word() for _ in range(100)])))
    rows += [(key := key + 1, " ".join(hot)) for _ in range(20)]
    same(spark, rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One two"), (6, "one two three"), (7, "ß é " * 4000), (8, "ß é " * 4000 + "end"), (9, "ß é " * 100)]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows] + [(None, "one two", 0, 0), (4, "one two", 0, 0)], "doc_id long, text string, content int, band int")
    got = sorted((r.doc_id or 0, r.class_id, r.class_size) for r in nd.classes(docs)[1].collect())
    assert got == [(0, 4, 4), (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 4), (4, 4, 4), (5, 4, 4), (6, 6, 1), (7, 7, 2), (8, 7, 2), (9, 9, 1)]
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert nd.keep_one(docs.limit(0)).count() == 0


def test_signatures_estimate_weighted_jaccard():
    a = "a b c d e f g h i j k l m n o p " * 7 + " ".join(f"u{i}" for i in range(60))
    b = "a b c d e f g h i j k l m n o p " * 4 + " ".join(f"u{i}" for i in range(45)) + " ".join(f"v{i}" for i in range(9))
    own, value, _ = nd.shingles([a, b])
    own, value, count = nd._counted(own, value)
    got = [(nd.bag_minhash(own, value ^ np.uint64(s * 77777), count, 2, 256)) for s in range(40)]
    assert abs(np.mean([np.mean(x[0] == x[1]) for x in got]) - similarity(bag(a), bag(b))) < 0.02
