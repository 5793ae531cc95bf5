import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from sourcewise.llm import fill_in_middle as fim

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
SCHEMA = "doc_id long, text string, output string, form int, n int"
TEXT = st.text(st.sampled_from("aZ é.\n<PSM>ß🙂0"), max_size=3000)


def plain(text, key):
    """The contract by lists of units."""
    u = UNITS.findall(text)
    n, d = len(u), hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(0, 10**12))
def test_forms_equal_lists_of_units(text, key):
    got = fim.rewritten(text, str(key))
    assert got == plain(text, key)
    assert fim.restored(got[4], got[1]) == text


@settings(max_examples=100, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 3000), st.booleans()), max_size=8))
def test_splits_and_joins_keep_counts_and_depth(text, cuts):
    whole = fim.rope(text)
    assert (whole.units, whole.chars, str(whole)) == (len(UNITS.findall(text)), len(text), text)
    for rank, by_unit in cuts:
        a, b = fim.split(whole, rank, by_unit)
        assert str(a) + str(b) == text and a.chars + b.chars == len(text)
        assert a.units == len(UNITS.findall(str(a))) and b.units == len(UNITS.findall(str(b)))
        assert str(a) == ("".join(UNITS.findall(text)[:rank]) if by_unit else text[:rank])
        again = fim.joined(a, b)
        assert str(again) == text and again.depth <= 2 * max(1, len(text) // fim.LEAF_UNITS).bit_length() + 3


def test_depth_of_long_texts():
    tree = fim.rope("word, " * 200_000)
    for k in range(50):
        a, b = fim.split(tree, 7919 * (k + 1))
        tree = fim.joined(b, a)
    assert tree.chars == 1_200_000 and tree.depth <= 30


def test_odd_rows(spark):
    long = "ab c\n" * 400_000 + "x" * 100_000
    rows = [(1, None, "o", 0, 0), (2, "", "o", 0, 0), (None, "a b c d", "o", 0, 0), (3, "has <S> in it", "o", 0, 0), (4, long, "o", 0, 0), (5, "same row", "o", 0, 0), (5, "same row", "o", 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = fim.fill_in_middle(docs).collect()
    assert len(got) == len(rows)
    for r, (key, text, *_) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0])), strict=True):
        assert r.restored == (text or "")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(text or "", "" if key is None else key)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_query_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(con.execute(fim.OP13_SQL).fetchall())
    assert sorted(tuple(r) for r in fim.op13_fill_in_middle(spark, data).collect()) == want
    assert len({r[2] for r in want}) == 3 and all(r[5] != r[6] for r in want if r[2] != "plain")
