import hashlib
import re

from sourcewise.llm import pii

DATA = "/root/testdata/sf0.001"
RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in s.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def brute(text):
    spans = {k: [m.span() for m in r.finditer(text or "") if valid(k, m[0])] for k, r in RULES.items()}
    joined = ",".join(f"{k}:{a}:{b}" for k, own in spans.items() for a, b in own)
    return (*(len(x) for x in spans.values()), hashlib.sha256(joined.encode()).hexdigest()), joined


ODD = [
    None, "", "a@b.c@d.e.@x.y a..b@c-d.e- +@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 9.9.9.9.", "4111 1111-1111 1111 4111111111111111x 41111111111111112",
    "+1 (017) 555-7713, +1234567 +12345678. +1..2()3-4 5 6 7 8 +", "é😀 me@site.org ß 10.0.0.1", "x" * 30000 + "@" + "a." * 4000 + "b", "1 " * 9000, "7." * 9000, "a@b.c " * 700, "+5" + "(" * 3000, "A1@B2.C3" * 50,
    "token = 0123456789abcdef0123456789abcdef tail",
]


def test_base_equals_brute_force(spark):
    got = {r.doc_id: r for r in pii.op4_pii(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        counts, spans = brute(r.text)
        assert tuple(got[r.doc_id])[1:6] == counts
        assert set(filter(None, spans.split(","))) <= set(got[r.doc_id].spans.split(","))


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(5, ODD[5], "y"), (None, "q@w.e", "z")], "doc_id long, text string, email string")
    found = pii.detect(docs)
    for r in found.collect():
        text = "q@w.e" if r.row.doc_id is None else ODD[r.row.doc_id]
        own = {k: [(s.start, s.end) for s in r[k]] for k in RULES}
        assert own == {k: [m.span() for m in x.finditer(text or "") if valid(k, m[0])] for k, x in RULES.items()}
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[0] is None and texts[1] == "" and texts[6] == "é😀 [email] ß [ip]" and texts[13] == "token = [secret] tail"
    assert pii.redact(docs.limit(0)).count() == 0


def test_patterns_discover_unseen_identifiers(spark):
    """An account number context learned from valid cards finds numbers that fail the check; other contexts stay clean."""
    good = ["4111111111111111", "5500005555555559", "4012888888881881", "6011111111111117", "5105105105105100", "4222222222222220", "5555555555554444", "6011000990139424", "3530111333300000", "3566002020360505", "4000056655665556", "5200828282828210", "4242424242424242", "2223003122003222"]
    rows = [(i, f"please pay account no {c} today") for i, c in enumerate(good)] + [(90, "please pay account no 1234567890123456 today"), (91, "the batch id was 1234567890123457 today")]
    rows += [(92, 'the token = "0123456789abcdef0123456789abcdef" here')]
    got = {r.row.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.value, s.kind) for s in got[90].added] == [("1234567890123456", "card")]
    assert not got[91].added
    assert [s.kind for s in got[92].added] == ["secret"]


def test_values_that_are_base_spans_elsewhere_are_found(spark):
    """A card or phone known from one place is found where the base expression fails; a piece of one isn't."""
    card = "4845168114407329"
    rows = [(1, f"paid with {card}, then 7536784127813050 {card} again"), (2, "call +4915112345678 now"), (3, "or 4915112345678 then"), (4, "call +49 151 876543 now"), (5, "the lot 876543 came")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: [(s.start, s.value, s.kind) for s in r.added] for r in pii.detect(docs).collect()}
    assert got == {1: [(50, card, "card")], 2: [], 3: [(3, "4915112345678", "phone")], 4: [], 5: []}
    texts = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert card not in texts[1] and texts[3] == "or [phone] then"


def test_coarser_patterns_discover_other_lengths_and_letters(spark):
    """Seeds of several lengths support one context together; the word after tells contexts apart; tokens may lack digits."""
    phones = [f"+4{n}" for n in ("1234567", "12345678", "123456789", "2234567", "22345678", "223456789", "3234567", "32345678", "323456789")]
    rows = [(i, f"please ring number {p} today") for i, p in enumerate(phones)] + [(20, "please ring number 555123 today"), (21, "the ring weighs 555124 today")]
    rows += [(30 + i, f"write to desk {n}@site.org please") for i, n in enumerate("anna bert carl dora emil fred gina hugo ines".split())]
    rows += [(50, "write to desk karl@localhost please"), (60 , "go to my 777123 today")]
    rows += [(70 + i, f"{w} fax {p}0 soon") for i, (w, p) in enumerate(zip("a b c d e f g h i".split(), phones, strict=True))] + [(90, "z fax 888123 soon"), (91, "z fax 888124 later")]
    got = {r.row.doc_id: [(s.value, s.kind) for s in r.added] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20] == [("555123", "phone")] and got[90] == [("888123", "phone")]
    assert got[50] == [("karl@localhost", "email")]
    assert not got[21] and not got[60] and not got[91]
