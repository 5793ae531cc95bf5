"""Fill-in-the-middle forms of texts by ropes.

A unit is a run of letters A-Z, or one other character.  A rope is a balanced
tree over pieces of a text; a leaf holds ``LEAF_UNITS`` units, and every node
caches how many units and code points lie below it.  Splitting at a rank walks
down one path and shares all other nodes, so a text is never copied: two splits
give prefix, middle and suffix, and the output is a concatenation of those trees
with sentinels between them.  It is inverted alone from the written text: a rope
over the output is split beside its sentinels, and the three trees are joined in
the order of the text.

Cuts come from the digest of ``seed:doc_id``, so a rerun gives the same rows
wherever it runs, and rows of one id are cut by the same numbers.

Defined results.  Null and empty texts, texts that hold a sentinel, and a tenth of
the others stay plain: their output is the text, their lengths are null.  A null
doc_id is hashed as an empty string after the colon.  Prefix, middle or suffix
may be empty.  Texts of any length are taken whole; an empty table gives no rows.
Other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcewise.llm.common import documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, LEAF_UNITS = 1, 256
#: Of a hundred texts, those that are rewritten, and of these those with the suffix first.
REWRITTEN, SUFFIX_FIRST = 90, 20
FORMS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, restored string"


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf with its text, or the concatenation of two ropes; units and code points are cached."""

    units: int
    chars: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None
    depth: int = 0

    def leaves(self):
        todo = [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                yield node.text
            else:
                todo += [node.right, node.left]

    def __str__(self) -> str:
        return "".join(self.leaves())


EMPTY = Rope(0, 0)


def unit_starts(text: str) -> np.ndarray:
    """Places (code points) where a unit begins."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lower = code | np.uint32(32)
    letter = (lower >= 97) & (lower <= 122)
    begins = ~letter
    begins[:1] = True
    begins[1:] |= letter[1:] & ~letter[:-1]
    return np.flatnonzero(begins)


def rope(text: str) -> Rope:
    """A balanced rope over a text; leaves end between units."""
    starts = unit_starts(text)
    if not len(starts):
        return EMPTY
    cuts = [*starts[::LEAF_UNITS].tolist(), len(text)]
    level = [Rope(LEAF_UNITS, b - a, text[a:b]) for a, b in zip(cuts[:-2], cuts[1:-1], strict=True)]
    level.append(Rope((len(starts) - 1) % LEAF_UNITS + 1, cuts[-1] - cuts[-2], text[cuts[-2] :]))
    while len(level) > 1:
        level = [joined(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def joined(a: Rope, b: Rope) -> Rope:
    """Concatenation, rotated where one side is much deeper, so depth stays in the order of log n."""
    if not a.chars:
        return b
    if not b.chars:
        return a
    if a.depth > b.depth + 1:
        return joined(a.left, joined(a.right, b)) if a.left.depth >= a.right.depth else _node(_node(a.left, a.right.left), joined(a.right.right, b))
    if b.depth > a.depth + 1:
        return joined(joined(a, b.left), b.right) if b.right.depth >= b.left.depth else _node(joined(a, b.left.left), _node(b.left.right, b.right))
    return _node(a, b)


def _node(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.chars + b.chars, "", a, b, 1 + max(a.depth, b.depth))


def split(tree: Rope, rank: int, by_unit: bool = True) -> tuple[Rope, Rope]:
    """The first ``rank`` units (or code points) of a rope, and the rest."""
    size = tree.units if by_unit else tree.chars
    if rank <= 0:
        return EMPTY, tree
    if rank >= size:
        return tree, EMPTY
    if tree.left is None:
        starts = unit_starts(tree.text)
        at = int(starts[rank]) if by_unit else rank
        before = int(np.searchsorted(starts, at))  # a unit cut in two counts on both sides
        return Rope(before, at, tree.text[:at]), Rope(tree.units - before + (at not in starts[before : before + 1]), tree.chars - at, tree.text[at:])
    held = tree.left.units if by_unit else tree.left.chars
    if rank <= held:
        a, b = split(tree.left, rank, by_unit)
        return a, joined(b, tree.right)
    a, b = split(tree.right, rank - held, by_unit)
    return joined(tree.left, a), b


def chain(*parts: Rope) -> Rope:
    whole = EMPTY
    for part in parts:
        whole = joined(whole, part)
    return whole


def sentinel(text: str) -> Rope:
    return Rope(len(unit_starts(text)), len(text), text)


def rewritten(text: str, key: str, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle, output) of one text."""
    tree = rope(text)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= REWRITTEN:
        return tree.units, "plain", None, None, text
    a, b = sorted((h[0] % (tree.units + 1), h[1] % (tree.units + 1)))
    head, suffix = split(tree, b)
    prefix, middle = split(head, a)
    p, s, m = (sentinel(x) for x in (PREFIX, SUFFIX, MIDDLE))
    if h[3] % 100 < SUFFIX_FIRST:
        return tree.units, "spm", prefix.chars, middle.chars, str(chain(s, suffix, p, prefix, m, middle))
    return tree.units, "psm", prefix.chars, middle.chars, str(chain(p, prefix, s, suffix, m, middle))


def restored(output: str, form: str) -> str:
    """The text from which ``rewritten`` made an output."""
    if form == "plain":
        return output
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    at = [output.find(s) for s in order]
    if at[0] != 0 or not at[0] < at[1] < at[2]:
        raise ValueError("the sentinels of this form are not all there")
    parts, rest, gone = {}, rope(output), 0
    for name, end in zip(order, [*at[1:], len(output)], strict=True):
        _, rest = split(rest, len(name), by_unit=False)
        parts[name], rest = split(rest, end - gone - len(name), by_unit=False)
        gone = end
    return str(chain(parts[PREFIX], parts[MIDDLE], parts[SUFFIX]))


def _forms(batches):
    names = [x.split()[0] for x in FORMS.split(", ")]
    kinds = [{"bigint": pa.int64(), "string": pa.string()}[x.split()[1]] for x in FORMS.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 300):
            part, rows = batch.slice(at, 300), []
            for key, text in zip(part.column(0).cast(pa.int64()).to_pylist(), part.column(1).to_pylist(), strict=True):
                n, form, a, m, output = rewritten(text or "", "" if key is None else str(key))
                rows.append((key, n, form, a, m, output, restored(output, form)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored) of every row."""
    return docs.select("doc_id", "text").mapInArrow(_forms, FORMS)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: units, form, lengths, and the digests of the output and of the text rebuilt from it."""
    found = fill_in_middle(documents(spark, sf_dir))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
 h AS (SELECT *, len(u) AS n, [list_sum([(instr('0123456789abcdef', substr(x, (8 * k + i)::INT, 1)) - 1) * (16::BIGINT ** (8 - i))::BIGINT FOR i IN range(1, 9)])::BIGINT FOR k IN range(0, 4)] AS h FROM d),
 c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
 p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
