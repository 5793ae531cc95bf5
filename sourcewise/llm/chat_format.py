r"""Chat formatting: tool calls linked to their results, ordered, validated, written as canonical JSON.

A message's text may hold tool calls, ``<tool_call>{...}</tool_call>`` with
``id``, ``name`` and ``arguments`` (an object, or its JSON text), results,
``<tool_result>{...}</tool_result>`` with ``id`` and ``content``, and tool
definitions, ``<tools>[...]</tools>`` with ``name`` and ``parameters`` (a JSON
schema).  Calls may also stand as a JSON object with ``tool_calls`` (entries
with ``id`` and ``function``), and results as a message of role ``tool`` with
``tool_call_id``.  Each message and each call or result in it is a unit, one row.

Calls and results meet by a hash join on (conversation, identifier); calls meet
their tool's definition by one that spreads tools with very many calls.  Units are
ordered topologically: a result follows its call, and a call follows the results
whose identifiers its arguments name as ``{"$ref": id}``.  A unit's order key is
(turn, place, depth), the greatest of its own and, for each unit before it,
that unit's with one more depth; so units keep their place unless a dependence
moves them.  Units with equal keys follow in the order of their own turn and place,
so (at_turn, at_place, depth, turn, place) is a total order but for repeated rows.
Chains of units that each wait for one other are shortened by pointer doubling, so
a chain of n takes about log n rounds; then keys go from unit to unit in rounds
over those that wait for several, and a round reads and writes only what still
waits.  No conversation is gathered, so one with a third of
all rows costs no more.  Units on a cycle keep their own place and are marked.

Defined results.  A null text is empty.  Half of a surrogate pair, which UTF-8 can't
hold, is written as its escape (``\ud800``) wherever it stands.  Text that is no valid JSON stays text
and is reported in ``error``.  An identifier used by several calls links to the
first; further calls are marked ``duplicate id``.  A result without a call and a
call without a result are marked.  A call of a tool without a definition is not
validated.  A schema's keyword that is not supported is an error of the call, so
its arguments are not valid; ``format`` and notes such as ``title`` are ignored.
Repeated rows give repeated units.  Null conversations form one
conversation.  Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcewise.llm.common import Workspace, join_uneven

ROUNDS = 10_000
#: Calls of a tool from which it may count as hot.
HOT_CALLS = 1_000
_HALF = re.compile("[\ud800-\udfff]")
_BLOCK = re.compile(r"<(tool_call|tool_result|tools)>(.*?)</\1>", re.S)
UNITS = "conv_id bigint, turn bigint, place int, role string, kind string, call_id string, name string, body string, refs array<string>, error string"


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, non-ASCII as it is, and integral floats as integers."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("not a JSON number")
            return int(x) if x == int(x) and abs(x) < 2**53 else x
        return x

    return whole(json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def whole(text: str) -> str:
    """``text`` with halves of surrogate pairs as escapes."""
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
}


#: Keywords that say nothing about validity.
_NOTES = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format", "contentEncoding", "contentMediaType", "contentSchema"}
_KNOWN = {
    "$ref", "type", "enum", "const", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "required", "properties", "patternProperties", "additionalProperties", "propertyNames",
    "minProperties", "maxProperties", "dependentRequired", "dependentSchemas", "dependencies", "items", "prefixItems", "additionalItems", "contains", "minContains", "maxContains",
    "minItems", "maxItems", "uniqueItems", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern",
}


def _pointed(root, ref):
    """The subschema that a local reference names; KeyError if it names none."""
    if not isinstance(ref, str) or ref != "#" and not ref.startswith("#/"):
        raise KeyError(ref)
    at = root
    for step in unquote(ref).split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        at = at[int(step)] if isinstance(at, list) and step.isdigit() and int(step) < len(at) else at[step] if isinstance(at, dict) else None
        if at is None:
            raise KeyError(ref)
    return at


def _multiple(value, of) -> bool:
    return Fraction(str(value)) % Fraction(str(of)) == 0


def violations(value, schema, at: str = "$", root=None, seen: tuple = ()) -> list[str]:
    """Where ``value`` breaks a JSON schema; keywords that aren't supported are reported too.

    References are local (``#/$defs/x``).  Unknown keywords, references that name
    nothing and references that lead back to themselves on the same value are errors.
    """
    if schema is False:
        return [f"{at}: not allowed"]
    if not isinstance(schema, dict):
        return []
    root = schema if root is None else root
    out = [f"{at}: keyword {k} not supported" for k in schema if k not in _NOTES and k not in _KNOWN and not k.startswith("x-")]
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return out  # filled from another call's result
    same = lambda other: violations(value, other, at, root, seen)
    inner = lambda v, other, place: violations(v, other, place, root)
    if "$ref" in schema:
        ref = schema["$ref"]
        try:
            target = _pointed(root, ref)
        except KeyError:
            out.append(f"{at}: reference {ref} not found")
        else:
            out += [f"{at}: reference {ref} in a circle"] if ref in seen else violations(value, target, at, root, (*seen, ref))
    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    out += [f"{at}: type {k} not supported" for k in kinds if k not in _TYPES]
    if kinds and not any(_TYPES[k](value) for k in kinds if k in _TYPES):
        return [*out, f"{at}: not of type {'/'.join(map(str, kinds))}"]
    if "enum" in schema and canonical(value) not in [canonical(x) for x in schema["enum"]]:
        out.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    # A keyword that isn't supported says nothing about which alternative holds.
    unsure = lambda found: [x for x in found if x.endswith((" not supported", " not found", " in a circle"))]
    for s in schema.get("allOf", []):
        out += same(s)
    for word in ("anyOf", "oneOf"):
        if word in schema:
            each = [same(s) for s in schema[word]]
            open_ = [x for found in each for x in unsure(found)]
            held = sum(not found for found in each)
            if open_:
                out += open_
            elif held == 0 or word == "oneOf" and held > 1:
                out.append(f"{at}: {'fits none of' if held == 0 else 'fits several of'} {word}")
    if "not" in schema:
        found = same(schema["not"])
        out += unsure(found) or [f"{at}: fits not"] * (not found)
    if "if" in schema:
        found = same(schema["if"])
        out += unsure(found) or same(schema.get("else" if found else "then", True))
    if isinstance(value, dict):
        known, wild = schema.get("properties", {}), schema.get("patternProperties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            fits = ([known[k]] if k in known else []) + [s for p, s in wild.items() if re.search(p, k)]
            for s in fits or ([schema["additionalProperties"]] if "additionalProperties" in schema else []):
                out += inner(v, s, f"{at}.{k}")
            if "propertyNames" in schema:
                out += inner(k, schema["propertyNames"], f"{at}.{k}")
        out += [f"{at}: too few properties"] * (len(value) < schema.get("minProperties", 0)) + [f"{at}: too many properties"] * (len(value) > schema.get("maxProperties", math.inf))
        for word in ("dependentRequired", "dependentSchemas", "dependencies"):
            for k, wants in schema.get(word, {}).items():
                if k in value:
                    out += [f"{at}.{x}: required with {k}" for x in wants if x not in value] if isinstance(wants, list) else same(wants)
    if isinstance(value, list):
        first, rest = schema.get("prefixItems", []), schema.get("items", True)
        if isinstance(rest, list):  # before draft 2020-12
            first, rest = rest, schema.get("additionalItems", True)
        for i, v in enumerate(value):
            out += inner(v, first[i] if i < len(first) else rest, f"{at}[{i}]")
        out += [f"{at}: too few items"] * (len(value) < schema.get("minItems", 0)) + [f"{at}: too many items"] * (len(value) > schema.get("maxItems", math.inf))
        if schema.get("uniqueItems") and len({canonical(v) for v in value}) < len(value):
            out.append(f"{at}: items not unique")
        if "contains" in schema:
            each = [inner(v, schema["contains"], at) for v in value]
            held = sum(not found for found in each)
            if open_ := [x for found in each for x in unsure(found)]:
                out += open_
            else:
                out += [f"{at}: contains too few"] * (held < schema.get("minContains", 1)) + [f"{at}: contains too many"] * (held > schema.get("maxContains", math.inf))
    if _TYPES["number"](value):
        out += [f"{at}: below minimum"] * (value < schema.get("minimum", -math.inf)) + [f"{at}: above maximum"] * (value > schema.get("maximum", math.inf))
        low, high = schema.get("exclusiveMinimum"), schema.get("exclusiveMaximum")
        # Draft 4 has true here, which makes the other bound exclusive.
        low, high = schema.get("minimum") if low is True else low, schema.get("maximum") if high is True else high
        out += [f"{at}: at or below exclusive minimum"] * (_TYPES["number"](low) and value <= low) + [f"{at}: at or above exclusive maximum"] * (_TYPES["number"](high) and value >= high)
        if "multipleOf" in schema and not _multiple(value, schema["multipleOf"]):
            out.append(f"{at}: no multiple")
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", math.inf))
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    return out


def _refs(value) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"}:
            return [whole(str(value["$ref"]))]
        return [r for v in value.values() for r in _refs(v)]
    return [r for v in value for r in _refs(v)] if isinstance(value, list) else []


def _call(found: dict) -> dict:
    inner = found.get("function") if isinstance(found.get("function"), dict) else found
    arguments = inner.get("arguments", {})
    arguments = json.loads(arguments) if isinstance(arguments, str) else arguments
    if found.get("id") is None or not isinstance(arguments, dict):
        raise ValueError("a call needs an id and an object of arguments")
    return {"kind": "call", "call_id": whole(str(found["id"])), "name": whole(str(inner.get("name"))), "body": canonical(arguments), "refs": sorted(set(_refs(arguments)))}


def units_of(role: str | None, text: str | None) -> list[dict]:
    """The units of one message, the message first."""
    text, out, errors = text or "", [], []

    def take(kind: str, raw: str) -> bool:
        try:
            found = json.loads(raw)
            if kind == "tools":
                new = [{"kind": "tool", "name": whole(str(t["name"])), "body": canonical(t.get("parameters", {}))} for t in found]
            elif kind == "tool_call":
                new = [_call(found)]
            else:
                new = [{"kind": "result", "call_id": whole(str(found["id"])), "body": canonical(found.get("content"))}]
        except (ValueError, TypeError, KeyError, AttributeError, RecursionError) as error:
            errors.append(f"{kind}: {type(error).__name__}")
            return False
        out.extend(new)
        return True

    rest = _BLOCK.sub(lambda m: "" if take(m[1], m[2]) else m[0], text)
    bare = rest.strip()
    if bare.startswith("{") and bare.endswith("}") and ('"tool_calls"' in bare or '"tool_call_id"' in bare):
        try:
            found = json.loads(bare)
            if isinstance(found.get("tool_calls"), list):
                out += [_call(c) for c in found["tool_calls"]]
                rest = str(found.get("content") or "")
            elif role == "tool":
                out.append({"kind": "result", "call_id": whole(str(found["tool_call_id"])), "body": canonical(found.get("content"))})
                rest = ""
        except (ValueError, TypeError, KeyError, AttributeError, RecursionError) as error:
            errors.append(f"message: {type(error).__name__}")
    message = {"kind": "message", "body": canonical(rest), "error": "; ".join(errors) or None}
    return [message, *out]


def _parse(batches):
    names = ["conv_id", "turn", "place", "role", "kind", "call_id", "name", "body", "refs", "error"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
    for batch in batches:
        rows = []
        for conv, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            rows += [{"conv_id": conv, "turn": turn, "role": role, "place": i} | u for i, u in enumerate(units_of(role, text))]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)


def _check(batches):
    for batch in batches:
        out = []
        for body, schema in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            try:
                out.append(whole("; ".join(violations(json.loads(body), json.loads(schema)))))
            except (ValueError, TypeError, AttributeError, KeyError, ArithmeticError, re.error, RecursionError) as error:
                out.append(f"schema: {type(error).__name__}")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["unit", "broken"])


def _jumps(work: Workspace, chain: DataFrame) -> DataFrame:
    """(unit, end, steps, best) of units that wait for one other (before, after, own): where their chain ends, how far that is,
    and the greatest key that the chain's own units push to the unit.

    Each round a pointer takes over its target's, so it reaches twice as far.
    Pointers into a cycle never end and keep a target that is no end.
    """
    key = F.struct(F.col("own.turn").alias("turn"), F.col("own.place").alias("place"), F.col("own.depth").cast("bigint").alias("depth"))
    jumps = work.put(chain.select(F.col("after").alias("unit"), F.col("before").alias("end"), F.lit(1).cast("bigint").alias("steps"), key.alias("best")), "jumps0")
    for k in range(1, jumps.count().bit_length() + 2):
        target = jumps.select(F.col("unit").alias("end"), F.col("end").alias("next"), F.col("steps").alias("more"), F.col("best").alias("theirs"))
        both = jumps.join(target, "end", "left")
        if both.where("next is not null").isEmpty():
            break
        pushed = F.struct(F.col("theirs.turn").alias("turn"), F.col("theirs.place").alias("place"), (F.col("theirs.depth") + F.col("steps")).alias("depth"))
        best = F.when(F.col("next").isNull(), F.col("best")).otherwise(F.greatest("best", pushed))
        jumps = work.put(both.select("unit", F.coalesce("next", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), best.alias("best")), f"jumps{k}", f"jumps{k - 1}")
    return jumps


def linked(turns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per unit: its order key (at_turn, at_place, depth), canonical ``json``, linked unit and errors."""
    work = Workspace(turns.sparkSession, "chat")
    units = work.put(turns.select("conv_id", "turn", "role", "text").mapInArrow(_parse, UNITS).withColumn("unit", F.monotonically_increasing_id()), "units")
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv")
    marked = units.where("kind <> 'message'").select("unit", conv, "turn", "place", "kind", "call_id", "name", "body", "refs")
    own = F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), F.col("place").cast("bigint").alias("place"), "unit")
    calls = marked.where("kind = 'call'")
    first = calls.groupBy("conv", "call_id").agg(F.min(own).alias("least")).select("conv", "call_id", F.col("least.unit").alias("call"))
    results = marked.where("kind = 'result'").join(first, ["conv", "call_id"], "left").select("unit", "conv", "call_id", "call", own.alias("own"))
    results = work.put(results, "results")
    answer = results.where("call is not null").groupBy("call").agg(F.min("own").alias("own")).select(F.col("call").alias("unit"), F.col("own.unit").alias("answer"))

    tools = marked.where("kind = 'tool'").groupBy("conv", "name").agg(F.min_by("body", own).alias("schema"))
    uses = calls.groupBy("conv", "name").agg(F.count(F.lit(1)).alias("n"))
    tools = work.put(tools.join(uses, ["conv", "name"]).select(F.struct("conv", "name").alias("tool"), "schema", "n"), "tools")
    called = join_uneven(calls.select("unit", "body", F.struct("conv", "name").alias("tool")), tools, "tool", "n", HOT_CALLS)
    broken = work.put(called.select("unit", "body", "schema").mapInArrow(_check, "unit bigint, broken string"), "broken", "tools")

    # Edges (before, after); a reference names the call, and means its first result.
    after_call = results.where("call is not null").select(F.col("call").alias("before"), F.col("unit").alias("after"))
    wanted = calls.select("unit", "conv", F.explode("refs").alias("call_id")).join(first, ["conv", "call_id"], "left")
    referred = wanted.join(answer.withColumnRenamed("unit", "call"), "call", "left").select("unit", F.coalesce("answer", "call").alias("before"))
    edges = work.put(after_call.unionByName(referred.where("before is not null").select("before", F.col("unit").alias("after"))).distinct(), "edges")
    unknown = referred.where("before is null").select("unit").distinct().withColumn("unknown", F.lit("reference to no call"))

    key = lambda c: F.struct(c["turn"].alias("turn"), c["place"].alias("place"), F.lit(0).cast("bigint").alias("depth"))
    plain = marked.select("unit", key(own).alias("own"))
    ends = edges.select(F.explode(F.array("before", "after")).alias("unit")).distinct()
    later = lambda k, n: F.struct(k["turn"].alias("turn"), k["place"].alias("place"), (k["depth"] + n).alias("depth"))
    counts = work.put(edges.groupBy(F.col("after").alias("unit")).agg(F.count(F.lit(1)).alias("missing")), "counts")
    jumps = _jumps(work, edges.join(counts.where("missing = 1").select(F.col("unit").alias("after")), "after").join(plain.withColumnRenamed("unit", "after"), "after"))

    # The chains' ends stand for the chains: what remains are units that wait for none or for several.
    ways = edges.join(counts.where("missing > 1").select(F.col("unit").alias("after")), "after").join(jumps.withColumnRenamed("unit", "before"), "before", "left")
    left = work.put(ways.select(F.coalesce("end", "before").alias("before"), "after", (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.when(F.col("best").isNotNull(), later(F.col("best"), 1)).alias("least")), "left0")
    waiting = left.groupBy(F.col("after").alias("unit")).agg(F.count(F.lit(1)).alias("missing")).join(plain, "unit")
    waiting = work.put(waiting.select("unit", "missing", F.col("own").alias("key")), "waiting0")
    fresh = work.put(ends.join(counts.select("unit"), "unit", "left_anti").join(plain, "unit").select("unit", F.col("own").alias("key")), "done0")
    known = fresh
    for k in range(1, rounds):
        if fresh.isEmpty():
            break
        told = left.join(fresh.select(F.col("unit").alias("before"), "key"), "before").groupBy(F.col("after").alias("unit")).agg(
            F.count(F.lit(1)).alias("told"), F.max(F.greatest(later(F.col("key"), F.col("steps")), "least")).alias("pushed")
        )
        state = waiting.join(told, "unit", "left").select("unit", (F.col("missing") - F.coalesce("told", F.lit(0))).alias("missing"), F.greatest("key", "pushed").alias("key"))
        state = work.put(state, f"state{k}", f"waiting{k - 1}")
        waiting = work.put(state.where("missing > 0"), f"waiting{k}")
        fresh = work.put(state.where("missing = 0").select("unit", "key"), f"done{k}", f"state{k}")
        left = work.put(left.join(waiting.select(F.col("unit").alias("after")), "after", "left_semi"), f"left{k}", f"left{k - 1}")
        known = known.unionByName(fresh)
    else:
        raise ValueError(f"more than {rounds} units in a row wait for several others")
    chained = jumps.join(known.select(F.col("unit").alias("end"), "key"), "end")
    known = work.put(known.unionByName(chained.select("unit", F.greatest("best", later(F.col("key"), F.col("steps"))).alias("key"))), "known")

    links = answer.select("unit", F.col("answer").alias("linked")).unionByName(results.select("unit", F.col("call").alias("linked")))
    repeated = calls.join(first.select(F.col("call").alias("unit")), "unit", "left_anti").select("unit").withColumn("repeated", F.lit("duplicate id"))
    cyclic = ends.join(known.select("unit"), "unit", "left_anti").withColumn("cyclic", F.lit("cycle"))
    out = units
    for part in (known, links, broken, unknown, repeated, cyclic):
        out = out.join(part, "unit", "left")
    dangling = F.when((F.col("kind") == "result") & F.col("linked").isNull(), "result of no call").when(
        (F.col("kind") == "call") & F.col("linked").isNull() & F.col("repeated").isNull(), "call without result"
    )
    error = F.concat_ws("; ", "error", "repeated", dangling, "unknown", "cyclic", F.when(F.col("broken") != "", F.concat(F.lit("arguments: "), "broken")))
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6)
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    text = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            F.when(F.col("kind") == "call", field("arguments", F.col("body"))).when(F.col("kind").isin("message", "result"), field("content", F.col("body"))),
            F.when(F.col("call_id").isNotNull(), field("id", quoted("call_id"))),
            field("kind", quoted("kind")),
            F.when(F.col("name").isNotNull(), field("name", quoted("name"))),
            F.when(F.col("kind") == "tool", field("parameters", F.col("body"))),
            F.when(F.col("role").isNotNull(), field("role", quoted("role"))),
        ),
        F.lit("}"),
    )
    return out.select(
        "conv_id", "turn", "place", "kind", "role", "call_id", "name",
        F.coalesce("key.turn", "turn").alias("at_turn"), F.coalesce("key.place", F.col("place").cast("bigint")).alias("at_place"), F.coalesce("key.depth", F.lit(0)).cast("bigint").alias("depth"),
        F.when(F.col("kind").isin("call", "result"), F.col("linked").isNotNull()).alias("is_linked"),
        (F.col("broken") == "").alias("is_valid"), F.when(error != "", error).alias("error"), text.alias("json"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit with its order key, links, errors, canonical JSON and the JSON's digest."""
    out = linked(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.withColumn("json_sha256", F.sha2("json", 256))


def tool_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given conversations with tool calls put in, as they hold none: an assistant's turn t calls ``count`` under the
    id ``c<t>``, naming the call two turns before, and a user's turn holds a result.  In every third conversation that is
    the result of the turn to come, elsewhere of the turn before; every fifth turn's argument breaks the schema."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.coalesce("text", F.lit(""))
    tools = '<tools>[{"name":"count","parameters":{"type":"object","required":["n"],"properties":{"n":{"type":"integer"},"of":{}}}}]</tools>'
    n = F.when(F.col("turn") % 5 == 0, F.concat(F.lit('"'), F.length(text).cast("string"), F.lit('"'))).otherwise(F.length(text).cast("string"))
    of = F.when(F.col("turn") >= 3, F.concat(F.lit(',"of":{"$ref":"c'), (F.col("turn") - 2).cast("string"), F.lit('"}'))).otherwise(F.lit(""))
    call = F.concat(F.lit('<tool_call>{"id":"c'), F.col("turn").cast("string"), F.lit('","name":"count","arguments":{"n":'), n, of, F.lit("}}</tool_call>"))
    answered = F.when(F.col("conv_id") % 3 == 0, F.col("turn") + 1).otherwise(F.col("turn") - 1)
    result = F.concat(F.lit('<tool_result>{"id":"c'), answered.cast("string"), F.lit('","content":'), F.col("turn").cast("string"), F.lit("}</tool_result>"))
    added = F.when(F.col("turn") == 0, F.lit(tools)).otherwise(F.lit(""))
    added = F.concat(added, F.when(F.col("role") == "assistant", call).when(F.col("role") == "user", result).otherwise(F.lit("")))
    return table.select("conv_id", "turn", "role", F.concat(F.regexp_replace(text, "</?tool", ""), added).alias("text"))


#: The calls and results of ``tool_call_links``: every chain in the table has two links at most.
TOOL_CALL_LINKS_SQL = """WITH u AS (SELECT conv_id, turn, 1 + CAST(turn = 0 AS INT) AS place, CASE role WHEN 'assistant' THEN 'call' ELSE 'result' END AS kind,
  CASE WHEN role = 'assistant' THEN turn WHEN conv_id % 3 = 0 THEN turn + 1 ELSE turn - 1 END AS c FROM conversations WHERE role IN ('assistant', 'user')),
calls AS (SELECT conv_id, turn, place FROM u WHERE kind = 'call'),
answers AS (SELECT conv_id, c, min(turn) AS turn FROM u WHERE kind = 'result' GROUP BY ALL)
SELECT u.conv_id, u.turn, u.kind, 'c' || u.c AS call_id,
 CASE WHEN u.kind = 'result' AND calls.turn > u.turn THEN calls.turn ELSE u.turn END AS at_turn, CASE WHEN u.kind = 'result' AND calls.turn > u.turn THEN 1 ELSE 0 END AS depth,
 CASE u.kind WHEN 'call' THEN a.c IS NOT NULL ELSE calls.turn IS NOT NULL END AS is_linked,
 CASE WHEN u.kind = 'call' AND t.conv_id IS NOT NULL THEN u.turn % 5 <> 0 END AS is_valid,
 coalesce(CASE WHEN u.kind = 'call' AND u.turn >= 3 THEN r.turn IS NULL END, false) AS is_unknown
FROM u LEFT JOIN calls ON calls.conv_id = u.conv_id AND calls.turn = u.c LEFT JOIN answers a ON a.conv_id = u.conv_id AND a.c = u.c
LEFT JOIN (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0) t ON t.conv_id = u.conv_id
LEFT JOIN calls r ON r.conv_id = u.conv_id AND r.turn = u.turn - 2"""


def tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of ``tool_turns`` with their order keys, links and verdicts."""
    out = linked(tool_turns(spark, sf_dir)).where(F.col("kind").isin("call", "result"))
    unknown = F.coalesce(F.contains("error", F.lit("reference to no call")), F.lit(False))
    return out.select("conv_id", "turn", "kind", "call_id", "at_turn", "depth", "is_linked", "is_valid", unknown.alias("is_unknown"))
