"""Chat formatting: links tool calls to results, orders them, validates arguments, writes canonical JSON.

Method
  * Calls are the entries of an assistant message's ``tool_calls`` (a JSON
    array of {id, name, arguments}); results are messages with a
    ``tool_call_id``, or with the role ``tool``.  They meet by an equi-join on
    (conversation, id).  Results that repeat an id are numbered by the same
    range-sorted prefix sums, so an id with many results needs no task of its own.
  * A call depends on the calls that its arguments name as ``{{id}}``.  Where
    all of them come earlier, the order of the calls (turn, index) is a
    topological order already.  A reference to a later call spans a stretch
    of the conversation; overlapping stretches are found by a sweep over
    prefix sums.  Only inside a stretch are calls peeled in rounds of joins:
    level 0 needs nothing in the stretch, else one more than the highest it
    needs there; chains of calls with one need each are contracted before, by
    pointer doubling in log rounds.  A cycle has a reference to a later (or the same) call at
    every step up, so it lies inside one stretch; its calls stay open and are
    reported.
  * Position in the conversation follows (stretch or own place, level, place),
    by range-sorted prefix sums, so a conversation of any length needs no task
    of its own, and rounds grow only with chains of calls that have several
    needs inside a stretch.
  * Arguments are checked against the tool's JSON schema (type, properties,
    required, additionalProperties, enum, items, minimum, maximum, minLength,
    maxLength), and the linked call is written as canonical JSON: sorted keys,
    no spaces, no escapes beyond what JSON needs.

Output: one row per call, one per result without a call and one per further
result of a call (left out with ``every_result=False``).
``status``: ok, invalid arguments, unknown tool, no result, cycle, duplicate
id, orphan result, duplicate result (in this order of precedence from the end).

Defined cases: of calls that repeat an id in a conversation the first (turn,
index) is linked, the others are ``duplicate id``; of results that repeat an
id the first (turn, text) is linked, the others are ``duplicate result`` and
come last in the conversation; without a call each is an ``orphan result``.  Null or unreadable ``tool_calls`` hold
no calls; arguments that are not strict JSON (NaN, Infinity, numbers beyond a
double, integers of more than 4,300 digits) are invalid and appear as the raw
string; integers of any size below are kept digit by digit; a lone surrogate is
written as its escape; of a repeated key the last value counts and the key is
an error.
Null conversation ids form a conversation of their own; calls with null ids
link with nothing, and results of the role ``tool`` with null ids are orphans.  A dependency on an unknown id is ignored.  Empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcat.llm.op7 import prefix_sums
from fleetcat.llm.runtime import map_arrow, written

_CALLS = "array<struct<id string, name string, arguments string>>"
_SURROGATE = re.compile("[\ud800-\udfff]")
_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def _well_formed(text: str) -> str:
    """``text`` with lone surrogates, which UTF-8 cannot hold, as JSON escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value) -> str:
    return _well_formed(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def parsed(text: str) -> tuple[object, list[str]]:
    """(value, keys that an object repeats) of strict JSON: no NaN or Infinity, no number beyond a double."""
    repeated: list[str] = []

    def number(x: str) -> float:
        value = float(x)
        if not math.isfinite(value):
            raise ValueError(x)
        return value

    def refuse(x: str):
        raise ValueError(x)

    def members(pairs: list) -> dict:
        seen = dict(pairs)
        if len(seen) < len(pairs):
            repeated.extend(k for k, n in Counter(k for k, _ in pairs).items() if n > 1)
        return seen

    value = json.loads(text, parse_float=number, parse_constant=refuse, object_pairs_hook=members)
    return value, sorted(repeated)


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks the schema, as texts, in the order of the keys."""
    kind = schema.get("type")
    if kind in ("number", "integer"):
        good = isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    else:
        good = kind not in _TYPES or isinstance(value, _TYPES[kind])
    if not good:
        return [f"{at}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not an allowed value")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below {schema['minimum']}")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(set(schema.get("required", [])) - value.keys())]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    return out


def _check(batches, tools: dict):
    for batch in batches:
        rows = batch.to_pylist()
        errors, records = [], []
        for r in rows:
            if r["name"] is None and r["arguments"] is None and r["orphan"]:
                errors.append([])
                records.append(canonical({"id": r["call_id"], "result": r["result"]}))
                continue
            try:
                args, repeated = parsed(r["arguments"])
                bad = [f"$: repeated key {k}" for k in repeated] + (violations(args, tools[r["name"]]) if r["name"] in tools else [])
                record = {"arguments": args, "id": r["call_id"], "name": r["name"], "result": r["result"]}
                record = canonical(record)
            except (TypeError, ValueError, RecursionError):
                bad = ["$: not JSON"]
                record = canonical({"arguments": r["arguments"], "id": r["call_id"], "name": r["name"], "result": r["result"]})
            if r["name"] not in tools:
                bad = ["unknown tool", *bad]
            errors.append([_well_formed(x) for x in bad])
            records.append(record)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.list_(pa.string())), pa.array(records, pa.string())],
                                         names=["info", "errors", "record"])


def _chains(single: DataFrame) -> DataFrame:
    """(conv, call_id, to, dist) of calls with one need: the first call down the chain that has none or several, by pointer doubling.

    ``single``: (conv, call_id, need).  On and behind a cycle of such calls ``to`` is one of them.
    """
    jumps = written(single.select("conv", "call_id", F.col("need").alias("to"), F.lit(1).cast("long").alias("dist")), "chains")
    for _ in range(jumps.count().bit_length()):
        step = jumps.select("conv", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("dist").alias("more"))
        doubled = written(jumps.join(step, ["conv", "to"], "left"), "chains")
        jumps = doubled.select("conv", "call_id", F.coalesce("next", "to").alias("to"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"))
        if doubled.where("next is not null").isEmpty():
            break
    return jumps


def _peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, call_id, level) of the nodes; level is null on cycles and behind them.  ``edges``: (conv, call_id, need), distinct.

    Chains of calls with one need each are contracted first, so rounds grow only with calls that have several.
    """
    key = ["conv", "call_id"]
    degree = written(edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("need").alias("need")), "degrees")
    chains = _chains(degree.where("n = 1"))
    roots = nodes.join(degree, key, "left_anti").select(*key, F.lit(0).cast("long").alias("level"))
    through = chains.select("conv", F.col("call_id").alias("need"), "to", "dist")
    several = edges.join(degree.where("n > 1").select(*key), key, "left_semi").join(through, ["conv", "need"], "left")
    several = several.select(*key, F.coalesce("to", "need").alias("need"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist"), F.lit(None).cast("long").alias("got"))
    latest = levels = roots
    while True:
        known = latest.select("conv", F.col("call_id").alias("need"), F.col("level").alias("below"))
        several = written(several.join(known, ["conv", "need"], "left").select(
            *key, "need", "dist", F.coalesce("got", F.col("below") + F.col("dist")).alias("got")), "needs")
        latest = written(several.groupBy(*key).agg(F.max("got").alias("level"), F.count_if(F.col("got").isNull()).alias("open"))
                         .where("open = 0").select(*key, "level"), "level")
        if latest.isEmpty():
            break
        levels = levels.union(latest)
        several = several.join(latest, key, "left_anti")
    behind = chains.join(levels.withColumnRenamed("call_id", "to"), ["conv", "to"], "left").select(*key, (F.col("level") + F.col("dist")).alias("level"))
    never = several.select(*key).distinct().withColumn("level", F.lit(None).cast("long"))
    return levels.union(behind).union(never).withColumn("level", F.col("level").cast("int"))


def stretches(calls: DataFrame, needs: DataFrame) -> DataFrame | None:
    """(conv, call_id, stretch, level) of the calls inside stretches; None if no reference points to a later call.

    ``calls``: (conv, call_id, place), ids unique in a conversation;
    ``needs``: (conv, call_id, need).  ``stretch`` is the place where it begins.
    """
    at = calls.select("conv", F.col("call_id").alias("need"), F.col("place").alias("need_place"))
    edges = written(needs.join(calls, ["conv", "call_id"]).join(at, ["conv", "need"]).distinct(), "needs")
    ahead = edges.where("need_place >= place")
    if ahead.isEmpty():
        return None
    # a sweep over each conversation: +1 where a reference starts, -1 after it ends
    event = lambda place, kind, step: [place.alias("place"), F.lit(kind).alias("kind"), F.lit(step).alias("step")]
    none = F.lit(None).cast("string").alias("call_id")
    events = ahead.select("conv", none, *event(F.col("place"), 0, 1)).union(ahead.select("conv", none, *event(F.col("need_place"), 2, -1)))
    inside = calls.join(ahead.select("conv").distinct(), "conv", "left_semi").select("conv", "call_id", *event(F.col("place"), 1, 0))
    swept = prefix_sums(events.union(inside), "conv", ["place", "kind", "call_id"], "step", "sweep").withColumnRenamed("before", "open") \
        .withColumn("begins", ((F.col("kind") == 0) & (F.col("open") == 0)).cast("int"))
    swept = prefix_sums(swept, "conv", ["place", "kind", "call_id", "open"], "begins", "sweep").withColumn("number", F.col("before") + F.col("begins"))
    start = swept.where("begins = 1").select("conv", "number", F.col("place").alias("stretch"))
    nodes = written(swept.where("kind = 1 and open > 0").join(start, ["conv", "number"]).select("conv", "call_id", "stretch"), "stretches")
    same = nodes.select("conv", F.col("call_id").alias("need"), F.col("stretch").alias("need_stretch"))
    own = written(edges.join(nodes, ["conv", "call_id"]).join(same, ["conv", "need"]).where("stretch = need_stretch").select("conv", "call_id", "need"), "needs")
    return nodes.join(_peeled(nodes, own), ["conv", "call_id"])


def _further_results(results: DataFrame, calls: DataFrame) -> DataFrame | None:
    """(conv, call_id, conv_id, turn, text, copy, kind) of all results but the first of their id; None if no id repeats."""
    key = ["conv", "call_id"]
    repeated = written(results.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "repeated")
    if repeated.isEmpty():
        return None
    again = results.join(repeated, key, "left_semi").withColumn("key", F.struct(*key)).withColumn("one", F.lit(1))
    again = prefix_sums(again, "key", ["turn", "text"], "one", "results").where("before > 0").withColumnRenamed("before", "copy").drop("key", "one")
    return again.join(calls.select(*key, F.lit(2).alias("kind")), key, "left").withColumn("kind", F.coalesce("kind", F.lit(1)))


def linked_calls(messages: DataFrame, tools: dict, every_result: bool = True) -> DataFrame:
    """Rows of calls, of results without a call and (unless ``every_result`` is off) of further results of a call: conv_id, call_id, name, level, position, call_turn, result_turn, status, errors, record."""
    m = messages.select("conv_id", "turn", "role", "text", F.col("tool_calls").cast("string").alias("tool_calls"), "tool_call_id")
    calls = m.select("conv_id", "turn", F.posexplode(F.from_json("tool_calls", _CALLS)).alias("at", "call")) \
        .select(F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00")).alias("conv"), "conv_id", "turn", "at",
                F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"))
    order = ["turn", "at", "call_id", "name", "arguments"]
    calls = prefix_sums(calls.withColumn("one", F.lit(1)), "conv", order, "one", "calls").withColumnRenamed("before", "place").drop("one")
    calls = written(calls, "calls")
    key = ["conv", "call_id"]
    first = calls.where("call_id is not null").groupBy(*key).agg(F.min("place").alias("first_place"), F.min_by("arguments", "place").alias("arguments"))
    answers = m.where("tool_call_id is not null or role = 'tool'").select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00")).alias("conv"), F.col("tool_call_id").alias("call_id"), "turn", "text", "conv_id")
    with_id = answers.where("call_id is not null")
    results = with_id.groupBy(*key).agg(F.min(F.struct("turn", "text")).alias("got"), F.first("conv_id").alias("rc"))

    wanted = first.select(*key, F.explode(F.expr(r"regexp_extract_all(arguments, r'\{\{([^{}]+)\}\}', 1)")).alias("need")).distinct()
    found = stretches(first.select(*key, F.col("first_place").alias("place")), wanted)
    if found is None:
        found = first.select(*key, F.col("first_place").alias("stretch"), F.lit(0).alias("level")).limit(0)
    level = found.withColumn("in_stretch", F.lit(True))

    rows = calls.join(first.select(*key, "first_place"), key, "left") \
        .withColumn("is_first", F.col("first_place").isNull() | (F.col("place") == F.col("first_place"))).drop("first_place")
    rows = rows.join(results, key, "full_outer").join(level, key, "left")
    rows = rows.withColumn("orphan", F.col("at").isNull()).withColumn("linked", F.col("orphan") | F.col("is_first"))
    result = F.when(F.col("linked"), F.col("got"))
    rows = rows.select(
        F.coalesce("conv_id", "rc").alias("conv_id"), "conv", "call_id", "name", "arguments", "orphan", F.col("orphan").cast("int").alias("kind"), F.lit(0).cast("long").alias("copy"),
        F.when(F.col("linked") & ~F.col("orphan"), F.when(F.col("in_stretch"), F.col("level")).otherwise(0)).alias("level"),
        F.coalesce(F.when(F.col("linked"), F.col("stretch")), F.col("place")).alias("stretch"), "place", F.col("turn").alias("call_turn"),
        result["turn"].alias("result_turn"), result["text"].alias("result"), "is_first",
        (F.col("linked") & F.coalesce("in_stretch", F.lit(False)) & F.col("level").isNull()).alias("cyclic"))
    others = answers.where("call_id is null").withColumn("copy", F.lit(0).cast("long")).withColumn("kind", F.lit(1))
    further = _further_results(with_id, first)
    if further is not None:
        others = others.unionByName(further)
    others = others.select("conv_id", "conv", "call_id", F.lit(True).alias("orphan"), "kind", "copy", F.col("turn").alias("result_turn"), F.col("text").alias("result"))
    rows = rows.unionByName(others, allowMissingColumns=True)
    if not every_result:
        rows = rows.where("kind < 2")
    info = [c for c in rows.columns if c not in ("name", "arguments", "result")] + ["name"]
    checked = map_arrow(
        rows.select(F.struct(*info).alias("info"), "call_id", "name", "arguments", "result", "orphan"), partial(_check, tools=tools),
        "info struct<" + ", ".join(f"{c}: {dict(rows.dtypes)[c]}" for c in info) + ">, errors array<string>, record string")
    rows = checked.select("info.*", "errors", "record")
    status = F.when(F.col("kind") == 2, "duplicate result").when(F.col("orphan"), "orphan result").when(~F.col("is_first"), "duplicate id").when(F.col("cyclic"), "cycle") \
        .when(F.col("result_turn").isNull(), "no result").when(F.array_contains("errors", "unknown tool"), "unknown tool") \
        .when(F.size("errors") > 0, "invalid arguments").otherwise("ok")
    rows = rows.withColumn("status", status).withColumn("one", F.lit(1))
    rows = prefix_sums(rows.withColumn("open_level", F.col("level").isNull()), "conv",
                       ["kind", "stretch", "open_level", "level", "place", "result_turn", "call_id", "record", "copy"], "one", "call-order")
    return rows.select("conv_id", "call_id", "name", "level", F.col("before").cast("long").alias("position"), "call_turn", "result_turn",
                       "status", "errors", "record")


def conversation_calls(conversations: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) as messages with tool calls.

    An assistant turn calls a tool with its text; the user turn that follows is
    the tool's result (role ``tool``).  From the second call on, arguments name the call before.
    """
    call = F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    before = F.concat(F.lit("{{call_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - 2).cast("string"), F.lit("}}"))
    name = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("summarise")), (F.pmod("turn", F.lit(3)) + 1).cast("int"))
    args = F.to_json(F.struct(F.col("text").alias("query"), F.pmod(F.length("text"), F.lit(10)).alias("limit"), F.when(F.col("turn") >= 3, before).alias("after")))
    calls = F.to_json(F.array(F.struct(call.alias("id"), name.alias("name"), args.alias("arguments"))))
    answered = F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - 1).cast("string"))
    result = (F.col("role") == "user") & (F.col("turn") >= 2)
    return conversations.select(
        "conv_id", "turn", F.when(result, "tool").otherwise(F.col("role")).alias("role"), "text",
        F.when(F.col("role") == "assistant", calls).alias("tool_calls"),
        F.when(result, answered).alias("tool_call_id"))


_ARGUMENTS = {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {
    "query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 9}, "after": {"type": "string"}}}
TOOLS = {"search": _ARGUMENTS, "lookup": _ARGUMENTS, "summarise": _ARGUMENTS}
