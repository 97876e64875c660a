"""Tool-call linking for chat data: join calls and results, order them, validate arguments, write canonical JSON.

Calls and results are joined on (conversation, identifier).  A call depends on
the calls its arguments name as "${identifier}"; levels come from joins over all conversations at once (pointer
jumping along chains, peeling where calls have several dependencies), and what
remains lies on a cycle.  A row is one call with
its result, one result without a call, or one plain message, so nothing is
gathered by conversation; order by (conv_id, level, turn) to read one.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

REFERENCE = r"\$\{([^{}]+)\}"
#: Argument schemas by tool name (a subset of JSON Schema: type, required, properties, additionalProperties, lengths, bounds, enum).
SCHEMAS = {
    "reply": {
        "type": "object",
        "required": ["prompt", "turn"],
        "additionalProperties": False,
        "properties": {
            "prompt": {"type": "string", "minLength": 1, "maxLength": 400},
            "turn": {"type": "integer", "minimum": 0, "maximum": 1000},
            "context": {"type": "string"},
        },
    }
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_CALL = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>>,content:string>"
_RESULT = "struct<tool_call_id:string,content:string>"


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Calls, results, plain messages and contents beside calls of (conv_id, turn, role, text) whose texts are JSON of the usual chat form.

    Assistant texts {"tool_calls": [{"id", "name", "arguments"}]} give calls, and so do those
    with {"id", "function": {"name", "arguments"}} in the list; arguments are JSON in a string or an
    object.  Tool texts {"tool_call_id", "content"} give a result.  Everything else is plain: broken
    JSON, a list of calls none of which has an id, and a text with a call that has no name in either form,
    which so keeps all it says.  The content that an assistant text has beside its calls is plain too.
    """
    rows = messages.select("conv_id", "turn", "role", "text", F.from_json("text", _CALL).alias("c"), F.from_json("text", _RESULT).alias("r"))
    name, arguments = (lambda x, f=f: F.coalesce(x[f], x["function"][f]) for f in ("name", "arguments"))
    known = F.exists("c.tool_calls", lambda x: x["id"].isNotNull()) & F.forall("c.tool_calls", lambda x: x.isNull() | name(x).isNotNull())
    is_call = F.coalesce((F.col("role") == "assistant") & known, F.lit(False))
    is_result = F.coalesce((F.col("role") == "tool") & F.col("r.tool_call_id").isNotNull(), F.lit(False))
    calls = rows.filter(is_call).select("conv_id", "turn", F.explode("c.tool_calls").alias("x")).filter("x IS NOT NULL")
    calls = calls.select("conv_id", "turn", F.col("x.id").alias("call_id"), name(F.col("x")).alias("name"), arguments(F.col("x")).alias("arguments"))
    results = rows.filter(is_result & ~is_call).select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))
    beside = rows.filter(is_call & (F.col("c.content") != "")).select("conv_id", "turn", "role", F.col("c.content").alias("text"))
    return calls, results, rows.filter(~is_call & ~is_result).select("conv_id", "turn", "role", "text"), beside


def turns_as_calls(plain: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read plain turns as calls: a user turn calls ``reply``, the assistant turn right after it is the result.

    A call names the user turn two before as its context, so it depends on that
    call if there is one.  Rows of one conversation, turn and role are one call or
    result, the least of them, as the contract's SQL has it; n counts them.  Other
    roles stay plain messages.
    """
    name = lambda shift: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - shift).cast("string"))
    context = F.when(F.col("turn") >= 2, F.concat(F.lit("${"), name(2), F.lit("}")))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    is_call, is_result = F.coalesce(known & (F.col("role") == "user"), F.lit(False)), F.coalesce(known & (F.col("role") == "assistant"), F.lit(False))
    arguments = F.to_json(F.struct(context.alias("context"), F.col("text").alias("prompt"), "turn"))
    calls = plain.filter(is_call).select("conv_id", "turn", name(0).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    results = plain.filter(is_result).select("conv_id", "turn", name(1).alias("call_id"), F.col("text").alias("content"))
    return _least(calls, ["name", "arguments"]), _least(results, ["content"]), plain.filter(~is_call & ~is_result)


def problems(value, schema: dict, path: str = "") -> list[str]:
    """Names of the schema's rules that a value breaks, with where."""
    kind, at = schema.get("type"), path or "."
    if kind in ("integer", "number"):
        good = isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
    else:
        good = kind is None or isinstance(value, _TYPES[kind])
    if not good:
        return [f"type {at}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"enum {at}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"minLength {at}")
        if len(value) > schema.get("maxLength", len(value)):
            found.append(f"maxLength {at}")
    if kind in ("integer", "number"):
        if value < schema.get("minimum", value):
            found.append(f"minimum {at}")
        if value > schema.get("maximum", value):
            found.append(f"maximum {at}")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"required {path}.{k}" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            found += [f"additional {path}.{k}" for k in sorted(value) if k not in own]
        for k in sorted(value):
            if k in own:
                found += problems(value[k], own[k], f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += problems(x, schema["items"], f"{path}.{i}")
    return found


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and no escapes but those that JSON asks for."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _unique(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key is repeated")
    return found


def _writer(schemas: dict):
    @F.arrow_udf("struct<json:string,errors:array<string>>")
    def write(call_id: pa.Array, name: pa.Array, arguments: pa.Array, content: pa.Array, role: pa.Array, kind: pa.Array) -> pa.Array:
        rows = []
        for i, n, a, c, r, k in zip(*(x.to_pylist() for x in (call_id, name, arguments, content, role, kind))):
            errors = []
            if k == "message":
                out = {"content": c, "role": r}
            elif k == "orphan":
                out = {"content": c, "role": "tool", "tool_call_id": i}
            else:
                try:
                    value = json.loads(a if a is not None else "{}", object_pairs_hook=_unique, parse_constant=_no_constant)
                    errors = problems(value, schemas[n]) if n in schemas else ["unknown tool"]
                    out = {"arguments": value, "id": i, "name": n}
                except (ValueError, RecursionError):
                    errors, out = ["not JSON"], {"arguments": a, "id": i, "name": n}
                if k == "linked":
                    out["result"] = c
            rows.append({"json": canonical(out), "errors": errors})
        return pa.array(rows, pa.struct([("json", pa.string()), ("errors", pa.list_(pa.string()))]))

    return write


def _follow_chains(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, end, steps) of calls with one dependency: where the chain of such calls ends, by pointer jumping; calls of a cycle are left out."""
    keys = ["conv_id", "call_id"]
    starts = single.select("conv_id", F.col("call_id").alias("dep")).withColumn("more", F.lit(True))
    at = single.join(starts, ["conv_id", "dep"], "left").select(*keys, F.col("dep").alias("end"), F.lit(1).alias("steps"), F.col("more").isNull().alias("done"))
    at = checkpointed(at)
    n, reach = at.count(), 1
    while reach <= n and not at.filter("NOT done").isEmpty():
        on = at.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("end2"), F.col("steps").alias("steps2"), F.col("done").alias("done2"))
        moved = at.filter("NOT done").join(on, ["conv_id", "end"])
        moved = moved.select(*keys, F.col("end2").alias("end"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("done2").alias("done"))
        at, reach = checkpointed(at.filter("done").unionByName(moved)), reach * 2
    return at.filter("done").drop("done")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level int): 0 without dependencies, else one more than the highest of them; null on or behind a cycle.

    References to calls that do not exist are no dependencies.  Chains of calls
    with one dependency each are followed by pointer jumping, so a long dialogue
    takes a logarithmic number of rounds; only calls with several dependencies are
    peeled off level by level.
    """
    keys = ["conv_id", "call_id"]
    nodes = calls.select(*keys)
    edges = calls.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)))).alias("dep"))
    edges = checkpointed(edges.join(nodes.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_semi"))
    counts = checkpointed(edges.groupBy(*keys).agg(F.count("*").alias("n"), F.first("dep").alias("dep")))
    chains = checkpointed(_follow_chains(counts.filter("n = 1").drop("n")))
    roots = nodes.join(counts, keys, "left_anti").withColumn("level", F.lit(0))
    # Calls with several dependencies: each edge leads to a root or to another such call, over some steps.
    single = counts.filter("n = 1").select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("single"))
    ends = chains.withColumnRenamed("call_id", "dep")
    open_edges = edges.join(counts.filter("n > 1").select(*keys), keys, "left_semi").join(single, ["conv_id", "dep"], "left").join(ends, ["conv_id", "dep"], "left")
    open_edges = open_edges.select(
        *keys, F.when(F.col("single"), F.col("end")).otherwise(F.col("dep")).alias("dep"), (1 + F.coalesce("steps", F.lit(0))).alias("steps"), F.lit(None).cast("int").alias("level")
    )
    open_edges, frontier, done = checkpointed(open_edges), roots, [roots]
    while not open_edges.isEmpty():
        new = frontier.select("conv_id", F.col("call_id").alias("dep"), F.col("level").alias("found"))
        filled = open_edges.join(new, ["conv_id", "dep"], "left").withColumn("level", F.coalesce("level", F.col("found") + F.col("steps"))).drop("found")
        filled = checkpointed(filled)
        state = filled.groupBy(*keys).agg(F.count_if(F.col("level").isNull()).alias("missing"), F.max("level").alias("level"))
        frontier = checkpointed(state.filter("missing = 0").select(*keys, "level"))
        if frontier.isEmpty():
            break
        done.append(frontier)
        open_edges = filled.join(frontier.select(*keys), keys, "left_anti")
    anchors = done[0]
    for one in done[1:]:
        anchors = anchors.unionByName(one)
    along = chains.join(anchors.select("conv_id", F.col("call_id").alias("end"), F.col("level").alias("low")), ["conv_id", "end"])
    placed = anchors.unionByName(along.select(*keys, (F.col("low") + F.col("steps")).alias("level")))
    return nodes.join(placed, keys, "left")


def _least(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each (conv_id, call_id): the least by turn and content, and how many there were (n); combined before any shuffle."""
    found = rows.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", *fields)).alias("v"), F.count("*").alias("n"))
    return found.select("conv_id", "v.turn", "call_id", *[f"v.{f}" for f in fields], "n")


def _numbered(rows: DataFrame, fields: list[str], count: str) -> DataFrame:
    """Each row with a key of its own: the identifier for its first row by turn and content, the identifier and a number for further ones."""
    same = W.partitionBy("conv_id", "call_id")
    nth = F.row_number().over(same.orderBy("turn", *fields))
    out = rows.withColumn(count, F.sum("n").over(same)).withColumn("nth", nth).drop("n")
    return out.withColumn("key", F.when(F.col("nth") == 1, F.col("call_id")).otherwise(F.concat("call_id", F.lit("\0"), F.col("nth").cast("string"))))


def link(calls: DataFrame, results: DataFrame, plain: DataFrame, schemas: dict | None = None) -> DataFrame:
    """(conv_id, turn, call_id, level, status, n_calls, n_results, errors, json).

    status is linked, unanswered (a call without a result), orphan (a result
    without a call), cycle (linked or not, but never ready to run) or message.
    Calls and results of one identifier are paired in order of turn, then content;
    those left over are unanswered or orphans, and references name the first call.
    n_calls and n_results say how many calls, or results, share the identifier of
    the row's own.  A call or result with a null conversation or identifier links to
    nothing and keeps its row.
    """
    calls, results = (x if "n" in x.columns else x.withColumn("n", F.lit(1).cast("long")) for x in (calls, results))
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    own = checkpointed(_numbered(calls.filter(keyed), ["name", "arguments"], "n_calls"))
    answers = _numbered(results.filter(keyed), ["content"], "n_results").withColumnsRenamed({"turn": "result_turn", "call_id": "result_id", "nth": "result_nth"})
    depth = levels(own.select("conv_id", F.col("key").alias("call_id"), "arguments")).withColumnRenamed("call_id", "key")
    joined = own.join(answers, ["conv_id", "key"], "full_outer").join(depth, ["conv_id", "key"], "left")
    joined = joined.withColumn("call_id", F.coalesce("call_id", "result_id"))
    kind = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    base = ["conv_id", "turn", "call_id", "level", "name", "arguments", "content", "role", "kind", "n_calls", "n_results"]
    linked = joined.withColumn("kind", kind).withColumn("turn", F.coalesce("turn", "result_turn")).withColumn("role", F.lit(None).cast("string"))
    linked = checkpointed(linked.select(*base, F.coalesce("nth", "result_nth").alias("nth")))
    linked = linked.filter("nth > 1").unionByName(linked.filter("nth = 1")).drop("nth")
    lone_calls = calls.filter(~keyed).withColumns({"level": F.lit(0), "content": F.lit(None).cast("string"), "role": F.lit(None).cast("string"), "kind": F.lit("unanswered"), "n_calls": F.lit(1).cast("long"), "n_results": F.lit(None).cast("long")})
    lone_results = results.filter(~keyed).withColumns({"level": F.lit(None).cast("int"), "name": F.lit(None).cast("string"), "arguments": F.lit(None).cast("string"), "role": F.lit(None).cast("string"), "kind": F.lit("orphan"), "n_calls": F.lit(None).cast("long"), "n_results": F.lit(1).cast("long")})
    others = plain.select("conv_id", "turn", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.col("text").alias("content"), "role", F.lit("message").alias("kind"), F.lit(None).cast("long").alias("n_calls"), F.lit(None).cast("long").alias("n_results"))
    rows = linked.unionByName(lone_calls.select(*base)).unionByName(lone_results.select(*base)).unionByName(others)
    write = _writer(SCHEMAS if schemas is None else schemas)
    rows = rows.withColumn("w", write("call_id", "name", "arguments", "content", "role", "kind"))
    status = F.when(F.col("kind").isin("linked", "unanswered") & F.col("level").isNull(), "cycle").otherwise(F.col("kind"))
    return rows.select(
        "conv_id", "turn", "call_id", "level", status.alias("status"), F.coalesce("n_calls", F.lit(0).cast("long")).alias("n_calls"),
        F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"), F.array_join("w.errors", "; ").alias("errors"), F.col("w.json").alias("json"),
    )


def format_conversations(messages: DataFrame, schemas: dict | None = None, read_turns: bool = True) -> DataFrame:
    """Link the calls of a table (conv_id, turn, role, text); other columns are ignored.

    JSON calls and results are taken first; with ``read_turns`` the plain turns left
    are read as calls of ``reply``.  Null texts, roles and turns make plain messages
    or calls without an identifier; an empty table gives an empty result.
    """
    calls, results, plain, beside = extract(messages)
    if read_turns:
        more_calls, more_results, plain = turns_as_calls(plain)
        one = F.lit(1).cast("long")
        calls, results = calls.withColumn("n", one).unionByName(more_calls), results.withColumn("n", one).unionByName(more_results)
    return link(calls, results, plain.unionByName(beside), schemas)
