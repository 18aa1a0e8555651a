"""Chat formatting: tool calls linked to their results.

Calls and results are joined by (conversation, identifier). The order of calls
that wait for others follows the chains of ``after``: pointer doubling finds
every call's depth in as many rounds as the logarithm of the longest chain.
Arguments are checked against a schema of fields and types, and every call
with its result becomes one line of canonical JSON (sorted keys, no blanks).
All steps are DataFrame functions.

Defined results: a call or result without conversation or identifier is left
out; of repeats of one identifier in a conversation the first (least turn,
then text) speaks, and their number is given; a call without a result has
status ``open``, a result without a call ``orphan``; a call that waits for an
unknown one starts a chain; calls in a circle have depth null and status
``circle``; arguments that are null or not a JSON object are canonicalised as
null and fail their check, as does a tool without a schema; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from veldra.llm.store import staged

#: JSON types by the names that variants use.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}

Schemas = dict[str, dict[str, tuple[str, bool]]]


def _first(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each (conv_id, call_id), aggregated before it is shuffled, with the number of rows as ``repeats``."""
    least = F.min(F.struct("turn", *columns)).alias("f")
    rows = rows.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(least, F.count("*").alias("repeats"))
    return rows.select("conv_id", "call_id", "repeats", "f.turn", *[F.col(f"f.{c}") for c in columns])


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and depth (0 for the first of a chain, null in or behind a circle)."""
    nodes = calls.select("conv_id", "call_id", "after")
    known = nodes.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    state = nodes.join(known, ["conv_id", "after"], "left").select("conv_id", "call_id", F.when(F.col("known"), F.col("after")).alias("up"))
    state = staged(state.withColumn("depth", F.when(F.col("up").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long")), "chains")
    total = state.count()
    while True:
        # rows whose ancestor is not yet the first of a chain jump on; no chain is longer than all calls
        open_, most = state.agg(F.count_if(F.col("up").isNotNull()), F.max("depth")).first()
        if not open_ or most > total:
            break
        other = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = state.join(other, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        state = staged(state, "chains")
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def _faults(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Names of missing, unknown and ill-typed fields, each after its fault."""
    keys = F.coalesce(F.json_object_keys(arguments), F.array())
    value = F.try_parse_json(arguments)
    unknown = F.transform(F.array(F.concat(F.lit("no_schema:"), F.coalesce(name, F.lit("")))), lambda x: x)
    by_name = F.when(F.lit(False), unknown)
    for tool, fields in schemas.items():
        wrong: list[Column] = [F.when(F.coalesce(F.json_object_keys(arguments).isNull(), F.lit(True)), F.lit("not_an_object"))]
        for field, (kind, required) in fields.items():
            has = F.array_contains(keys, field)
            typed = F.schema_of_variant(F.try_variant_get(value, f"$['{field}']", "variant"))
            fits = functools.reduce(lambda a, b: a | b, [typed.startswith(t) for t in TYPES[kind]])
            wrong.append(F.when(has & ~F.coalesce(fits, F.lit(False)), F.lit(f"type:{field}")))
            if required:
                wrong.append(F.when(~has, F.lit(f"missing:{field}")))
        extra = F.transform(F.array_except(keys, F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")), lambda k: F.concat(F.lit("unknown:"), k))
        by_name = by_name.when(name == tool, F.array_sort(F.concat(F.array_compact(F.array(*wrong)), extra)))
    return by_name.otherwise(unknown)


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """conv_id, call_id, turn, result_turn, depth, status, faults, repeats and line (canonical JSON) of every call and orphan result.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), after (a call_id or null); ``results``: conv_id, turn, call_id, content.
    """
    left = staged(_first(calls, "name", "arguments", "after"), "calls")
    right = _first(results, "content").select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.col("repeats").alias("result_repeats"), F.lit(True).alias("answered"))
    both = left.withColumn("called", F.lit(True)).join(right, ["conv_id", "call_id"], "full_outer").join(depths(left), ["conv_id", "call_id"], "left")
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("depth").isNull(), "circle").when(F.col("answered").isNull(), "open").otherwise("linked")
    both = both.withColumn("status", status)
    faults = F.when(F.col("called").isNull(), F.array().cast("array<string>")).otherwise(_faults(F.col("name"), F.col("arguments"), schemas))
    both = both.withColumn("faults", faults)
    arguments = F.when(F.json_object_keys(F.col("arguments")).isNotNull(), F.to_json(F.try_parse_json("arguments")))
    quoted = lambda c: F.coalesce(F.to_json(F.try_parse_json(F.expr(f"substring(to_json(named_struct('x', {c})), 6, length(to_json(named_struct('x', {c}))) - 6)"))), F.lit("null"))
    pieces = {
        "after": quoted("after"), "arguments": F.coalesce(arguments, F.lit("null")), "conv_id": F.col("conv_id").cast("string"), "depth": F.coalesce(F.col("depth").cast("string"), F.lit("null")),
        "id": quoted("call_id"), "name": quoted("name"), "result": quoted("content"), "status": quoted("status"),
    }
    line = F.concat(F.lit("{"), *[x for i, (k, v) in enumerate(pieces.items()) for x in (F.lit(f'{"," if i else ""}"{k}":'), v)], F.lit("}"))
    repeats = F.coalesce("repeats", F.lit(0)) + F.coalesce("result_repeats", F.lit(0))
    return both.select("conv_id", "call_id", "turn", "result_turn", "depth", "status", "faults", repeats.alias("repeats"), line.alias("line"))


#: The schema of the calls of ``from_turns``; ``context`` has none, so those calls carry that fault.
TURN_SCHEMAS: Schemas = {"reply": {"prompt": ("string", True), "turn": ("integer", True), "hint": ("string", False)}}


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation turns as calls and results; every row is in one of them.

    A turn of any role but assistant calls (``reply`` for a user's, ``context``
    for all others) and waits for the turn two before it; an assistant turn
    answers the turn before it. A null text is a missing prompt, a null role is
    one of the others.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))
    name = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    answers = F.coalesce(F.col("role") == "assistant", F.lit(False))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    tool = F.when(F.col("role") == "user", "reply").otherwise("context")
    calls = turns.where(~answers).select("conv_id", "turn", name(F.col("turn")).alias("call_id"), tool.alias("name"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, name(F.col("turn") - 2)).alias("after"))
    results = turns.where(answers).select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
