"""Chat formatting with tool-call linking.

Messages whose text is a JSON object may define tools ({"tools": [...]}), call them ({"tool_calls": [{"id", "name", "arguments"}]}) or
answer a call ({"tool_call_id", "content"}).  Calls and results are linked by a hash join on conversation
and identifier.  A result comes after its call, and a call after the results that its arguments mention as
"$call:<id>"; messages otherwise keep the order of turns.  Positions come from topological places (``ordering``) and a
distributed rank, so a conversation of any length is dealt to many tasks. Arguments are validated against the schemas of
the conversation's tools, and each message is serialised as canonical JSON.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .ordering import LOCAL, places
from .schema import canonical, label, loads, verdict

_REF = re.compile(r"^\$call:(.+)$", re.S)


def _refs(x) -> set[str]:
    if isinstance(x, str):
        m = _REF.match(x)
        return {m[1]} if m else set()
    return set().union(*map(_refs, x.values() if isinstance(x, dict) else x)) if isinstance(x, (dict, list)) else set()


def _named(x) -> tuple[str, object] | None:
    f = x.get("function", x) if isinstance(x, dict) else None
    return (f["name"], f) if isinstance(f, dict) and isinstance(f.get("name"), str) else None


def parse(role: str | None, text: str | None) -> tuple[dict, list[dict], dict | None, list[dict]]:
    """(message, calls, result, tools) of a row."""
    body = None
    if text and text.lstrip()[:1] == "{":
        body, _ = loads(text)
    message: dict = {"role": role, "content": text}
    if not isinstance(body, dict) or not {"tool_calls", "tool_call_id", "tools"} & body.keys():
        return message, [], None, []
    message["content"] = body.get("content")
    calls, tools, result = [], [], None
    for c in body.get("tool_calls") or [] if isinstance(body.get("tool_calls"), list) else []:
        named = _named(c)
        if named is None or not isinstance(c.get("id"), (str, int)):
            continue
        args = named[1].get("arguments", {})
        if isinstance(args, str):
            args, _ = loads(args)
        calls.append({"id": label(c["id"]), "name": label(named[0]), "arguments": canonical(args), "refs": sorted(map(label, _refs(args)))})
    for t in body.get("tools") or [] if isinstance(body.get("tools"), list) else []:
        if named := _named(t):
            tools.append({"name": label(named[0]), "schema": canonical(named[1].get("parameters", {}))})
    if isinstance(body.get("tool_call_id"), (str, int)):
        result = {"id": label(body["tool_call_id"])}
        message["tool_call_id"] = result["id"]
    if calls:
        message["tool_calls"] = [{"id": c["id"], "name": c["name"], "arguments": loads(c["arguments"])[0]} for c in calls]
    if tools:
        message["tools"] = [{"name": t["name"], "parameters": loads(t["schema"])[0]} for t in tools]
    return message, calls, result, tools


_PARSED = "m long, conv_id long, turn long, role string, json string, calls array<struct<id:string,name:string,arguments:string,refs:array<string>>>, result string, tools array<struct<name:string,schema:string>>"


def _parse(batches):
    m = TaskContext.get().partitionId() << 33
    call = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("refs", pa.list_(pa.string()))])
    tool = pa.struct([("name", pa.string()), ("schema", pa.string())])
    for b in batches:
        got = [parse(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        cols = [pa.array(m + np.arange(b.num_rows)), b.column(0), b.column(1), b.column(2), pa.array([canonical(g[0]) for g in got])]
        cols += [pa.array([g[1] for g in got], pa.list_(call)), pa.array([g[2]["id"] if g[2] else None for g in got], pa.string()), pa.array([g[3] for g in got], pa.list_(tool))]
        m += b.num_rows
        yield pa.RecordBatch.from_arrays(cols, ["m", "conv_id", "turn", "role", "json", "calls", "result", "tools"])


def _checked(batches):
    for b in batches:
        ok = [s is not None and verdict(loads(a)[0], loads(s)[0]) for a, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ok, pa.bool_())], ["m", "ok"])


def _ranked(df: DataFrame, keys: list[str]) -> DataFrame:
    """``position``: the rank of each row in its conversation by ``keys``, from 0.  Rows are dealt by range, so a long conversation spans tasks."""

    def number(batches):
        pid = TaskContext.get().partitionId()
        last, n = object(), 0
        for b in batches:
            local = np.zeros(b.num_rows, np.int64)
            for i, c in enumerate(b.column(0).to_pylist()):
                n = n + 1 if c == last else 0
                last, local[i] = c, n
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(local)], ["m", "conv_id", "pid", "local"])

    dealt = df.repartitionByRange("conv_id", *keys, "m").sortWithinPartitions("conv_id", *keys, "m")
    local = stored(dealt.select("conv_id", "m").mapInArrow(number, "m long, conv_id long, pid int, local long"))
    parts = local.groupBy("conv_id", "pid").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.withColumn("start", F.coalesce(before, F.lit(0))).where("start > 0").select(F.col("conv_id").alias("c"), F.col("pid").alias("p"), "start")
    at = local.join(starts, local.conv_id.eqNullSafe(F.col("c")) & (local.pid == F.col("p")), "left")
    return at.select("m", (F.col("local") + F.coalesce("start", F.lit(0))).alias("position"))


def format_chats(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", local: int = LOCAL) -> DataFrame:
    """One row per input row: conv_id, turn, position, role, n_calls, n_linked, n_valid, n_unchecked, status, json.

    position: rank in the conversation, in topological order.  n_linked: calls of the message that have a result.  n_valid: calls
    whose arguments meet the schema of a tool that the conversation defines (of several definitions, the canonically smallest).  n_unchecked: calls for which that
    cannot be said, as the schema is malformed or has a pattern that cannot be followed in time (``schema.verdict``); the others of n_calls break the schema or name no tool of the conversation.  status: "plain", "calls", "linked" (a result with
    a call), "duplicate" (a result after the first of its call), "orphan" (a result without a call) or "cycle" (the message depends on
    itself and stays at its turn).  Of several calls with one identifier the first holds it.
    A null turn sorts first, a null conversation is one of its own, a null role or text is null in the JSON.  Repeated rows are
    repeated messages.  A text that is no JSON, or nests deeper than 128 levels, is plain; a schema that is malformed leaves its calls unchecked; half a
    surrogate pair is written as its escape.  ``local``: links of a connected part that one task may hold. Other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(messages.sparkSession)
    picked = messages.select(F.col(conv_col).cast("long"), F.col(turn_col).cast("long"), F.col(role_col).cast("string"), F.col(text_col).cast("string"))
    parsed = stored(picked.mapInArrow(_parse, _PARSED))
    c = F.coalesce("conv_id", F.lit(-(2**63)))
    t = F.coalesce("turn", F.lit(-(2**63)))
    rows = parsed.select(c.alias("c"), t.alias("t"), "m", "calls", "result", "tools")
    calls = rows.select("c", "t", "m", F.explode("calls").alias("x")).select("c", "t", "m", "x.*")
    first = calls.groupBy("c", "id").agg(F.min(F.struct("t", "m")).alias("at")).select("c", "id", F.col("at.m").alias("call"))
    results = rows.where("result is not null").select("c", "t", "m", F.col("result").alias("id"))
    answer = results.groupBy("c", "id").agg(F.min(F.struct("t", "m")).alias("at")).select("c", "id", F.col("at.m").alias("answer"))
    linked = first.join(answer, ["c", "id"])
    state = results.join(first.join(answer, ["c", "id"]), ["c", "id"], "left").select("m", F.when(F.col("call").isNull(), "orphan").when(F.col("answer") == F.col("m"), "linked").otherwise("duplicate").alias("result_state"), "call")
    state = stored(state)
    n_linked = calls.join(linked, ["c", "id"]).where("call = m").groupBy("m").agg(F.count("*").alias("n_linked"))

    tools = rows.select("c", F.explode("tools").alias("x")).groupBy("c", F.col("x.name").alias("name")).agg(F.min("x.schema").alias("schema"))
    valid_ = calls.join(tools, ["c", "name"], "left").select("m", "arguments", "schema").mapInArrow(_checked, "m long, ok boolean")
    n_valid = valid_.groupBy("m").agg(F.sum(F.col("ok").cast("long")).alias("n_valid"), F.count_if(F.col("ok").isNull()).alias("n_unchecked"))

    # order: a result after its call, a call after the results that it mentions
    after = state.where("call is not null and call <> m").select(F.col("call").alias("a"), F.col("m").alias("b"))
    uses = calls.select("c", F.col("m").alias("b"), F.explode("refs").alias("id")).join(answer, ["c", "id"]).select(F.col("answer").alias("a"), "b")
    edges = stored(after.union(uses).distinct())
    placed = places(rows.select("m", "t"), edges, local)
    keyed = rows.join(placed, "m", "left").select(F.col("c").alias("conv_id"), "m", F.coalesce("et", "t").alias("et"), F.coalesce("level", F.lit(0)).alias("level"), "t")
    position = _ranked(keyed, ["et", "level", "t"])
    out = parsed.join(position, "m").join(state.select("m", "result_state"), "m", "left").join(n_linked, "m", "left").join(n_valid, "m", "left").join(placed.select("m", "cyclic"), "m", "left")
    status = F.when(F.col("cyclic"), "cycle").when(F.col("result_state").isNotNull(), F.col("result_state")).when(F.size("calls") > 0, "calls").otherwise("plain")
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "turn", "position", "role", F.size("calls").cast("long").alias("n_calls"), F.coalesce("n_linked", zero).alias("n_linked"), F.coalesce("n_valid", zero).alias("n_valid"), F.coalesce("n_unchecked", zero).alias("n_unchecked"), status.alias("status"), "json")
