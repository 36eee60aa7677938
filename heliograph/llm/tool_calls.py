"""Tool-call linking for chat data.

Calls and results are hash-joined by conversation and identifier; calls are put in topological order of what they come
after, by levels: a call's level is one above the highest level that it comes after; arguments are validated against the tools'
schemas; each call with its result is serialised as canonical JSON (sorted keys, no blanks, no escapes beyond need, equal
numbers alike).

The order of a conversation's calls is the sort key (level, turn, call_id). Levels of a conversation of up to
``GATHERED_LINKS`` links between calls are found in one task, from identifiers alone. A larger one isn't gathered: chains
of its calls are followed by doubling, and rounds of joins are needed only for calls after several.

Defined cases: calls without an identifier are dropped; of calls with one identifier in a conversation the first turn's
counts, then the smallest arguments, and of results likewise, both with their number given. A result without a call is
left out of the links and given by :func:`orphan_results`. Messages with a null conv_id are one conversation. A
predecessor that is unknown is ignored. Calls in a cycle, and those after one, have a null level and the status ``cycle``.
Null arguments, and objects with a repeated key, are not valid JSON; arguments deeper than Python's parser goes are
``nested too deep``. A tool without a schema is ``unknown tool``; a schema that can't be decided (see
:mod:`heliograph.llm.json_schema`) gives the status ``unsupported schema`` and the reason. Extra columns are ignored.
Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import discard, materialise
from heliograph.llm.json_schema import Unsupported, canonical, load_schema, parse, violation

#: Links between the calls of a conversation up to which one task holds them, some hundred bytes each.
GATHERED_LINKS = 100_000


def _serialise(batches):
    for batch in batches:
        rows = batch.to_pylist()
        status, error, lines = [], [], []
        for r in rows:
            problem, arguments, state = None, None, "ok"
            try:
                arguments = parse(r["arguments"])
            except ValueError:
                problem, state = "not JSON", "invalid"
            except RecursionError:
                problem, state = "nested too deep", "invalid"
            if state == "ok" and not r["schema"]:
                problem, state = "unknown tool", "invalid"
            elif state == "ok":
                try:
                    if problem := violation(arguments, load_schema(r["schema"])):
                        state = "invalid"
                except (Unsupported, RecursionError) as e:
                    problem, state = str(e) if isinstance(e, Unsupported) else "circle", "unsupported schema"
            if r["level"] is None:
                state = "cycle"
            elif state == "ok" and not r["n_results"]:
                state = "no result"
            record = {"arguments": arguments, "id": r["call_id"], "name": r["name"], "result": r["result"]}
            # half a surrogate pair is JSON but not text
            status.append(state), error.append(problem), lines.append(canonical(record).encode("utf-8", "replace").decode())
        names = ["conv_id", "call_id", "turn", "level", "name", "n_calls", "n_results"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(status, pa.string()), pa.array(error, pa.string()), pa.array(lines, pa.string())], [*names, "status", "error", "json"])


def _calls(messages: DataFrame) -> DataFrame:
    calls = messages.select("conv_id", "turn", F.explode("calls").alias("c")).select("conv_id", "turn", F.col("c.id").alias("call_id"), "c.name", "c.arguments", "c.after").where(F.col("call_id").isNotNull())
    key = F.struct("turn", "arguments")
    return calls.groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("turn"), F.col("arguments"), F.col("name"), F.col("after"))).alias("c"), F.count(key).alias("n_calls")).select("conv_id", "call_id", "c.turn", "c.name", "c.arguments", "c.after", "n_calls")


def _results(messages: DataFrame) -> DataFrame:
    results = messages.where(F.col("result_of").isNotNull())
    return results.groupBy("conv_id", F.col("result_of").alias("call_id")).agg(F.min(F.struct("turn", "text")).alias("r"), F.count(F.lit(1)).alias("n_results")).select("conv_id", "call_id", F.col("r.text").alias("result"), "n_results")


def _level_batches(batches):
    """Levels of conversations whose links come one after the other: calls leave when all that they wait for have left."""

    def settle(conv, links: list[tuple[str, str]], out: list[tuple]) -> None:
        waits, after, level = Counter(), defaultdict(list), {}
        for call, before in links:
            waits[call] += 1
            after[before].append(call)
        ready = [c for c in after if not waits[c]]
        level.update(dict.fromkeys(ready, 0))
        while ready:
            done = ready.pop()
            for call in after[done]:
                level[call] = max(level.get(call, 0), level[done] + 1)
                waits[call] -= 1
                if not waits[call]:
                    ready.append(call)
        out += [(conv, call, n) for call, n in level.items() if not waits[call]]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))], ["conv", "call_id", "level"])

    conv, links = None, []
    for batch in batches:
        out: list[tuple] = []
        for c, call, before in zip(*(batch.column(n).to_pylist() for n in ("conv", "call_id", "before"))):
            if c != conv:
                settle(conv, links, out)
                conv, links = c, []
            links.append((call, before))
        yield rows(out)
    out = []
    settle(conv, links, out)
    yield rows(out)


def levels(calls: DataFrame) -> DataFrame:
    """Topological levels of ``calls`` (conv_id, call_id, after): rows (conv_id, call_id, level); calls in or after cycles have none."""
    named = calls.select(_conversation().alias("conv"), "call_id", "after")
    found = _levels(named)
    number = F.when(F.col("conv").startswith("i"), F.substring("conv", 2, 30)).cast(calls.schema["conv_id"].dataType)
    return found.select(number.alias("conv_id"), "call_id", "level")


def _conversation() -> Column:
    """A conversation's key, which is never null."""
    return F.coalesce(F.concat(F.lit("i"), F.col("conv_id").cast("string")), F.lit("none"))


def _levels(calls: DataFrame) -> DataFrame:
    key = ["conv", "call_id"]
    known = calls.select("conv", F.col("call_id").alias("before"))
    edges = materialise(calls.select(*key, F.explode("after").alias("before")).distinct().join(known, ["conv", "before"], "left_semi").select(*key, "before"), "edges")
    free = calls.select(*key).join(edges, key, "left_anti").withColumn("level", F.lit(0))
    large = edges.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GATHERED_LINKS).select("conv")
    large = materialise(large, "large-conversations")
    some = not large.isEmpty()
    if not some:
        discard(large)
    small = edges.join(F.broadcast(large) if large.count() < 10_000 else large, "conv", "left_anti") if some else edges
    settled = small.repartition("conv").sortWithinPartitions("conv").mapInArrow(_level_batches, "conv string, call_id string, level int")
    out = free.unionByName(settled.where(F.col("level") > 0))  # calls after none are there already
    return out.unionByName(_large_levels(calls.join(large, "conv", "left_semi"), edges.join(large, "conv", "left_semi")).where(F.col("level") > 0)) if some else out


def _large_levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels without gathering a conversation.

    A call after just one other points to it; pointers are followed by doubling until they reach a call that comes after
    none or after several. Only calls after several are then settled in rounds, each after all that it waits for.
    """
    key = ["conv", "call_id"]
    edges = materialise(edges, "edges")
    counted = materialise(edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("first")), "degrees")
    chain = materialise(counted.where("n = 1").select(*key, F.col("first").alias("to"), F.lit(1).alias("steps")), "chain")
    longest = calls.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(int(longest).bit_length()):
        hop = chain.select("conv", F.col("call_id").alias("to"), F.col("to").alias("on"), F.col("steps").alias("more"))
        moved = chain.join(hop, ["conv", "to"], "left").select(*key, F.coalesce("on", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("on").isNotNull().alias("moved"))
        moved = materialise(moved, "chain")
        chain = moved.select(*key, "to", "steps")
        if moved.where("moved").isEmpty():
            break
    # what a call after several waits for: the ends of its predecessors' chains
    through = chain.select("conv", F.col("call_id").alias("before"), "to", "steps")
    waiting = edges.join(counted.where("n > 1").select(*key), key, "left_semi").join(through, ["conv", "before"], "left")
    waiting = materialise(waiting.select(*key, F.coalesce("to", "before").alias("to"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "waiting")
    done = last = calls.select(*key).join(counted.select(*key), key, "left_anti").withColumn("level", F.lit(0))
    best = None
    while not waiting.isEmpty():
        met = waiting.join(last.select("conv", F.col("call_id").alias("to"), "level"), ["conv", "to"], "left").select(*key, "to", "steps", (F.col("level") + F.col("steps")).alias("reached"))
        met = materialise(met, "waiting")
        some = met.groupBy(*key).agg(F.max("reached").alias("reached"), F.count_if(F.col("reached").isNull()).alias("open"))
        best = some if best is None else some.join(best.select(*key, F.col("reached").alias("was")), key, "left").select(*key, F.greatest("reached", "was").alias("reached"), "open")
        best = materialise(best, "reached")
        last = best.where("open = 0").select(*key, F.col("reached").cast("int").alias("level"))
        best, waiting = best.where("open > 0"), met.where("reached IS NULL").select(*key, "to", "steps")
        if last.isEmpty():
            break
        done = done.unionByName(last)
    ends = done.select("conv", F.col("call_id").alias("to"), "level")
    return done.unionByName(chain.join(ends, ["conv", "to"]).select(*key, (F.col("level") + F.col("steps")).cast("int").alias("level")))


def link_calls(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """Links of ``messages`` (conv_id, turn, text, calls array of (id, name, arguments, after), result_of) with ``tools``
    (name, schema): one row per call with its level, status, first violation, and canonical JSON."""
    calls = materialise(_calls(messages).withColumn("conv", _conversation()), "calls")
    results = _results(messages).withColumn("conv", _conversation()).drop("conv_id")
    key = ["conv", "call_id"]
    linked = calls.join(_levels(calls.select(*key, "after")), key, "left").join(results, key, "left").join(tools.groupBy("name").agg(F.min("schema").alias("schema")), "name", "left")
    rows = linked.select("conv_id", "call_id", "turn", "level", "name", "n_calls", F.coalesce("n_results", F.lit(0)).alias("n_results"), "arguments", "result", "schema")
    return rows.mapInArrow(_serialise, "conv_id long, call_id string, turn long, level int, name string, n_calls long, n_results long, status string, error string, json string")


def orphan_results(messages: DataFrame) -> DataFrame:
    """Messages that give a result of no call of their conversation."""
    results = messages.where(F.col("result_of").isNotNull())
    calls = messages.select(F.col("conv_id").alias("_conv"), F.explode("calls").alias("_c")).select("_conv", F.col("_c.id").alias("_of"))
    return results.join(calls, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("result_of") == F.col("_of")), "left_anti")


# The tools that derived messages call.
TOOLS = [
    ("search", {"type": "object", "required": ["query", "limit"], "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 200}, "limit": {"type": "integer", "minimum": 1, "maximum": 120}}, "additionalProperties": False}),
    ("lookup", {"type": "object", "required": ["key"], "properties": {"key": {"type": "string", "pattern": "^[^0-9]+$"}, "words": {"type": "array", "items": {"type": "string"}, "maxItems": 9}}}),
    ("measure", {"type": "object", "required": ["length"], "properties": {"length": {"type": "integer", "minimum": 20}, "unit": {"enum": ["char", "word"]}}}),
]


def tools_table(spark) -> DataFrame:
    return spark.createDataFrame([(name, canonical(schema)) for name, schema in TOOLS], "name string, schema string")


def derived_messages(conversations: DataFrame) -> DataFrame:
    """Messages with calls made from ``conversations`` (conv_id, turn, role, text).

    Each assistant turn calls a tool about its words, after the assistant's call two turns before; each user turn past
    the first is the result of the call in the turn before it.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    call_id = lambda turn: F.concat_ws("_", F.lit("call"), turn.cast("string"))
    kind = F.pmod(F.crc32(text), F.lit(3))
    arguments = (
        F.when(kind == 0, F.to_json(F.struct(F.array_join(F.slice(words, 1, 6), " ").alias("query"), F.size(words).alias("limit"))))
        .when(kind == 1, F.to_json(F.struct(F.coalesce(F.get(words, 0), F.lit("")).alias("key"), F.slice(words, 1, 9).alias("words"))))
        .otherwise(F.to_json(F.struct(F.char_length(text).alias("length"), F.lit("char").alias("unit"))))
    )
    name = F.element_at(F.array(*[F.lit(t) for t, _ in TOOLS]), (kind + 1).cast("int"))
    call = F.struct(call_id(F.col("turn")).alias("id"), name.alias("name"), arguments.alias("arguments"), F.array(call_id(F.col("turn") - 2)).alias("after"))
    none = F.array().cast("array<struct<id:string,name:string,arguments:string,after:array<string>>>")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text",
        F.when(F.col("role") == "assistant", F.array(call)).otherwise(none).alias("calls"),
        F.when((F.col("role") == "user") & (F.col("turn") > 0), call_id(F.col("turn") - 1)).alias("result_of"),
    )
