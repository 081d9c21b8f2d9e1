"""Chat formatting: tool calls linked to their results, ordered by what they depend on, checked and written as canonical JSON.

In DataFrame operations only. Calls meet results by a hash join on the identifier. The order of calls is their level: 0 for a call that
depends on none, else one more than the deepest call that it depends on. Runs of calls with one dependency each are passed over in
doubling steps, so a conversation of n turns takes about log2(n) rounds; calls with several dependencies are then settled
in waves, each of which goes over the calls still open. Every round is written to the shared folder, and no window or array holds a conversation.

Defined cases: a call id that occurs more than once has one level and each of its rows is kept; of several results the one of
the earliest turn (then least text) is linked, and n_results tells their number; a dependency on an id that no call has is
passed over and listed in `errors`; calls in or behind a cycle have a null level; null ids link nothing and have a null level;
arguments that aren't a JSON object, miss a required key, have an unknown one or a value of another type are errors; empty tables give
an empty result; very long texts are written whole; other columns of the calls pass through, but for those named like a result (in any case), which it replaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Aside, stored

#: Tool schemas: name -> key -> (JSON type, required).
Tools = dict[str, dict[str, tuple[str, bool]]]
RESULTS = ("level", "valid", "errors", "result_turn", "n_results", "message")
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",)}


def argument_errors(name: Column, arguments: Column, tools: Tools) -> Column:
    """A sorted array of what is wrong with a call's arguments; empty if they fit the tool's schema."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    out = F.array(F.lit("unknown tool"))
    for tool, keys in tools.items():
        known = F.array(*[F.lit(k) for k in keys])
        wrong = [F.when(F.size(F.array_except(F.json_object_keys(arguments), known)) > 0, F.lit("unknown key"))]
        for key, (kind, required) in keys.items():
            value = F.schema_of_variant(F.try_variant_get(parsed, f"$['{key}']", "variant"))
            fits = F.lit(False)
            for start in _TYPES[kind]:
                fits = fits | value.startswith(start)
            wrong.append(F.when(value.isNull(), F.lit(f"missing {key}") if required else F.lit(None)).when(~fits, F.lit(f"{key} is not {kind}")))
        errors = F.when(is_object, F.array_sort(F.array_compact(F.array(*wrong)))).otherwise(F.array(F.lit("not an object")))
        out = F.when(name == tool, errors).otherwise(out)
    return out


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no blanks, null if it can't be read."""
    return F.to_json(F.try_parse_json(text))


def levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """nodes(node), distinct; needs(node, parent): both among the nodes, distinct -> (node, level), level null on or behind a cycle."""
    degree = needs.groupBy("node").agg(F.count("*").alias("n"), F.min("parent").alias("parent"))
    simple = degree.where("n = 1").select("node", F.col("parent").alias("to"))
    anchors = stored(nodes.join(simple.select("node"), "node", "left_anti"), "anchors")
    # A simple call's pointer doubles until it comes to an anchor, a call with no dependency or with several.
    at_anchor = anchors.select(F.col("node").alias("to"), F.lit(True).alias("done"))
    pointers = stored(simple.join(at_anchor, "to", "left").select("node", "to", F.lit(1).cast("long").alias("far"), F.coalesce("done", F.lit(False)).alias("done")), "pointers")
    open_calls, rounds = pointers.where("NOT done").count(), 0
    most = pointers.count().bit_length() + 1
    while open_calls and rounds <= most:
        onward = pointers.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("done").alias("ends"))
        moved = pointers.where("NOT done").join(onward, "to").select("node", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"), F.col("ends").alias("done"))
        pointers = stored(pointers.where("done").unionByName(moved), "pointers")
        open_calls, rounds = pointers.where("NOT done").count(), rounds + 1
    reached = pointers.where("done").select("node", "to", "far")
    # Waves over the anchors: one is settled when all that it depends on is.
    behind = needs.join(degree.where("n > 1").select("node"), "node", "left_semi")
    via = reached.select(F.col("node").alias("parent"), "to", "far").unionByName(anchors.select(F.col("node").alias("parent"), F.col("node").alias("to"), F.lit(0).cast("long").alias("far")))
    open_needs = stored(behind.join(via, "parent", "left").select("node", "to", (F.col("far") + 1).alias("far")), "needs")
    wave = stored(anchors.join(needs.select("node"), "node", "left_anti").select("node", F.lit(0).cast("long").alias("level")), "levels")
    waves = [wave]
    # Of each open call: the deepest of what is settled among the calls it depends on, and how many are left.
    still = stored(open_needs.groupBy("node").agg(F.lit(0).cast("long").alias("level"), F.count("*").alias("left")), "open")
    while not wave.isEmpty():
        met = open_needs.join(wave.select(F.col("node").alias("to"), F.col("level").alias("below")), "to").groupBy("node").agg(F.max(F.col("below") + F.col("far")).alias("below"), F.count("*").alias("n"))
        moved = still.join(met, "node", "left").select("node", F.greatest("level", F.coalesce("below", F.lit(0))).alias("level"), (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"))
        moved = stored(moved, "open")
        wave, still = moved.where(F.col("left") == 0).select("node", "level"), moved.where(F.col("left") > 0)
        waves.append(wave)
    settled = reduce(DataFrame.unionByName, waves)
    far = reached.join(settled.select(F.col("node").alias("to"), "level"), "to").select("node", (F.col("level") + F.col("far")).alias("level"))
    return nodes.join(settled.unionByName(far), "node", "left")


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: Tools) -> DataFrame:
    """calls(call_id, name, arguments, after: array of call ids, ...), results(call_id, turn, content).

    Adds level, valid, errors, result_turn, n_results and message, the canonical JSON of the call and its result.
    """
    aside = Aside(calls, ("call_id", "name", "arguments", "after"), RESULTS)
    calls = aside.rows
    nodes = stored(calls.where(F.col("call_id").isNotNull()).select(F.col("call_id").alias("node")).distinct(), "calls")
    wanted = calls.select(F.col("call_id").alias("node"), F.explode("after").alias("parent")).where("node IS NOT NULL AND parent IS NOT NULL").distinct()
    needs = stored(wanted.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent"), "needs")
    missing = wanted.join(nodes.select(F.col("node").alias("parent")), "parent", "left_anti").select(F.col("node").alias("call_id")).distinct().withColumn("lost", F.lit(True))
    linked = results.where(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results"))
    found = calls.join(levels(nodes, needs).withColumnRenamed("node", "call_id"), "call_id", "left").join(linked, "call_id", "left").join(missing, "call_id", "left")
    lost = F.when(F.col("lost"), F.array(F.lit("unknown dependency"))).otherwise(F.array().cast("array<string>"))
    found = found.withColumn("errors", F.concat(argument_errors(F.col("name"), F.col("arguments"), tools), lost))
    parsed = F.coalesce(canonical_json(F.col("arguments")), F.lit("null"))
    text = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    quoted = lambda value: F.coalesce(F.regexp_extract(F.to_json(F.struct(value.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit(""))
    string = lambda value: F.when(value.isNull(), F.lit("null")).otherwise(quoted(value))
    # The keys stand in order.
    message = F.concat(
        F.lit("{"), text("arguments", parsed), F.lit(","), text("id", string(F.col("call_id"))), F.lit(","), text("level", F.coalesce(F.col("level").cast("string"), F.lit("null"))),
        F.lit(","), text("name", string(F.col("name"))), F.lit(","), text("result", string(F.col("result.content"))), F.lit("}"),
    )
    results = [F.col("level"), (F.size("errors") == 0).alias("valid"), F.col("errors"), F.col("result.turn").alias("result_turn"), F.coalesce("n_results", F.lit(0)).alias("n_results"), message.alias("message")]
    return aside.restored(found, *results)
