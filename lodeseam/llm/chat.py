"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

DataFrame functions only. Calls and results meet in a hash join by identifier; results of one identifier
are counted and reduced before it, so an identifier with very many results costs one row. Calls are placed
in topological order: by turn where that already puts every call after those it depends on, else by rounds
of a join that resolves what depends only on what is resolved (calls on a cycle are never resolved).
Places inside a conversation come from counts of turn ranges, so one conversation may hold most rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.llm.base import checkpointed, whole_text

#: Parameters of each tool: name to type (as schema_of_variant gives it) and whether it is required.
TOOLS = {"reply": {"prompt": ("STRING", True), "turn": ("BIGINT", True), "after": ("STRING", False)}}
TURN_RANGE = 512


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, turn, call_id, name, arguments, depends_on) and results (conv_id, turn, call_id, result).

    A user turn calls the tool `reply` with its text; the assistant turn after it is the result. A call
    depends on the one of two turns before, if there is one. A system turn calls nothing and comes as a
    result without a call. Null texts count as empty; a null conversation or turn makes a null identifier.
    """
    at = lambda turn: F.concat_ws(":", F.when(F.col("conv_id").isNotNull(), F.col("conv_id").cast("string")), F.when(turn.isNotNull(), turn.cast("string")))
    identifier = lambda turn: F.when(F.col("conv_id").isNotNull() & turn.isNotNull(), at(turn))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", whole_text().alias("_text"))
    users = rows.where("role = 'user'").select("conv_id", "turn", identifier(F.col("turn")).alias("call_id"), F.when(F.col("turn") >= 2, identifier(F.col("turn") - 2)).alias("_after"), "_text")
    known = users.select(F.col("call_id").alias("_after")).where("_after is not null").distinct().withColumn("_known", F.lit(True))
    first = users.where("_after is null").select("conv_id", "turn", "call_id", "_after", "_text")  # not joined: all of one key, null
    later = users.where("_after is not null").join(known, "_after", "left")
    users = first.union(later.select("conv_id", "turn", "call_id", F.when(F.col("_known"), F.col("_after")).alias("_after"), "_text"))
    arguments = F.to_json(F.struct(F.col("_text").alias("prompt"), F.col("turn").alias("turn"), F.col("_after").alias("after")))
    calls = users.select("conv_id", "turn", "call_id", F.lit("reply").alias("name"), arguments.alias("arguments"), F.array_compact(F.array("_after")).alias("depends_on"))
    others = rows.where("role <> 'user' or role is null")
    results = others.select("conv_id", "turn", F.when(F.col("role") == "assistant", identifier(F.col("turn") - 1)).alias("call_id"), F.col("_text").alias("result"))
    return calls, results


def valid_arguments(name: Column, parsed: Column, tools: dict = TOOLS) -> Column:
    """Whether parsed arguments fit their tool: an object, required ones there, right types, none unknown."""
    out = F.lit(False)
    for tool, parameters in tools.items():
        kind = lambda p: F.schema_of_variant(F.try_variant_get(parsed, f"$.{p}", "variant"))
        fits = [F.coalesce(kind(p) == t, F.lit(not required)) if required else F.coalesce(kind(p).isin(t, "VOID"), F.lit(True)) for p, (t, required) in parameters.items()]
        keys = F.map_keys(F.from_json(F.to_json(parsed), "map<string,string>"))
        known = F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, parameters)))) == 0, F.lit(False))
        all_fit = known
        for f in fits:
            all_fit = all_fit & f
        out = F.when(name == tool, F.schema_of_variant(parsed).startswith("OBJECT") & all_fit).otherwise(out)
    return F.coalesce(out, F.lit(False))


def placed(calls: DataFrame, order: str) -> DataFrame:
    """`calls` with `position`: its place in its conversation by `order`, then turn, then identifier, from 0."""
    part = F.floor(F.coalesce(F.col(order), F.lit(-1)) / TURN_RANGE)
    rows = calls.withColumn("_part", part)
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n")).select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(order, "turn", "call_id")) - 1
    joined = rows.withColumn("_inside", inside).join(offsets, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("position", F.col("_before") + F.col("_inside")).drop("_part", "_conv", "_of", "_before", "_inside")


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of the calls that are on no cycle and behind none; level 0 depends on nothing known.

    One round of joins for each level of the deepest chain; only calls of conversations whose turns are not in
    order already come here.
    """
    edges = calls.select("call_id", F.explode("depends_on").alias("parent")).join(calls.select(F.col("call_id").alias("parent")), "parent").distinct()
    open_ = checkpointed(edges)
    done = checkpointed(calls.select("call_id").join(edges.select("call_id").distinct(), "call_id", "left_anti").withColumn("level", F.lit(0).cast("long")))
    for level in itertools.count(1):
        waits = checkpointed(open_.join(done.select(F.col("call_id").alias("parent")), "parent", "left_anti"))
        new = open_.select("call_id").distinct().join(waits.select("call_id").distinct(), "call_id", "left_anti")
        new = checkpointed(new.join(done.select("call_id"), "call_id", "left_anti").withColumn("level", F.lit(level).cast("long")))
        if new.isEmpty():
            return done
        done, open_ = done.union(new), waits
    raise AssertionError("not reached")


def link_calls(calls: DataFrame, results: DataFrame, tools: dict = TOOLS) -> DataFrame:
    """One row per call and per result without one: ids, position, status, result, validity, canonical JSON.

    status: linked, pending (no result), orphan (a result without a call), cycle (no valid order; position
    null). Rows that repeat a call's identifier are one call, the one with the least turn, then content;
    n_results counts all results, the one of the least turn is linked. Malformed arguments are invalid and
    serialised as null. Keys are sorted and no white space is added. Empty tables give no rows.
    """
    one = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("conv_id", "turn", "name", "arguments", "depends_on")).alias("c")).select("call_id", "c.*")
    one = checkpointed(placed(one, "turn"))
    parents = one.select("call_id", "conv_id", "position", F.explode("depends_on").alias("parent"))
    where = one.select(F.col("call_id").alias("parent"), F.col("conv_id").alias("_conv"), F.col("position").alias("_at"))
    turned = parents.join(where, "parent").where((F.col("_conv") == F.col("conv_id")) & (F.col("_at") >= F.col("position"))).select("conv_id").distinct()
    turned = checkpointed(turned)
    if not turned.isEmpty():
        again = one.join(turned, "conv_id").drop("position")
        order = levels(again)
        again = again.join(order, "call_id", "left")
        good = placed(again.where("level is not null"), "level").select(*one.columns)
        bad = again.where("level is null").withColumn("position", F.lit(None).cast("long")).select(*one.columns)
        one = one.join(turned, "conv_id", "left_anti").select(*one.columns).union(good).union(bad)
    found = results.where("call_id is not null").groupBy("call_id").agg(F.count(F.lit(1)).alias("n_results"), F.min(F.struct("turn", "result", "conv_id")).alias("r"))
    both = one.join(found, "call_id", "full_outer")
    both = both.select(
        F.coalesce("conv_id", "r.conv_id").alias("conv_id"), "call_id", "turn", "position", "name", "arguments", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("r.turn").alias("result_turn"), F.col("r.result").alias("result"),
        F.when(F.col("name").isNull(), "orphan").when(F.col("position").isNull(), "cycle").when(F.col("n_results").isNull(), "pending").otherwise("linked").alias("status"),
    )
    free = results.where("call_id is null").select("conv_id", F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(1).cast("long"), "turn", "result", F.lit("orphan"))
    lost = calls.where("call_id is null").select("conv_id", "call_id", "turn", F.lit(None).cast("long"), "name", "arguments", F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit("pending"))
    rows = both.union(free).union(lost).withColumn("_parsed", F.try_parse_json("arguments"))
    quoted = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))
    body = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json("_parsed"), F.lit("null")), F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit(',"result":'), quoted("result"), F.lit("}"))
    return rows.select("conv_id", "call_id", "turn", "position", "status", "n_results", "result_turn", valid_arguments(F.col("name"), F.col("_parsed"), tools).alias("valid"), body.alias("json"))
