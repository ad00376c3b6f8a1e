"""Tool-call linking for chat logs, in DataFrame operations only.

Calls and results are joined by their identifier within a conversation. Calls may depend on other
calls; they are put in an order in which each comes after what it depends on, and a result comes
right behind its call. Arguments are checked against the schema of their tool, and every message
becomes canonical JSON: keys sorted at every level, no white space, numbers in one form.

*Order.* A call's place is (turn, step): its own turn and step 0, or if it depends on calls that
come later in the log, the latest of their turns and one step more than these. So a log that is in
order needs one join to know it, and otherwise a round is needed for each further step. Sorting a
conversation by ``placed_turn``, ``step``, ``call_id``, ``part``, ``turn`` gives the order; no task
ever holds a conversation.

Defined cases: a null ``call_id`` links with nothing; a null conversation is one of its own; a null
turn comes before all others; of calls that repeat an identifier the first by turn, then by name
and arguments, is the call, the others are ``repeated``; every result with the identifier is linked;
a dependency that is not there is an error of the call, so is one that is in or behind a cycle, and
both are left out of the order; null, broken or non-object arguments are an error and are quoted as
text; a tool without a schema is an error; null texts are JSON nulls; empty tables give empty tables;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

#: Names of parameter types, and what a parsed value of them is called.
TYPES = {
    "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN",
    "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID",
}
KEY = ("conv_id", "call_id")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of some columns, null conversations among themselves included."""
    out = F.lit(True)
    for n in names:
        out = out & (left[n].eqNullSafe(right[n]) if n == "conv_id" else left[n] == right[n])
    return out


def argument_errors(name: Column, parsed: Column, keys: Column, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> Column:
    """What is wrong with parsed arguments; ``schemas`` has (type, required) by tool and parameter."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for tool, parameters in sorted(schemas.items()):
        found = []
        for p, (kind, required) in sorted(parameters.items()):
            value = F.try_variant_get(parsed, f'$["{p}"]', "variant")
            missing = F.when(F.lit(required) & value.isNull(), F.lit(f"{p} is missing"))
            wrong = F.when(~F.schema_of_variant(value).rlike(f"^({TYPES[kind]})$"), F.lit(f"{p} is no {kind}"))
            found += [missing, wrong]
        unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, sorted(parameters))).cast("array<string>"))), lambda k: F.concat(k, F.lit(" is unknown")))
        out = out.when(name == tool, F.concat(F.array_compact(F.array(*found)).cast("array<string>"), unknown))
    return out.otherwise(F.array(F.lit("tool is unknown")))


def ordered(calls: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``conv_id``, ``call_id``, ``placed_turn``, ``step`` and ``cyclic`` of calls with unique
    identifiers and their dependencies ``needs``; and the tables that hold it."""
    state = materialize(calls.select(*KEY, "turn", F.col("turn").alias("placed_turn"), F.lit(0).alias("step"), F.lit(False).alias("cyclic")), "places")
    edges = materialize(calls.select(*KEY, F.explode("needs").alias("need")).where("need IS NOT NULL").distinct(), "edges")
    while True:
        # nulls first, as in the order of a sort
        at = F.struct(F.coalesce("placed_turn", F.lit(-(2**63))).alias("t"), F.col("step").alias("s"))
        needed = state.select(F.col("conv_id").alias("c"), F.col("call_id").alias("need"), F.when(~F.col("cyclic"), F.struct(at["t"].alias("t"), (at["s"] + 1).alias("s"))).alias("after"), F.col("cyclic").alias("behind"))
        latest = edges.join(needed, edges["conv_id"].eqNullSafe(needed["c"]) & (edges["need"] == needed["need"])).groupBy(*KEY).agg(F.max("after").alias("after"), F.max("behind").alias("behind"))
        moved = state.join(latest, same(state, latest, *KEY), "left").select(
            *(state[c] for c in state.columns), at.alias("at"), F.when(~state["cyclic"], latest["after"]).alias("after"), (~state["cyclic"] & F.coalesce(latest["behind"], F.lit(False))).alias("behind")
        )
        moved = moved.withColumn("late", (F.col("after")["t"] > F.col("at")["t"]) | ((F.col("after")["t"] == F.col("at")["t"]) & (F.col("after")["s"] > F.col("at")["s"])))
        moved = materialize(moved.withColumn("late", F.coalesce("late", F.lit(False))), "moved")
        if not moved.agg(F.count_if(F.col("late") | F.col("behind"))).first()[0]:
            return state, [edges]
        new = moved.select(
            *KEY, "turn",
            F.when(F.col("late"), F.nullif(F.col("after")["t"], F.lit(-(2**63)))).otherwise(F.col("placed_turn")).alias("placed_turn"),
            F.when(F.col("late"), F.col("after")["s"]).otherwise(F.col("step")).alias("step"), (F.col("cyclic") | F.col("behind")).alias("cyclic"), "behind",
        )
        new = materialize(new, "places")
        # steps are counted by calls that wait for others, so more steps than such calls mean a cycle
        waiting = new.groupBy(F.col("conv_id").alias("c")).agg(F.count_if(F.col("step") > 0).alias("most"), F.max("step").alias("top")).where("top > most")
        cyclic = F.col("behind") | F.coalesce(F.col("step") > F.col("most"), F.lit(False))
        marked = new.join(waiting, new["conv_id"].eqNullSafe(waiting["c"]), "left").select(
            *KEY, "turn", F.when(cyclic, F.col("turn")).otherwise(F.col("placed_turn")).alias("placed_turn"),
            F.when(cyclic, F.lit(0)).otherwise(F.col("step")).alias("step"), (F.col("cyclic") | cyclic).alias("cyclic"),
        )
        discard(state)
        state = materialize(marked, "places")
        discard(moved)
        discard(new)


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> DataFrame:
    """A row for each call and each result.

    ``calls`` has ``conv_id``, ``turn``, ``call_id``, ``name``, ``arguments`` (JSON text) and ``needs``
    (identifiers it depends on); ``results`` has ``conv_id``, ``turn``, ``call_id`` and ``content``.
    Returned are ``conv_id``, ``placed_turn``, ``step``, ``call_id``, ``part`` (0 call, 1 result),
    ``turn``, ``link`` (``linked``, ``no result``, ``no call`` or ``repeated``), ``errors`` and ``json``.
    """
    own = calls.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"),
        F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"), F.array_sort(F.array_distinct(F.coalesce("needs", F.array().cast("array<string>")))).alias("needs"),
    )
    got = results.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"), F.col("content").cast("string").alias("content"))

    # equal calls are one row with a count, so that an identifier that repeats is no hot key
    distinct = materialize(own.groupBy(*own.columns).agg(F.count(F.lit(1)).alias("copies")), "calls")
    content = F.struct(F.coalesce("turn", F.lit(-(2**63))), F.coalesce("name", F.lit("")), F.coalesce("arguments", F.lit("")), F.to_json("needs"))
    first = distinct.where("call_id IS NOT NULL").groupBy(*KEY).agg(F.min(F.struct(content.alias("k"), F.struct("turn", "name", "arguments", "needs").alias("v"))).alias("x"))
    unique = first.select(*KEY, F.col("x.v.turn").alias("turn"), F.col("x.v.needs").alias("needs"), F.col("x.k").alias("k"))
    places, held = ordered(unique)

    # what calls need and do not have
    wanted = unique.select(*KEY, F.explode("needs").alias("need"))
    there = places.select(F.col("conv_id").alias("c"), F.col("call_id").alias("need"), F.col("cyclic").alias("behind"))
    absent = (
        wanted.join(there, wanted["conv_id"].eqNullSafe(there["c"]) & (wanted["need"] == there["need"]), "left")
        .where(there["c"].isNull() & there["behind"].isNull())
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_set(F.concat(F.lit("needs "), F.coalesce(wanted["need"], F.lit("null")), F.lit(", which is not there")))).alias("absent"))
    )
    answered = got.where("call_id IS NOT NULL").select(*KEY).distinct()
    known = unique.select(*KEY, "k")
    known = known.join(places, same(known, places, *KEY)).select(known["conv_id"], known["call_id"], "k", "placed_turn", "step", "cyclic")
    known = known.join(absent, same(known, absent, *KEY), "left").select(*(known[c] for c in known.columns), "absent")
    known = known.join(answered, same(known, answered, *KEY), "left").select(*(known[c] for c in known.columns), answered["call_id"].isNotNull().alias("answered"))
    known = materialize(known, "known")

    parsed = F.try_parse_json("arguments")
    keys = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
    is_object = F.coalesce(F.schema_of_variant(parsed).rlike("^OBJECT<"), F.lit(False))
    joined = distinct.withColumn("k0", content).join(known, same(distinct, known, *KEY), "left")
    joined = joined.select(distinct["conv_id"], distinct["call_id"], *(distinct[c] for c in ("turn", "name", "arguments", "copies")), "k0", "k", "placed_turn", "step", "cyclic", "absent", "answered")
    # of equal first calls one is the call
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    is_call = F.col("call_id").isNull() | (F.coalesce(F.to_json("k") == F.to_json("k0"), F.lit(False)) & (F.col("copy") == 1))
    bad = F.when(is_object, argument_errors(F.coalesce("name", F.lit("")), parsed, keys, schemas)).otherwise(F.array(F.lit("arguments are no object")))
    no_errors = F.array().cast("array<string>")
    errors = F.concat(bad, F.when(is_call, F.coalesce("absent", no_errors)).otherwise(no_errors), F.when(is_call & F.coalesce("cyclic", F.lit(False)), F.array(F.lit("depends on a cycle"))).otherwise(no_errors))

    def quoted(c: Column) -> Column:
        return F.coalesce(F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))

    arguments = F.when(is_object, F.to_json(parsed)).otherwise(quoted(F.col("arguments")))
    call_json = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"type":"call"}'))
    placed = joined.select(
        "conv_id", F.when(is_call, F.coalesce("placed_turn", "turn")).otherwise(F.col("turn")).alias("placed_turn"), F.when(is_call, F.coalesce("step", F.lit(0))).otherwise(F.lit(0)).alias("step"),
        "call_id", F.lit(0).alias("part"), "turn",
        F.when(~is_call, "repeated").when(F.coalesce("answered", F.lit(False)), "linked").otherwise("no result").alias("link"),
        errors.alias("errors"), call_json.alias("json"),
    )
    own_results = got.join(known, same(got, known, *KEY), "left")
    result_json = F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"id":'), quoted(got["call_id"]), F.lit(',"type":"result"}'))
    answers = own_results.select(
        got["conv_id"], F.when(known["k"].isNotNull(), F.col("placed_turn")).otherwise(got["turn"]).alias("placed_turn"), F.coalesce("step", F.lit(0)).alias("step"),
        got["call_id"], F.lit(1).alias("part"), got["turn"], F.when(known["k"].isNotNull(), "linked").otherwise("no call").alias("link"), no_errors.alias("errors"), result_json.alias("json"),
    )
    for table in held:
        discard(table)
    return placed.unionByName(answers)
