"""Chat formatting: linking tool calls with their results, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import null_safe, small, stored

_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
_RESULT = "struct<tool_call_id:string,content:string>"
#: JSON types of a schema and the variant types they allow (fixed values).
JSON_TYPES = {
    "string": ["STRING"],
    "integer": ["BIGINT"],
    "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"],
    "boolean": ["BOOLEAN"],
    "array": ["ARRAY"],
    "object": ["OBJECT"],
    "null": ["VOID"],
}


def tool_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that ``messages(conv_id, turn, role, text)`` spell out as JSON.

    Any text that is an object with ``tool_calls`` (id, name, arguments, after: ids that must be
    answered before) makes calls; one of role ``tool`` with ``tool_call_id`` and ``content`` a result.
    """
    calls = (
        messages.where(F.col("text").startswith("{"))
        .select("conv_id", "turn", F.posexplode(F.from_json("text", _CALLS)["tool_calls"]).alias("ordinal", "c"))
        .select("conv_id", "turn", "ordinal", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"),
                F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"))
    )
    results = (
        messages.where((F.col("role") == "tool") & F.col("text").startswith("{"))
        .select("conv_id", "turn", F.from_json("text", _RESULT).alias("r"))
        .select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))
    )
    return calls, results


def plain_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a chat without tools.

    A system turn calls ``configure``, a user turn calls ``answer`` after the question two turns
    before; an assistant turn is the result of the turn it follows.  Identifiers are
    ``conv_id:turn``; rows with a null in either have none.
    """
    name = F.when(F.col("role") == "system", "configure").when(F.col("role") == "user", "answer")
    ident = lambda back: F.concat(
        F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    calls = messages.where(F.col("role").isin("system", "user")).select(
        "conv_id", "turn", F.lit(0).alias("ordinal"), ident(0).alias("call_id"), name.alias("name"),
        F.to_json(F.struct("turn", "text", "role"), {"ignoreNullFields": "false"}).alias("arguments"),
        F.array(ident(2)).alias("after"))
    results = messages.where(F.col("role") == "assistant").select(
        "conv_id", "turn", ident(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each (conv_id, call_id): the call, its result and ``status``.

    Both sides are first reduced to one row an identifier: the earliest call and the earliest
    result, the least text on ties; ``repeats`` counts the rows left aside.  Then one hash join.
    ``status``: linked, unanswered, orphan (a result without its call) or early (a result before
    its call).  Rows without an identifier can't link and keep no more than their count.
    """
    one = (
        calls.groupBy("conv_id", "call_id")
        .agg(F.min(F.struct("turn", "ordinal", "name", "arguments", "after")).alias("c"), F.count("*").alias("nc"))
    )
    two = (
        results.groupBy(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"))
        .agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("nr"))
    )
    met = one.join(two, (one["conv_id"] == two["r_conv"]) & (one["call_id"] == two["r_id"]), "full_outer")
    status = (
        F.when(F.col("c").isNull(), "orphan").when(F.col("r").isNull(), "unanswered")
        .when(F.col("r.turn") < F.col("c.turn"), "early").otherwise("linked"))
    return met.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"), F.coalesce("call_id", "r_id").alias("call_id"),
        F.col("c.turn").alias("turn"), F.col("c.ordinal").alias("ordinal"), F.col("c.name").alias("name"),
        F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"),
        F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), status.alias("status"),
        (F.greatest(F.coalesce("nc", F.lit(1)) - 1, F.lit(0)) + F.greatest(F.coalesce("nr", F.lit(1)) - 1, F.lit(0)))
        .cast("long").alias("repeats"))


def _rounds(linked: DataFrame) -> DataFrame:
    """``levels`` of conversations in which a call waits for a later one or for itself.

    Calls after exactly one other form chains, which pointer doubling follows to their start in
    as many rounds as the logarithm of their length.  Only calls after several others are then
    settled in Kahn's rounds, on the contracted graph.  Calls on a cycle, or after one, have no row.
    """
    key = ["conv_id", "call_id"]
    nodes = stored(linked.where("conv_id is not null and call_id is not null and status <> 'orphan'").select(*key), "calls")
    edges = stored(
        linked.select(*key, F.explode("after").alias("before")).where("before is not null").distinct()
        .join(nodes, key, "left_semi")
        .join(nodes.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"], "left_semi"), "after")
    degree = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("before").alias("before"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    jump = stored(
        nodes.join(degree, key, "left").select(
            *key, F.when(one, F.col("before")).otherwise(F.col("call_id")).alias("root"),
            F.when(one, 1).otherwise(0).cast("long").alias("dist"), F.coalesce("n", F.lit(0)).alias("n")), "jump")
    ends = jump.where("n <> 1").select("conv_id", F.col("call_id").alias("root"), "n")
    most, rounds, moved = nodes.count(), 0, True
    while moved and 2**rounds <= most:  # a chain is no longer than that; what still moves is on a cycle
        to = jump.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("next"), F.col("dist").alias("more"))
        step = stored(jump.join(to, ["conv_id", "root"]).select(
            *key, F.col("next").alias("root"), (F.col("dist") + F.col("more")).alias("dist"), "n", (F.col("next") != F.col("root")).alias("moved")), "jump")
        jump, rounds, moved = step.drop("moved"), rounds + 1, not step.where("moved").isEmpty()
    reach = stored(jump.drop("n").join(ends, ["conv_id", "root"]), "reach")
    settled = stored(ends.where("n = 0").select("conv_id", "root", F.lit(0).cast("long").alias("level")), "level")
    before = reach.select("conv_id", F.col("call_id").alias("before"), F.col("root").alias("b_root"), "dist")
    several = stored(
        edges.join(ends.where("n > 1").select("conv_id", F.col("root").alias("call_id")), key, "left_semi")
        .join(before, ["conv_id", "before"], "left"), "several")
    while not several.isEmpty():
        known = several.join(settled.withColumnRenamed("root", "b_root"), ["conv_id", "b_root"], "left")
        ready = stored(
            known.groupBy(*key).agg(F.max(F.col("level") + F.col("dist") + 1).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("all"))
            .where("all").select("conv_id", F.col("call_id").alias("root"), "level"), "level")
        if ready.isEmpty():
            break
        several = stored(several.join(ready.withColumnRenamed("root", "call_id"), key, "left_anti"), "several")
        settled = stored(settled.unionByName(ready), "level")
    return reach.join(settled, ["conv_id", "root"]).select(*key, (F.col("level") + F.col("dist")).cast("int").alias("level"))


def _ranked(calls: DataFrame, by: list[str], order: list, block: Column, name: str) -> DataFrame:
    """``calls`` with their number from 0 within ``by``: blocks of one order are numbered each for itself and added up."""
    keys = [*by, "__block"]
    own = calls.withColumn("__block", block)
    before = Window.partitionBy(*by).orderBy(F.col("__block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    bases = own.groupBy(*keys).agg(F.count("*").alias("__n")).select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    numbered = own.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return null_safe(numbered, bases, keys, "inner").withColumn(name, (F.col("__base") + F.col(name)).cast("long")).drop("__block", "__base")


def _swept(edges: DataFrame, block: int) -> DataFrame:
    """``(conv_id, t, level long)`` of all calls that wait, where each waits for earlier ranks only (f < t).

    The chunks of ``block`` ranks are taken in order, those of all conversations at once.  In a chunk one aggregation follows
    the order, so its calls take one step however long a run they make.
    """
    place = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("t")) - 1
    own = stored(edges.select("conv_id", "t").distinct().withColumn("chunk", F.floor(F.col("t") / block)).withColumn("i", place), "chunks")
    met = stored(
        edges.withColumn("chunk", F.floor(F.col("t") / block)).join(
            own.select("conv_id", F.col("t").alias("f"), F.col("chunk").alias("c"), F.col("i").alias("j")), ["conv_id", "f"], "left")
        .withColumn("near", F.coalesce(F.col("c") == F.col("chunk"), F.lit(False))), "met")
    deps = met.where("near").groupBy("conv_id", "t").agg(F.collect_list("j").alias("deps"))
    inside = stored(own.join(deps, ["conv_id", "t"], "left").select("conv_id", "chunk", "t", "i", F.coalesce("deps", F.array().cast("array<int>")).alias("deps")), "inside")
    zero, done = F.lit(0).cast("long"), None
    for (c,) in sorted(own.select("chunk").distinct().collect()):
        far = met.where((F.col("chunk") == c) & ~F.col("near"))
        far = far.withColumn("level", zero) if done is None else far.join(done.withColumnRenamed("t", "f"), ["conv_id", "f"], "left")
        base = far.groupBy("conv_id", "t").agg(F.max(F.coalesce("level", zero) + 1).alias("base"))
        rows = inside.where(F.col("chunk") == c).join(base, ["conv_id", "t"], "left").groupBy("conv_id").agg(
            F.array_sort(F.collect_list(F.struct("i", "t", F.coalesce("base", zero).alias("base"), "deps"))).alias("x"))
        follow = F.aggregate("x", F.array().cast("array<bigint>"), lambda got, x: F.concat(got, F.array(F.greatest(
            x["base"], F.coalesce(F.array_max(F.transform(x["deps"], lambda j: F.get(got, j) + 1)), zero)))))
        part = stored(
            rows.select("conv_id", F.transform("x", lambda x: x["t"]).alias("t"), follow.alias("level"))
            .select("conv_id", F.explode(F.arrays_zip("t", "level")).alias("r")).select("conv_id", "r.t", "r.level"), "level")
        done = part if done is None else done.unionByName(part)
    return done


def levels(linked: DataFrame, block: int = 1024) -> DataFrame:
    """``(conv_id, call_id, level int)``: 0 without a known earlier call, else 1 + the highest before.

    Calls are ranked by turn, ordinal and identifier.  In a conversation whose calls wait for earlier ranks only, chunks of
    ``block`` ranks are settled one after another (ten thousand calls take ten steps).  In the others calls may
    wait for later ones: they are settled in rounds, and calls on a cycle, or after one, have no row.
    """
    key = ["conv_id", "call_id"]
    order = [c for c in ("turn", "ordinal") if c in linked.columns]
    calls = linked.where("conv_id is not null and call_id is not null and status <> 'orphan'").select(*key, *order)
    blocks = F.floor(F.col("turn") / block) if "turn" in order else F.lit(0).cast("long")
    ranked = stored(_ranked(calls, ["conv_id"], [*[F.col(c).asc_nulls_last() for c in order], F.col("call_id")], blocks, "rank").select(*key, "rank"), "calls")
    waits = linked.select(*key, F.explode("after").alias("before")).where("before is not null").distinct()
    edges = stored(
        waits.join(ranked.withColumnRenamed("rank", "t"), key)
        .join(ranked.select("conv_id", F.col("call_id").alias("before"), F.col("rank").alias("f")), ["conv_id", "before"])
        .select("conv_id", "f", "t"), "after")
    late = stored(edges.where("f >= t").select("conv_id").distinct(), "late")
    n_late = late.count()
    timely = edges.join(small(late, n_late, 8), "conv_id", "left_anti") if n_late else edges
    swept = _swept(timely, block)
    rest = ranked.join(small(late, n_late, 8), "conv_id", "left_anti") if n_late else ranked
    level = F.lit(0)
    if swept is not None:
        rest, level = rest.join(swept.withColumnRenamed("t", "rank"), ["conv_id", "rank"], "left"), F.coalesce("level", F.lit(0))
    out = rest.select(*key, level.cast("int").alias("level"))
    return out.unionByName(_rounds(linked.join(small(late, n_late, 8), "conv_id", "left_semi"))) if n_late else out


def _faults(fields: Column, arguments: Column) -> Column:
    def fault(f: Column) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(arguments, F.concat(F.lit("$."), f["field"]), "variant"))
        allowed = F.lit(None)
        for name, kinds in JSON_TYPES.items():
            allowed = F.when(f["type"] == name, F.array(*map(F.lit, kinds))).otherwise(allowed)
        base = F.regexp_extract(kind, "^[A-Z]+", 0)
        return (
            F.when(kind.isNull() & f["required"], F.concat(f["field"], F.lit(" missing")))
            .when(kind.isNotNull() & ~F.array_contains(allowed, base), F.concat(f["field"], F.lit(" not "), f["type"])))

    return F.array_sort(F.filter(F.transform(fields, fault), lambda x: x.isNotNull()))


def validate(linked: DataFrame, schemas: DataFrame, small_bytes: int | None = None) -> DataFrame:
    """``linked`` with ``faults array<string>`` and ``canonical`` arguments.

    ``schemas(name, field, type, required boolean)``.  A fault is: a call without a schema,
    arguments that aren't a JSON object, a required field missing or a field of another type.
    ``canonical`` is JSON without white space, keys in order, null if the arguments don't parse.
    """
    by_name = schemas.groupBy("name").agg(F.collect_list(F.struct("field", "type", "required")).alias("fields"))
    n = by_name.count()
    parsed = F.try_parse_json("arguments")
    joined = linked.withColumn("v", parsed).join(small(by_name, n, 256, small_bytes), "name", "left")
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    faults = (
        F.when(F.col("status") == "orphan", F.array(F.lit("no call")))
        .when(F.col("fields").isNull(), F.array(F.lit("no schema")))
        .when(~is_object, F.array(F.lit("arguments not an object")))
        .otherwise(_faults(F.col("fields"), F.col("v"))))
    return joined.select(*linked.columns, faults.alias("faults"), F.to_json("v").alias("canonical"))


def format_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Links, orders, validates and serialises: one row for each identified call or result.

    Adds to ``link``'s columns ``level`` (null on a cycle and for orphans), ``position`` in the
    conversation (from 0, by level, turn, ordinal, call_id; what has no level comes last),
    ``faults`` and ``json``, the canonical JSON of call and result.  Empty tables give no rows.
    """
    key = ["conv_id", "call_id"]
    linked = stored(validate(link(calls, results), schemas), "linked")
    ranked = linked.join(levels(linked), key, "left").withColumn("l", F.coalesce("level", F.lit(2**31 - 1)))
    # a conversation is numbered in blocks of levels, those in blocks of turns, so that no sort holds all of it
    last = [F.col("turn").asc_nulls_last(), F.col("ordinal").asc_nulls_last(), "call_id", "result_turn", "content"]
    one = _ranked(ranked, ["conv_id", "l"], last, F.floor(F.col("turn") / 1024), "own")
    upto = one.groupBy("conv_id", "l").agg(F.count("*").alias("n")).withColumn("lb", F.floor(F.col("l") / 1024))
    within = Window.partitionBy("conv_id", "lb").orderBy("l").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id").orderBy("lb").rowsBetween(Window.unboundedPreceding, -1)
    of_block = upto.groupBy("conv_id", "lb").agg(F.sum("n").alias("n")).select("conv_id", "lb", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base2"))
    bases = null_safe(upto.withColumn("base1", F.coalesce(F.sum("n").over(within), F.lit(0))), of_block, ["conv_id", "lb"], "inner").select(
        "conv_id", "l", (F.col("base1") + F.col("base2")).alias("base"))
    placed = null_safe(one, bases, ["conv_id", "l"], "inner")
    body = F.to_json(F.struct(
        F.try_parse_json("canonical").alias("arguments"), "call_id", "content", F.col("name").alias("name"), "status"),
        {"ignoreNullFields": "false"})
    return placed.select(
        *linked.columns, "level", (F.col("base") + F.col("own")).cast("long").alias("position"),
        F.to_json(F.parse_json(body)).alias("json"))
