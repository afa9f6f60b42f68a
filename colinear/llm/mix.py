"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, stored

Source = str | None


def words(text: Column) -> Column:
    """Number of words of ``text`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def capped_shares(sizes: dict[Source, int], weights: dict[Source, float], total: float,
                  most: float = 2.0) -> dict[Source, float]:
    """Targets that share ``total`` by weight, none above ``most`` times its source's size.

    What stops at its cap leaves the rest to the others by weight: target = min(cap, level *
    weight) for the one level at which the targets sum to ``total`` (all caps, if that's less).
    """
    order = sorted(sizes, key=lambda s: (most * sizes[s] / weights[s], s is None, s or ""))
    left, weight = float(total), float(sum(weights.values()))
    for i, s in enumerate(order):
        if left / weight <= most * sizes[s] / weights[s]:
            level = left / weight
            return {s: most * sizes[s] for s in order[:i]} | {s: level * weights[s] for s in order[i:]}
        left, weight = left - most * sizes[s], weight - weights[s]
    return {s: most * sizes[s] for s in order}


def min_cost_flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int],
                  repeats: int = 2) -> list[dict[int, int]]:
    """Tokens that each pattern gives to each of its sources.

    Pattern p offers ``capacity[p]`` tokens at each of ``repeats`` layers; layer k costs 2k - 1 a
    token (convex: second copies come after first ones everywhere).  Source s takes up to
    ``quota[s]``.  Of all flows of the greatest value the result is one of least cost.  Costs lie on the arcs
    out of the start only, so the shortest augmenting paths of the flow so far are those of the lowest layer
    that still has one: each layer is a maximum flow (blocking flows on levels) on top of the layers before it.
    Ten thousand patterns take seconds.  Everything is integer, arcs are tried in the order of their index.
    """
    n_p, n_s = len(capacity), len(quota)
    start, end = n_p + n_s, n_p + n_s + 1
    to: list[int] = []
    room: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, r: int) -> None:  # arc i and its reverse i ^ 1
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((r, 0))

    for p in range(n_p):
        arc(start, p, 0)
    for p in range(n_p):
        for s in members[p]:
            arc(p, n_p + s, sum(quota))
    for s in range(n_s):
        arc(n_p + s, end, quota[s])

    def levels() -> list[int]:
        level = [-1] * (end + 1)
        level[start], queue = 0, [start]
        for v in queue:
            for i in arcs[v]:
                if room[i] and level[to[i]] < 0:
                    level[to[i]] = level[v] + 1
                    queue.append(to[i])
        return level

    for _ in range(repeats):
        for p in range(n_p):
            room[2 * p] += capacity[p]
        while (level := levels())[end] >= 0:
            tried = [0] * (end + 1)
            path: list[int] = []  # arcs from the start to where the search is
            v = start
            while True:
                if v == end:
                    push = min(room[i] for i in path)
                    for k, i in enumerate(path):
                        room[i] -= push
                        room[i ^ 1] += push
                    k = next(k for k, i in enumerate(path) if not room[i])
                    v, path = to[path[k] ^ 1], path[:k]
                    continue
                while tried[v] < len(arcs[v]):
                    i = arcs[v][tried[v]]
                    if room[i] and level[to[i]] == level[v] + 1:
                        break
                    tried[v] += 1
                if tried[v] < len(arcs[v]):
                    path.append(arcs[v][tried[v]])
                    v = to[path[-1]]
                elif path:  # a dead end: back, and on with the next arc
                    v = to[path.pop() ^ 1]
                    tried[v] += 1
                else:
                    break
    return [{to[i] - n_p: room[i ^ 1] for i in arcs[p] if n_p <= to[i] < start and room[i ^ 1]} for p in range(n_p)]


@dataclass
class Mix:
    """``targets``, ``sizes``: by source.  ``flows``: (pattern, source, tokens).

    ``rows``: the documents' kept columns with ``__pattern``, ``__o`` (seeded order) and ``__size``, stored.
    ``plan``: for each pattern the ends of its sources' shares, as (layer, below, cut, take, m, source): copies of a layer
    below ``layer``, or of that layer and before the cut in the seeded order, go to the first such source.
    ``partial``: whether a cut divides equal rows.
    """

    targets: dict[Source, float]
    sizes: dict[Source, int]
    flows: list[tuple[tuple[Source, ...], Source, int]]
    rows: DataFrame
    plan: DataFrame
    partial: bool
    seed: int
    repeats: int

    def routed(self, keyed: DataFrame) -> DataFrame:
        """``keyed(__pattern, __o, ...)`` with ``__routes``: the source of each copy that the mix takes of a row."""
        joined = keyed.join(F.broadcast(self.plan), "__pattern", "left").withColumn("__rank", F.lit(0).cast("long"))
        if self.partial:
            split = F.coalesce(F.exists("__ends", lambda e: (e["cut"] == F.col("__o")) & (e["take"] < e["m"])), F.lit(False))
            joined = joined.withColumn("__split", split)
            names = keyed.columns
            some = stored(joined.where("__split").select(*names, F.spark_partition_id().alias("__pid"), F.monotonically_increasing_id().alias("__row")), "equal")
            own = Window.partitionBy("__pattern", "__o", "__pid").orderBy("__row")
            before = Window.partitionBy("__pattern", "__o").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
            bases = some.groupBy("__pattern", "__o", "__pid").agg(F.count("*").alias("n")).select(
                "__pattern", "__o", "__pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
            ranked = some.withColumn("own", F.row_number().over(own) - 1).join(bases, ["__pattern", "__o", "__pid"]).select(
                *names, (F.col("base") + F.col("own")).alias("__rank"))
            joined = joined.where("not __split").drop("__split").unionByName(
                ranked.join(F.broadcast(self.plan), "__pattern", "left").select(*joined.drop("__split").columns))

        def taken(layer: int) -> Column:
            def inside(e: Column) -> Column:
                at = (F.col("__o") < e["below"]) | (F.col("__o") < e["cut"]) | ((F.col("__o") == e["cut"]) & (F.col("__rank") < e["take"]))
                return (e["layer"] > layer) | ((e["layer"] == layer) & F.coalesce(at, F.lit(False)))

            return F.get(F.filter(F.coalesce("__ends", F.array().cast(_ENDS)), inside), F.lit(0))

        routes = F.filter(F.array(*[taken(k) for k in range(self.repeats)]), lambda x: x.isNotNull())
        return joined.withColumn("__routes", F.transform(routes, lambda x: x["source"])).drop("__ends", "__rank")

    def times_of(self, docs: DataFrame, sources: Column) -> DataFrame:
        """``docs`` with ``__times``, the copies of each row that the mix takes (0: left out), and ``__routes``."""
        keyed = docs.withColumns({"__pattern": _pattern(sources), "__o": _order(self.seed)})
        return self.routed(keyed).withColumn("__times", F.size("__routes")).drop("__pattern", "__o")


_ENDS = "array<struct<i:int,layer:int,below:string,cut:string,take:bigint,m:bigint,source:string>>"


def _pattern(sources: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(sources)), {"ignoreNullFields": "false"})


def _order(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"),
                          F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null"))))


def mix(docs: DataFrame, sources: Column, targets: Callable[[dict[Source, int], int], dict[Source, float]],
        repeats: int = 2, seed: int = 17, max_patterns: int = 10_000, docs_a_bucket: int = 20_000,
        size: Column | None = None, keep: Sequence[str] = ()) -> Mix:
    """Plan that takes tokens of ``docs(doc_id, text, ...)`` so that each source meets its target.

    ``sources`` is an array column, the sources a document belongs to (null elements count as a
    source of their own); ``targets`` maps the sizes by source and the total size to tokens wanted.
    Documents are aggregated by membership pattern; the pattern table has at most
    ``max_patterns`` rows or this raises, so it may be solved on the driver and broadcast.  A pattern's documents lie
    in a seeded order of doc_id and text, one layer for each copy; its flow is a run from the start, cut into the shares
    of its sources, each up to the nearest document.  The cuts are found
    in two steps (sums over digest prefixes, then the one prefix in which a share ends), so no
    task sorts a pattern.  Rows equal in doc_id and text are summed before they are sorted and told apart by a number of their own:
    a share may end between them.  Null text has
    size 0.  An empty table gives an empty plan.  The ``keep`` columns go into the plan's ``rows``.
    """
    counted = words(F.col("text")) if size is None else size
    narrow = stored(docs.select(
        *keep, _pattern(sources).alias("__pattern"), _order(seed).alias("__o"), counted.cast("long").alias("__size")), "sizes")
    found = narrow.groupBy("__pattern").agg(F.sum("__size").alias("size"), F.count("*").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    seen = sorted((r[0], json.loads(r[0] or "[]"), r[1], r[2]) for r in found)
    names = sorted({s for r in seen for s in r[1]}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(names)}
    sizes = {s: 0 for s in names}
    for _, members, n, _ in seen:
        for s in members:
            sizes[s] += n
    wanted = targets(sizes, sum(r[2] for r in seen))
    quota = [math.floor(wanted[s] + 0.5) for s in names]
    flows = min_cost_flow([r[2] for r in seen], [[at[s] for s in r[1]] for r in seen], quota, repeats)
    ends = []
    for (pattern, _, n, _), flow in zip(seen, flows):
        upto = 0
        for i, s in enumerate(sorted(flow)):
            upto += flow[s]
            ends.append((pattern, i, names[s], upto // n, upto % n))
    base = docs.sparkSession.createDataFrame(ends, "__pattern string, i int, source string, layer int, rest long").coalesce(1)
    digits = 1
    while 16**digits * docs_a_bucket < max((r[3] for r in seen), default=0):
        digits += 1
    cut = F.substring("__o", 1, digits)
    by = Window.partitionBy("__pattern").orderBy("below")
    sums = (
        narrow.groupBy("__pattern", cut.alias("below")).agg(F.sum("__size").alias("size"))
        .withColumn("upto", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    )
    edge = stored(
        sums.join(F.broadcast(base), "__pattern").where("rest > 0 and upto > rest and upto - size <= rest and size > 0")
        .select("__pattern", "i", "rest", "below", F.expr("upto - size").alias("before")), "edge")
    inside = (
        narrow.withColumn("below", cut).join(F.broadcast(edge), ["__pattern", "below"])
        .groupBy("__pattern", "i", "rest", "below", "before", "__o").agg(F.count("*").alias("m"), F.max("__size").alias("s"))
    )
    run = Window.partitionBy("__pattern", "i").orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)
    room = F.floor((2 * F.col("rest") - 2 * F.col("b") - F.col("s")) / (2 * F.col("s"))) + 1
    room = F.when(F.col("s") > 0, F.least(F.greatest(room, F.lit(0)), F.col("m"))).otherwise(
        F.when(F.col("b") <= F.col("rest"), F.col("m")).otherwise(0))
    last = (
        inside.withColumn("b", F.col("before") + F.coalesce(F.sum(F.col("m") * F.col("s")).over(run), F.lit(0)))
        .withColumn("take", room.cast("long")).where("take > 0").groupBy("__pattern", "i")
        .agg(F.max(F.struct(F.col("__o").alias("cut"), "take", "m")).alias("c"))
    )
    each = stored(
        base.join(edge.select("__pattern", "i", "below"), ["__pattern", "i"], "left").join(last, ["__pattern", "i"], "left")
        .groupBy("__pattern").agg(F.array_sort(F.collect_list(F.struct(
            "i", "layer", "below", F.col("c.cut").alias("cut"), F.col("c.take").alias("take"), F.col("c.m").alias("m"), "source"))).alias("__ends")), "plan")
    partial = not each.where(F.exists("__ends", lambda e: e["take"] < e["m"])).isEmpty()
    return Mix(wanted, sizes, [(tuple(r[1]), names[s], x) for r, f in zip(seen, flows) for s, x in f.items()],
               narrow, each, partial, seed, repeats)


def cycle_weights(weights: Sequence[float], share: float, most: float):
    """Targets for sources in code-point order (null last) that weigh ``weights``, repeating."""

    def targets(sizes: dict[Source, int], total: int) -> dict[Source, float]:
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        return capped_shares(sizes, {s: weights[i % len(weights)] for i, s in enumerate(names)}, share * total, most)

    return targets


def mixed(docs: DataFrame, sources: Column, plan: Mix, routed: str | None = None) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the plan takes it, columns unchanged.

    ``routed`` names a column for the source that each copy counts for.
    """
    copies = plan.times_of(docs, sources).select(*[F.col(c) for c in docs.columns if c != routed], F.explode("__routes").alias("__source"))
    return copies.select(*[F.col(c) for c in docs.columns if c != routed], *([F.col("__source").alias(routed)] if routed else []))
