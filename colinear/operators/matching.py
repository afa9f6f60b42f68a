"""Match lifecycle: acceptance, best hits, flags, propagation, synteny support, projection.

A match row is ``org1, id1, org2, id2, kind, score, own_start, own_end, other_start, other_end,
inverted``; both directions are stored.  ``kind`` is regular, dup or not_considered.  Every step
is a join or an aggregation on (org, id) keys; nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["org1", "id1", "org2"]
FULL = [*PAIR, "id2"]
SWAP = {"org1": "org2", "id1": "id2", "org2": "org1", "id2": "id1", "own_start": "other_start",
        "own_end": "other_end", "other_start": "own_start", "other_end": "own_end"}


def accepted(score: Column, threshold: Column, is_dup: Column) -> Column:
    """A duplication on either side, or a score above threshold + its square root."""
    return is_dup | (score > threshold + F.sqrt(threshold))


def strictly_accepted(score: Column, own: Column, other: Column, best: Column, default: float = 40.0) -> Column:
    """Score above twice the larger threshold; where both are the default also a tenth of the best score."""
    bare = (own == default) & (other == default)
    return (score > 2 * F.greatest(own, other)) & (~bare | (score >= best / 10))


def swapped(df: DataFrame) -> DataFrame:
    """The same matches seen from the other side."""
    return df.select(*[F.col(SWAP.get(c, c) if SWAP.get(c) in df.columns else c).alias(c) for c in df.columns])


def both_directions(df: DataFrame) -> DataFrame:
    return df.unionByName(swapped(df))


def best_first(df: DataFrame, keys: Sequence[str], *order: Column, keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key in a total order; cut off before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= keep).drop("__rn")


def merge_keep_best(tables: Sequence[DataFrame], keys: Sequence[str] = FULL, score: str = "score") -> DataFrame:
    """Union of result tables with one row a key: that of the highest score (least row on ties).

    An aggregation with map-side combining, so repeated results shrink before they move.
    """
    all_rows = tables[0]
    for t in tables[1:]:
        all_rows = all_rows.unionByName(t)
    rest = [c for c in all_rows.columns if c not in keys and c != score]
    top = F.min_by(F.struct(score, *rest), F.struct(-F.col(score), *rest)).alias("__top")
    return all_rows.groupBy(*keys).agg(top).select(*keys, *[F.col(f"__top.{c}").alias(c) for c in [score, *rest]])


def reciprocal_best(edges: DataFrame) -> DataFrame:
    """``edges(gene1, sp1, gene2, sp2, score)`` in both directions -> mutual best pairs, gene1 < gene2.

    Best of each gene in each other species; ties to the smaller gene.
    """
    top = best_first(edges, ["gene1", "sp2"], F.desc("score"), F.col("gene2"))
    back = top.select(F.col("gene1").alias("gene2"), F.col("gene2").alias("gene1"))
    return top.join(back, ["gene1", "gene2"], "left_semi").where("gene1 < gene2")


def not_reciprocated(matches: DataFrame) -> DataFrame:
    """Matches whose partner doesn't point back."""
    back = matches.select(F.col("org2").alias("org1"), F.col("id2").alias("id1"),
                          F.col("org1").alias("org2"), F.col("id1").alias("id2"))
    return matches.join(back, FULL, "left_anti")


def flag_pairs(matches: DataFrame) -> DataFrame:
    """``(org1, id1, org2, ambiguous)``: true if any match of the pair isn't reciprocated.

    Both directions of a match meet in one group, whichever side comes first.
    """
    a, b = F.struct(F.col("org1").alias("org"), F.col("id1").alias("id")), F.struct(F.col("org2").alias("org"), F.col("id2").alias("id"))
    met = matches.groupBy(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).agg(
        F.bool_or(a <= b).alias("there"), F.bool_or(a >= b).alias("back"))
    side = lambda f, t: F.struct(f["org"].alias("org1"), f["id"].alias("id1"), t["org"].alias("org2"))
    x, y = F.col("x"), F.col("y")
    sides = F.filter(F.array(F.when(F.col("there"), side(x, y)), F.when(F.col("back"), side(y, x))), lambda s: s.isNotNull())
    return met.select(F.explode(sides).alias("s"), (~(F.col("there") & F.col("back"))).alias("odd")).groupBy("s").agg(
        F.bool_or("odd").alias("ambiguous")).select("s.org1", "s.id1", "s.org2", "ambiguous")


def mutual(chosen: DataFrame) -> DataFrame:
    """Pairs that chose each other, once each (org1 < org2), with the score of both sides."""
    other = chosen.select(F.col("org2").alias("org1"), F.col("id2").alias("id1"), F.col("org1").alias("org2"),
                          F.col("id1").alias("id2"), F.col("score").alias("score_back"))
    return chosen.join(other, FULL).where("org1 < org2")


def spread_flags(targets: DataFrame, keys: Sequence[str] = PAIR, tolerance: int = 10_000) -> DataFrame:
    """``out_of_tolerance, different_chromosomes`` of each key's targets ``(seqid, start, end)``.

    More than one sequence sets both; else the largest gap between consecutive targets (by start
    and end, each against the row before only) decides.
    """
    order = Window.partitionBy(*keys, "seqid").orderBy("start", "end")
    gap = F.col("start") - F.lag("end").over(order)
    per = targets.withColumn("__gap", gap).groupBy(*keys, "seqid").agg(F.max("__gap").alias("__gap"))
    many = F.count("*") > 1
    return per.groupBy(*keys).agg(
        (many | (F.coalesce(F.max("__gap"), F.lit(0)) > tolerance)).alias("out_of_tolerance"),
        many.alias("different_chromosomes"))


def raise_in_others(flags: DataFrame, matches: DataFrame) -> DataFrame:
    """Flags of each pair, raised by those of the pairs that point at it; never lowered."""
    names = [c for c in flags.columns if c not in PAIR]
    told = (
        matches.join(flags, PAIR)
        .select(F.col("org2").alias("org1"), F.col("id2").alias("id1"), F.col("org1").alias("org2"), *names)
        .groupBy(*PAIR).agg(*[F.bool_or(c).alias(f"__{c}") for c in names])
    )
    return flags.join(told, PAIR, "left").select(
        *PAIR, *[(F.col(c) | F.coalesce(f"__{c}", F.lit(False))).alias(c) for c in names])


def order_flags(matches: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """``different_strands, not_in_order``: mixed strands set both; else hits in their own anchor
    must follow the order of target ids (the reverse if inverted)."""
    order = Window.partitionBy(*keys).orderBy("own_start", "own_end", "id2")
    last = F.lag("id2").over(order)
    steps = matches.select(*keys, "inverted", F.coalesce(F.col("id2") < last, F.lit(False)).alias("down"), F.coalesce(F.col("id2") > last, F.lit(False)).alias("up"))
    return steps.groupBy(*keys).agg(
        (F.min("inverted") != F.max("inverted")).alias("different_strands"),
        F.when(F.max("inverted"), F.max("up")).otherwise(F.max("down")).alias("odd"),
    ).select(*keys, "different_strands", (F.col("different_strands") | F.col("odd")).alias("not_in_order"))


def refilter(matches: DataFrame, flags: DataFrame, strict: Column) -> DataFrame:
    """Regular matches of flagged pairs that fail ``strict`` become ``not_considered``."""
    marked = matches.join(flags.select(*PAIR, "out_of_tolerance"), PAIR, "left")
    weak = (F.col("kind") == "regular") & F.coalesce("out_of_tolerance", F.lit(False)) & ~strict
    return marked.withColumn("kind", F.when(weak, "not_considered").otherwise(F.col("kind"))).drop("out_of_tolerance")


def propagate(matches: DataFrame) -> DataFrame:
    """What one side no longer considers the other drops too."""
    out = matches.where("kind = 'not_considered'").select(
        F.col("org2").alias("org1"), F.col("id2").alias("id1"), F.col("org1").alias("org2"), F.col("id1").alias("id2")
    ).distinct().withColumn("__told", F.lit(True))
    return matches.join(out, FULL, "left").withColumn(
        "kind", F.when(F.col("__told") & (F.col("kind") == "regular"), "not_considered").otherwise(F.col("kind"))).drop("__told")


def drop_repeated(matches: DataFrame) -> DataFrame:
    """Not-considered rows that a considered row of the same key and score repeats go."""
    live = matches.where("kind <> 'not_considered'").select(*FULL, "score")
    idle = matches.where("kind = 'not_considered'").join(live, [*FULL, "score"], "left_anti")
    return matches.where("kind <> 'not_considered'").unionByName(idle)


def clean_pairs(matches: DataFrame, flags: DataFrame) -> DataFrame:
    """Matches of pairs that are neither out of tolerance nor ambiguous."""
    bad = flags.where("out_of_tolerance or ambiguous").select(*PAIR)
    return matches.join(bad, PAIR, "left_anti")


def synteny_support(dups: DataFrame, neighbours: DataFrame, keys: Sequence[str], margin: int = 100_000,
                    least: float = 500.0) -> DataFrame:
    """``dups`` with the scores that neighbours give on four sides and ``syntenic``.

    ``dups(keys, id1, pos1, id2, pos2)``, ``neighbours(keys, id1, pos1, id2, pos2, score)``; positions
    on the source and the target axis.  A neighbour counts if it is less than ``margin`` away on
    both axes and has another source and target; left and right go by position.  Syntenic means at
    least ``least`` on each of source left and right, target left and right.  Both sides meet in
    bins of ``margin`` on the source axis.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(margin))
    a = dups.withColumn("__bin", F.explode(F.array(*[cell("pos1") + i for i in (-1, 0, 1)])))
    b = neighbours.select(*keys, *[F.col(c).alias(f"n_{c}") for c in ("id1", "pos1", "id2", "pos2", "score")],
                          cell("pos1").alias("__bin"))
    d1, d2 = F.col("n_pos1") - F.col("pos1"), F.col("n_pos2") - F.col("pos2")
    near = (F.abs(d1) < margin) & (F.abs(d2) < margin) & (F.col("n_id1") != F.col("id1")) & (F.col("n_id2") != F.col("id2"))
    side = lambda c: F.sum(F.when(c, F.col("n_score")).otherwise(0.0))
    own = [*keys, "id1", "id2"]
    sums = a.join(b, [*keys, "__bin"]).where(near).groupBy(*own).agg(
        side(d1 < 0).alias("source_left"), side(d1 > 0).alias("source_right"),
        side(d2 < 0).alias("target_left"), side(d2 > 0).alias("target_right"))
    names = ["source_left", "source_right", "target_left", "target_right"]
    out = dups.join(sums, own, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in names})
    return out.withColumn("syntenic", F.least(*names) >= least)


def succinct(matches: DataFrame) -> DataFrame:
    """One match for each (anchor, organism): the smallest target id, regular before syntenic dup.

    Not-considered rows and dups that aren't syntenic take no part; scores are cut to integers.
    """
    usable = matches.where("kind = 'regular' or (kind = 'dup' and syntenic)")
    rank = F.when(F.col("kind") == "regular", 0).otherwise(1)
    return best_first(usable, PAIR, rank, F.col("id2")).withColumn("score", F.col("score").cast("int"))


def without_dups(matches: DataFrame, dup_ids: DataFrame) -> DataFrame:
    """No duplication matches and no duplication anchors (``org, id``)."""
    own = dup_ids.select(F.col("org").alias("org1"), F.col("id").alias("id1"))
    other = dup_ids.select(F.col("org").alias("org2"), F.col("id").alias("id2"))
    return matches.where("kind <> 'dup'").join(own, ["org1", "id1"], "left_anti").join(other, ["org2", "id2"], "left_anti")


def pairs_to_compute(compute: DataFrame, everything: DataFrame, org: str = "org") -> DataFrame:
    """Unordered pairs (org1, org2) of each organism to compute with all others, none twice.

    Both are lists of organisms, so the product is small by nature.
    """
    a, b = compute.select(F.col(org).alias("a")), everything.select(F.col(org).alias("b"))
    return a.crossJoin(F.broadcast(b)).where("a <> b").select(
        F.least("a", "b").alias("org1"), F.greatest("a", "b").alias("org2")).distinct()


def checked_pairs(pairs: DataFrame, known: DataFrame, org: str = "org") -> tuple[DataFrame, DataFrame]:
    """A custom pair list: ``(distinct pairs in order, problems)`` with every problem named."""
    ids = F.broadcast(known.select(F.col(org).alias("k")).distinct())
    self_pairs = pairs.where("org1 = org2").select(F.concat(F.lit("pair with itself: "), "org1").alias("problem"))
    odd = [pairs.join(ids, F.col(c) == F.col("k"), "left_anti").select(F.concat(F.lit("unknown: "), c).alias("problem"))
           for c in ("org1", "org2")]
    good = (
        pairs.where("org1 <> org2").join(ids, F.col("org1") == F.col("k"), "left_semi")
        .join(ids, F.col("org2") == F.col("k"), "left_semi")
        .select(F.least("org1", "org2").alias("org1"), F.greatest("org1", "org2").alias("org2")).distinct()
    )
    return good, self_pairs.union(odd[0]).union(odd[1]).distinct()


def opposite_sides(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges whose genes lie on opposite sides of a chain: ``members(gene, chain, side)``."""
    a = members.select(F.col("gene").alias("gene1"), "chain", F.col("side").alias("s1"))
    b = members.select(F.col("gene").alias("gene2"), "chain", F.col("side").alias("s2"))
    hit = edges.join(a, "gene1").join(b, ["gene2", "chain"]).where("s1 <> s2").select("gene1", "gene2").distinct()
    return edges.join(hit, ["gene1", "gene2"], "left_semi")


def pairs_sharing(members: DataFrame, item: str, group: str, least: int) -> DataFrame:
    """Pairs of items (a < b) that share at least ``least`` groups."""
    m = members.select(F.col(item).alias("a"), F.col(group).alias("g")).distinct()
    return (
        m.join(m.select(F.col("a").alias("b"), "g"), "g").where("a < b").groupBy("a", "b")
        .agg(F.count("*").alias("n")).where(F.col("n") >= least)
    )


def correspondence(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one of the tables has: ``side`` is left or right."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(1))
    return a.join(b, list(keys), "full_outer").where("__l is null or __r is null").select(
        *keys, F.when(F.col("__r").isNull(), "left").otherwise("right").alias("side"))


def nearest_neighbours(elements: DataFrame, anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``upstream`` and ``downstream`` anchor of each element: the nearest one that ends before its
    start and the nearest one that starts after its end; null if none, ties to the smaller id.

    ``elements(keys, id, start, end)``, ``anchors(keys, id, start, end)``: two as-of joins, each one
    sort of both tables by position.
    """
    def asof(points: DataFrame, marks: DataFrame, name: str) -> DataFrame:
        both = points.select(*keys, "id", "at", F.lit(None).cast("struct<at:bigint,neg:bigint>").alias("mark")).unionByName(
            marks.select(*keys, F.lit(None).cast("bigint").alias("id"), "at",
                         F.struct("at", (-F.col("id")).alias("neg")).alias("mark")))
        w = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
        return both.withColumn("best", F.max("mark").over(w)).where("id is not null").select(
            *keys, "id", (-F.col("best.neg")).alias(name))

    up = asof(elements.withColumn("at", F.col("start").cast("long")), anchors.withColumn("at", F.col("end").cast("long")), "upstream")
    down = asof(elements.withColumn("at", -F.col("end").cast("long")), anchors.withColumn("at", -F.col("start").cast("long")), "downstream")
    return elements.join(up, [*keys, "id"]).join(down, [*keys, "id"])
