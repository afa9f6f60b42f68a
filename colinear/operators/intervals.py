"""Interval algebra on DataFrames.

Intervals meet by bins: both sides are exploded over the bins they cover, joined on key and
bin, and a pair counts only in the first bin it shares.  That keeps range joins equi-joins
(no nested loops, no duplicates to remove) and spreads one key's rows over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

Span = tuple[str, str]


def overlaps(a: Span, b: Span, closed: bool = True) -> Column:
    """True if the intervals share a point; ``closed`` ones also if they touch."""
    if closed:
        return (F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1]))
    return (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1]))


def overlap_length(a: Span, b: Span) -> Column:
    """Length shared, 0 if none."""
    return F.greatest(F.least(a[1], b[1]) - F.greatest(a[0], b[0]), F.lit(0))


def _bin(c: str, width: int) -> Column:
    return F.floor(F.col(c) / F.lit(width)).cast("long")


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], l: Span, r: Span, width: int,  # noqa: E741
                  closed: bool = True, how: str = "inner", extra: Column | None = None,
                  row_id: Sequence[str] | None = None) -> DataFrame:
    """Pairs of rows equal in ``keys`` whose spans overlap.

    ``how``: inner, left_semi, left_anti or left; all but inner need ``row_id``, columns that tell
    the left rows apart (default: all).  ``extra`` is one more condition on the pair.  Columns of
    the right side whose names clash get the prefix ``r_``.  ``width`` should be near the 95th
    percentile of the lengths.
    """
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    rr = right.select(*[F.col(c).alias(f"__k_{c}") for c in keys],
                      *[F.col(c).alias(f"r_{c}" if c in clash else c) for c in right.columns if c not in keys])
    r = tuple(f"r_{c}" if c in clash else c for c in r)  # type: ignore[assignment]
    le = left.withColumn("__bin", F.explode(F.sequence(_bin(l[0], width), F.greatest(_bin(l[0], width), _bin(l[1], width)))))
    re = rr.withColumn("__rbin", F.explode(F.sequence(_bin(r[0], width), F.greatest(_bin(r[0], width), _bin(r[1], width)))))
    cond = F.col("__bin") == F.col("__rbin")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    cond = cond & overlaps(l, r, closed) & (F.col("__bin") == F.greatest(_bin(l[0], width), _bin(r[0], width)))
    if extra is not None:
        cond = cond & extra
    met = le.join(re, cond, "inner").drop("__bin", "__rbin", *[f"__k_{k}" for k in keys])
    if how == "inner":
        return met
    ids = list(row_id or left.columns)
    if how in ("left_semi", "left_anti"):
        return left.join(met.select(*ids).distinct(), ids, how)
    own = met.select(*ids, *[c for c in met.columns if c not in left.columns])
    return left.join(own, ids, "left")


def self_overlaps(df: DataFrame, keys: Sequence[str], span: Span, row_id: str, width: int, closed: bool = True) -> DataFrame:
    """Each unordered overlapping pair of different rows once (smaller ``row_id`` first)."""
    return interval_join(df, df, keys, span, span, width, closed, extra=F.col(row_id) < F.col(f"r_{row_id}"))




def island_ids(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end",
               gap: int | Column = 0, name: str = "island") -> DataFrame:
    """Adds the number (from 1) of the island each interval is in: running maximum of ends plus ``gap``."""
    g = gap if isinstance(gap, Column) else F.lit(gap)
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("__new", F.when(F.col(start) <= reach + g, 0).otherwise(1))
    return flagged.withColumn(
        name, F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merge_islands(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", gap: int = 0,
                  aggs: Sequence[Column] = (), block: int | None = None) -> DataFrame:
    """Merged intervals: neighbours at most ``gap`` apart unite; ``n`` counts what went in.

    With ``block`` the rows first merge within blocks of that many positions, in parallel even
    for one hot key, and then the few remaining intervals merge across blocks (uniting is
    associative); only without ``aggs``.
    """
    if block is not None and not aggs:
        part = df.withColumn("__block", F.floor(F.col(start) / F.lit(block)))
        first = (
            island_ids(part, [*keys, "__block"], start, end, gap).groupBy(*keys, "__block", "island")
            .agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))
        )
        return (
            island_ids(first, keys, start, end, gap).groupBy(*keys, "island")
            .agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n")).drop("island")
        )
    return (
        island_ids(df, keys, start, end, gap).groupBy(*keys, "island")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *aggs).drop("island")
    )


def merge_varying_gap(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: str) -> DataFrame:
    """Merge where two neighbours may be as far apart as the larger of their own ``gap`` values."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    g = F.greatest(F.col(gap), F.coalesce(F.lag(gap).over(order), F.col(gap)))
    return island_ids(df.withColumn("__g", g), keys, start, end, F.col("__g")).groupBy(*keys, "island").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("island")


def cluster_by_previous(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end",
                        margin: int = 0, name: str = "cluster") -> DataFrame:
    """Adds a cluster number: a new one begins where the gap from the *previous row's* end exceeds ``margin``."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    new = F.when(F.col(start) - F.lag(end).over(order) <= margin, 0).otherwise(1)
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(run)).drop("__new")


def step_max(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", score: str = "score",
             width: int = 1 << 14) -> DataFrame:
    """Disjoint segments ``lo, hi, score`` with the highest score of the intervals that cover them.

    Intervals are grouped into touching islands; between consecutive end points of an island the
    maximum is constant, and neighbours of equal score unite.  Segments meet the intervals that
    cover them in bins of ``width``, so a long island isn't a product of its rows.  Intervals of
    no length are skipped.
    """
    own = stored(island_ids(df.where(F.col(start) < F.col(end)).select(*keys, start, end, score), keys, start, end), "islands")
    group = [*keys, "island"]
    points = own.select(*group, F.explode(F.array(start, end)).alias("lo")).distinct()
    cuts = points.withColumn("hi", F.lead("lo").over(Window.partitionBy(*group).orderBy("lo"))).where("hi is not null")
    covers = own.select(*group, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(score).alias("__v"))
    top = (
        interval_join(cuts, covers, group, ("lo", "hi"), ("__s", "__e"), width, closed=False)
        .groupBy(*group, "lo", "hi").agg(F.max("__v").alias("score"))
    )
    order = Window.partitionBy(*group).orderBy("lo")
    new = F.when((F.lag("score").over(order) == F.col("score")) & (F.lag("hi").over(order) == F.col("lo")), 0).otherwise(1)
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        top.withColumn("__new", new).withColumn("__run", F.sum("__new").over(run))
        .groupBy(*group, "__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("score").alias("score"))
        .drop("__run", "island")
    )


def fill_gaps(segments: DataFrame, bounds: DataFrame, keys: Sequence[str], default: float) -> DataFrame:
    """``segments(lo, hi, score)`` with holes and both ends up to ``bounds(lo0, hi0)`` filled by ``default``.

    Keys without segments are one hole; segments of keys without bounds stay as they are.  One pass over each table.
    """
    order = Window.partitionBy(*keys).orderBy("lo")
    own = segments.select(*keys, "lo", "hi", F.col("score").cast("double").alias("score")).join(bounds, list(keys), "full_outer")
    own = own.withColumns({"__before": F.coalesce(F.lag("hi").over(order), F.col("lo0")), "__last": F.lead("lo").over(order).isNull()})
    piece = lambda lo, hi, score: F.struct(lo.alias("lo"), hi.alias("hi"), score.alias("score"))
    hole = F.lit(float(default))
    lo, hi = F.col("lo"), F.col("hi")
    made = F.array(
        F.when(lo.isNotNull(), piece(lo, hi, F.col("score"))), F.when(F.col("__before") < lo, piece(F.col("__before"), lo, hole)),
        F.when(F.col("__last") & (hi < F.col("hi0")), piece(hi, F.col("hi0"), hole)),
        F.when(lo.isNull() & (F.col("lo0") < F.col("hi0")), piece(F.col("lo0"), F.col("hi0"), hole)))
    return own.select(*keys, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("p")).select(*keys, "p.lo", "p.hi", "p.score")


def range_max(segments: Column, start: Column, end: Column) -> Column:
    """Highest ``score`` of an array of ``struct<lo,hi,score>`` over the segments touched by [start, end].

    The end of a hit on a breakpoint takes the segment before it, its start the one after; both are
    clamped to the first segment; a start at or past the last breakpoint is null.
    """
    lo = F.greatest(start, F.element_at(segments, 1)["lo"])
    hi = F.greatest(end, lo + 1)
    touched = F.filter(segments, lambda s: (s["lo"] < hi) & (s["hi"] > lo))
    return F.array_max(F.transform(touched, lambda s: s["score"]))


def longest_remainder(regions: DataFrame, cuts: DataFrame, keys: Sequence[str], row_id: str, width: int,
                      least: int = 50) -> DataFrame:
    """The longest stretch of each region that no cut covers, if it has ``least`` positions.

    ``regions(keys, row_id, start, end)``, ``cuts(keys, start, end)``; half-open; ties to the leftmost.
    """
    r = regions.select(*keys, row_id, "start", "end")
    met = interval_join(r, cuts.select(*keys, F.col("start").alias("c0"), F.col("end").alias("c1")), keys,
                        ("start", "end"), ("c0", "c1"), width, closed=False)
    clipped = met.select(*keys, row_id, F.col("start").alias("a"), F.col("end").alias("z"),
                         F.greatest("c0", "start").alias("s"), F.least("c1", "end").alias("e"))
    order = Window.partitionBy(*keys, row_id).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = clipped.select(*keys, row_id, F.coalesce(reach, F.col("a")).alias("lo"), F.col("s").alias("hi"))
    tail = clipped.groupBy(*keys, row_id).agg(F.max("e").alias("lo"), F.first("z").alias("hi"))
    whole = r.join(clipped.select(*keys, row_id).distinct(), [*keys, row_id], "left_anti").select(
        *keys, row_id, F.col("start").alias("lo"), F.col("end").alias("hi"))
    best = F.max(F.struct((F.col("hi") - F.col("lo")).alias("len"), (-F.col("lo")).alias("neg"), "hi")).alias("b")
    return (
        gaps.unionByName(tail).unionByName(whole).where("lo < hi").groupBy(*keys, row_id).agg(best)
        .where(F.col("b.len") >= least)
        .select(*keys, row_id, (-F.col("b.neg")).alias("lo"), F.col("b.hi").alias("hi"))
    )


def clip_with_penalty(hits: DataFrame, lo: str, hi: str, penalty: float = 2.0, least: float = 50.0) -> DataFrame:
    """Hits cut to [lo, hi], each position cut off costing ``penalty``; those under ``least`` go."""
    start, end = F.greatest("start", lo), F.least("end", hi)
    cut = (start - F.col("start")) + (F.col("end") - end)
    return (
        hits.where(overlaps(("start", "end"), (lo, hi))).withColumn("score", F.col("score") - penalty * cut)
        .withColumns({"start": start, "end": end}).where(F.col("score") >= least)
    )


def resolve_dups(dups: DataFrame, candidates: DataFrame, keys: Sequence[str], width: int, share: float = 0.3,
                 gap: int = 100, least: int = 300) -> tuple[DataFrame, DataFrame]:
    """Duplications against candidates: ``(dups kept, ids of candidates deleted)``.

    A candidate covered by less than ``share`` shrinks the duplication by the overlap and ``gap`` on
    that side (the largest shrinkage of each side counts); else the candidate goes.  A
    duplication shorter than ``least`` afterwards is dropped.  ``id, start, end`` on both sides.
    """
    met = interval_join(dups, candidates, keys, ("start", "end"), ("start", "end"), width)
    part = met.withColumn("ov", overlap_length(("start", "end"), ("r_start", "r_end"))).withColumn(
        "few", F.col("ov") < share * (F.col("r_end") - F.col("r_start")))
    gone = part.where("not few").select(*keys, F.col("r_id").alias("id")).distinct()
    left = F.when(F.col("few") & (F.col("r_start") <= F.col("start")), F.col("ov") + gap)
    right = F.when(F.col("few") & (F.col("r_start") > F.col("start")), F.col("ov") + gap)
    cut = part.groupBy(*keys, "id").agg(F.max(left).alias("cl"), F.max(right).alias("cr"))
    kept = (
        dups.join(cut, [*keys, "id"], "left")
        .withColumns({"start": F.col("start") + F.coalesce("cl", F.lit(0)), "end": F.col("end") - F.coalesce("cr", F.lit(0))})
        .where(F.col("end") - F.col("start") >= least).drop("cl", "cr")
    )
    return kept, gone


def reciprocal_components(hits: DataFrame, keys: Sequence[str], width: int, share: float = 0.5, ratio: float = 2.0) -> DataFrame:
    """Edges ``(src, dst)`` between hits that cover each other: overlap over the shorter at least
    ``share`` and lengths within ``ratio``.  ``id, start, end``."""
    pairs = self_overlaps(hits, keys, ("start", "end"), "id", width)
    a, b = F.col("end") - F.col("start"), F.col("r_end") - F.col("r_start")
    ov = overlap_length(("start", "end"), ("r_start", "r_end"))
    return pairs.where((ov / F.least(a, b) >= share) & (F.greatest(a, b) / F.least(a, b) <= ratio)).select(
        F.col("id").alias("src"), F.col("r_id").alias("dst"))


def coverage_range(df: DataFrame, keys: Sequence[str], margin: int, start: str = "start", end: str = "end") -> DataFrame:
    """From the least start minus ``margin`` to the greatest end plus ``margin``."""
    return df.groupBy(*keys).agg((F.min(start) - margin).alias("lo"), (F.max(end) + margin).alias("hi"))


def block_spans(pairs: DataFrame) -> DataFrame:
    """``pairs(block_id, org1, chr1, start1, end1, org2, chr2, start2, end2)`` -> span by block and sequence."""
    sides = [F.struct(*[F.col(f"{c}{i}").alias(c) for c in ("org", "chr", "start", "end")]) for i in (1, 2)]
    return (
        pairs.select("block_id", F.explode(F.array(*sides)).alias("s")).groupBy("block_id", "s.org", "s.chr")
        .agg(F.min("s.start").alias("start"), F.max("s.end").alias("end"))
    )


def overlapping_neighbours(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Rows that reach the start of the next one: a clean table has none."""
    nxt = F.lead(start).over(Window.partitionBy(*keys).orderBy(start, end))
    return df.withColumn("next_start", nxt).where(F.col("next_start") <= F.col(end))
