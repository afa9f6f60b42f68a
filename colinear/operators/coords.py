"""Coordinate operators: cumulative offsets, locating positions, relative coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import interval_join, merge_islands


def cumulative_offsets(chrom: DataFrame, by: Sequence[str], order: Sequence[str], length: str = "length") -> DataFrame:
    """Adds ``abs_start`` and ``abs_end``: running sums of lengths in ``order`` within ``by``."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col(length).cast("long")).over(run)
    return chrom.withColumn("abs_end", end).withColumn("abs_start", F.col("abs_end") - F.col(length))


def locate(points: DataFrame, chrom: DataFrame, by: Sequence[str], pos: str = "pos",
           width: int = 1 << 24, how: str = "inner") -> DataFrame:
    """Each point with the columns of the sequence that holds it: ``abs_start <= pos < abs_end``.

    A position equal to a cumulative end belongs to the next sequence; one at or beyond the last
    end has none.  Both sides meet in bins of ``width``, so no key's rows meet in one task.
    """
    wide = points.withColumns({"__p0": F.col(pos), "__p1": F.col(pos) + 1})
    return interval_join(wide, chrom, by, ("__p0", "__p1"), ("abs_start", "abs_end"), width, closed=False,
                         how=how).drop("__p0", "__p1")


def relative(pos: Column, abs_start: Column) -> Column:
    """Position within its sequence."""
    return pos - abs_start


def within_one_sequence(spans: DataFrame, chrom: DataFrame, by: Sequence[str], start: str = "start",
                        end: str = "end", width: int = 1 << 24) -> DataFrame:
    """Spans of absolute coordinates whose first and last base lie in the same sequence."""
    found = locate(spans, chrom.select(*by, "seqid", "abs_start", "abs_end"), by, start, width)
    return found.where(F.col(end) <= F.col("abs_end"))


def flip(start: Column, end: Column, length: Column, pairwise: bool = True) -> tuple[Column, Column]:
    """Reverse-strand coordinates on the forward strand: start' = length - end (+ 1 for self hits)."""
    new = length - end if pairwise else length - end + 1
    return new, new + (end - start)


def region_to_genome(start: Column, end: Column, region_start: Column, region_end: Column,
                     reverse: Column, strand: Column) -> tuple[Column, Column, Column]:
    """Coordinates and strand of a hit in an extracted region, on the whole sequence."""
    lo = F.when(reverse, region_end - end + 1).otherwise(region_start + start)
    hi = F.when(reverse, region_end - start + 1).otherwise(region_start + end)
    turned = F.when(reverse, F.when(strand == "+", "-").otherwise("+")).otherwise(strand)
    return lo, hi, turned


def split_over_sequences(regions: DataFrame, chrom: DataFrame, by: Sequence[str], pad: int = 0,
                         found: str = "is_found", width: int = 1 << 24) -> DataFrame:
    """Regions cut at sequence ends, padded, clamped and merged; ``found`` is true if any part's is."""
    parts = interval_join(regions, chrom.select(*by, "seqid", "abs_start", "abs_end"), by,
                          ("start", "end"), ("abs_start", "abs_end"), width, closed=False)
    cut = parts.select(
        *by, "seqid", (F.greatest("start", "abs_start") - F.col("abs_start")).alias("s"),
        (F.least("end", "abs_end") - F.col("abs_start")).alias("e"),
        (F.col("abs_end") - F.col("abs_start")).alias("length"), found)
    padded = cut.select(
        *by, "seqid", F.greatest(F.col("s") - pad, F.lit(0)).alias("start"),
        F.least(F.col("e") + pad, F.col("length")).alias("end"), found)
    return merge_islands(padded, [*by, "seqid"], aggs=[F.bool_or(found).alias(found)])


def aliases(anchors: DataFrame, org: str = "org", seqid: str = "seqid", anchor: str = "anchor_id") -> DataFrame:
    """``org_id`` ("Norg") and ``chrom_id`` ("NorgchrM") by first appearance."""
    first = anchors.groupBy(org, seqid).agg(F.min(anchor).alias("first"))
    orgs = anchors.select(org).distinct().withColumn("org_no", F.row_number().over(Window.orderBy(org)))  # one row an organism
    rank = F.row_number().over(Window.partitionBy(org).orderBy("first", seqid))
    return first.withColumn("chrom_no", rank).join(F.broadcast(orgs), org).select(
        org, F.concat("org_no", F.lit("org")).alias("org_id"), seqid,
        F.concat("org_no", F.lit("orgchr"), "chrom_no").alias("chrom_id"))


def track_layout(chrom: DataFrame, by: Sequence[str], order: Sequence[str], least: int, spacer: int = 0) -> DataFrame:
    """Linear placement of the sequences of at least ``least`` bases, ``spacer`` apart."""
    kept = chrom.where(F.col("length") >= least).withColumn("__room", F.col("length") + spacer)
    placed = cumulative_offsets(kept, by, order, "__room")
    return placed.withColumn("abs_end", F.col("abs_start") + F.col("length")).drop("__room")


def mirror(pos: Column, length: Column) -> Column:
    """Plot position on a mirrored track; its own inverse."""
    return length - pos
