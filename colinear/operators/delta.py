"""Incremental runs: deletions become tombstones that partners apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import PAIR


def tombstones(deleted: DataFrame, matches: DataFrame) -> DataFrame:
    """``deleted(org, id)`` and all kinds of matches -> ``(dst_org, dst_id, src_org, src_id)``."""
    d = deleted.select(F.col("org").alias("org1"), F.col("id").alias("id1")).distinct()
    return matches.join(d, ["org1", "id1"], "left_semi").select(
        F.col("org2").alias("dst_org"), F.col("id2").alias("dst_id"), F.col("org1").alias("src_org"), F.col("id1").alias("src_id")).distinct()


def apply_tombstones(matches: DataFrame, stones: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Matches without those that point at a deleted anchor, nor those of one."""
    gone = stones.select(F.col("dst_org").alias("org1"), F.col("dst_id").alias("id1"), F.col("src_org").alias("org2"), F.col("src_id").alias("id2"))
    left = matches.join(gone, ["org1", "id1", "org2", "id2"], "left_anti")
    if deleted is not None:
        left = left.join(deleted.select(F.col("org").alias("org1"), F.col("id").alias("id1")), ["org1", "id1"], "left_anti")
    return left


def to_reevaluate(stones: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pairs ``(org1, id1, org2)`` that lost a match and got no new result."""
    touched = stones.select(F.col("dst_org").alias("org1"), F.col("dst_id").alias("id1"), F.col("src_org").alias("org2")).distinct()
    return touched.join(fresh.select(*PAIR).distinct(), PAIR, "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changes between two snapshots: ``change`` is insert, delete or update, with the new values."""
    rest = [c for c in new.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("__o"))
    n = new.select(*keys, F.struct(*rest).alias("__n"))
    j = o.join(n, keys, "full_outer")
    change = F.when(F.col("__o").isNull(), "insert").when(F.col("__n").isNull(), "delete").when(~F.col("__o").eqNullSafe(F.col("__n")), "update")
    return j.withColumn("change", change).where("change is not null").select(
        *keys, "change", *[F.col(f"__n.{c}").alias(c) for c in rest])


def self_score_missing(candidates: DataFrame, hits: DataFrame, factor: float = 2.0) -> DataFrame:
    """Candidates not found in their own genome get the score 2 x length."""
    return candidates.join(hits.select("org", "anchor_id").distinct(), ["org", "anchor_id"], "left_anti").withColumn(
        "score", factor * (F.col("end") - F.col("start")))


# -- failed tasks -----------------------------------------------------------------------------

#: Return codes of the alignment and the chaining tool that mean a lack of memory, and the code of a time-out (fixed values).
MEMORY_CODES = {"alignment": (3, 4), "chaining": (255,)}
TIMEOUT_CODE = -99


def outcome(tool: Column, code: Column) -> Column:
    """``ok``, ``timeout``, ``memory``, ``killed`` (by a signal) or ``fatal``: all but the first and the last are worth a retry."""
    memory = F.lit(False)
    for name, codes in MEMORY_CODES.items():
        memory = memory | ((tool == name) & code.isin(*codes))
    return (
        F.when(code == 0, "ok").when(code == TIMEOUT_CODE, "timeout").when(memory, "memory").when(code < 0, "killed").otherwise("fatal"))


def retry_chunks(tasks: DataFrame, own_parts: int = 100) -> DataFrame:
    """Chunks for the retryable of ``tasks(task_id, n, self_alignment, tool, code)``: ``(task_id, chunk, first, last)``.

    A self alignment of n sequences is cut into chunks of n / ``own_parts`` (at least 1), a pairwise one into single sequences.
    """
    again = tasks.where(outcome(F.col("tool"), F.col("code")).isin("timeout", "memory", "killed") & (F.col("n") > 0))
    size = F.when(F.col("self_alignment"), F.greatest(F.floor(F.col("n") / own_parts), F.lit(1))).otherwise(1).cast("long")
    cut = again.withColumn("__size", size).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("__size")))))
    first = F.col("chunk") * F.col("__size")
    return cut.select("task_id", "chunk", first.alias("first"), (F.least(first + F.col("__size"), F.col("n")) - 1).alias("last"))


def replace_by_windows(parents: DataFrame, windows: DataFrame) -> DataFrame:
    """Parents ``(org, start, end, ok)`` after their retry as ``windows(org, parent_start, start, end, ok)``.

    A parent that succeeded stays.  One that didn't is replaced by those of its windows that did, in both strands alike, and stays
    with ``status`` failed if none did.  ``(org, start, end, status)``.
    """
    done = windows.where("ok").select("org", "parent_start", F.col("start").alias("w0"), F.col("end").alias("w1"))
    j = parents.withColumn("parent_start", F.col("start")).join(done, ["org", "parent_start"], "left")
    kept = j.where("ok").select("org", "start", "end", F.lit("kept").alias("status")).distinct()
    cut = j.where("not ok and w0 is not null").select("org", F.col("w0").alias("start"), F.col("w1").alias("end"), F.lit("window").alias("status"))
    lost = j.where("not ok and w0 is null").select("org", "start", "end", F.lit("failed").alias("status"))
    return kept.unionByName(cut).unionByName(lost)
