"""Integrity checks: each returns its offending rows with ``check``, ``severity`` and ``detail``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import overlapping_neighbours
from .matching import FULL, PAIR, correspondence, not_reciprocated


def _found(df: DataFrame, check: str, severity: str, detail: Column | str) -> DataFrame:
    d = F.col(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), d.cast("string").alias("detail"))


def _id(*cols: str) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in cols])


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _found(correspondence(a, b, keys), "same_keys", "error", _id("side", *keys))


def candidate_checks(cand: DataFrame, chrom: DataFrame) -> DataFrame:
    """End before start, outside the genome, across sequences, overlapping; ``cand(org, anchor_id, seqid, start, end)``."""
    ends = chrom.select("org", "seqid", "length")
    joined = cand.join(ends, ["org", "seqid"], "left")
    parts = [
        _found(cand.where(F.col("end") < F.col("start")), "end_before_start", "error", _id("org", "anchor_id")),
        _found(joined.where("length is null"), "unknown_sequence", "error", _id("org", "anchor_id")),
        _found(joined.where((F.col("start") < 0) | (F.col("end") > F.col("length"))), "outside_genome", "error", _id("org", "anchor_id")),
        _found(overlapping_neighbours(cand, ["org", "seqid"]), "overlap", "error", _id("org", "anchor_id")),
        _found(chrom.select("org").distinct().join(cand, "org", "left_anti"), "no_candidates", "warning", "org"),
    ]
    return reduce(DataFrame.unionByName, parts)


def considered_twice(matches: DataFrame) -> DataFrame:
    both = matches.groupBy(*FULL).agg(
        F.bool_or(F.col("kind") == "not_considered").alias("no"), F.bool_or(F.col("kind") != "not_considered").alias("yes")).where("no and yes")
    return _found(both, "considered_twice", "error", _id(*FULL))


def unreciprocated(matches: DataFrame) -> DataFrame:
    """Matches that don't point back: a warning for dups that aren't syntenic, else an error."""
    bad = not_reciprocated(matches.where("kind <> 'not_considered'"))
    weak = (F.col("kind") == "dup") & ~F.coalesce("syntenic", F.lit(False))
    return bad.select(F.lit("unreciprocated").alias("check"), F.when(weak, "warning").otherwise("error").alias("severity"), _id(*FULL).alias("detail"))


def unequal_scores(matches: DataFrame) -> DataFrame:
    """Scores (banker's rounding) or coordinates that the two directions of a match don't share."""
    back = matches.select(F.col("org2").alias("org1"), F.col("id2").alias("id1"), F.col("org1").alias("org2"), F.col("id1").alias("id2"),
                          F.col("score").alias("b_score"), F.col("own_start").alias("b_own"), F.col("other_start").alias("b_other"))
    m = matches.join(back, FULL).where("org1 < org2")
    odd = (F.bround("score") != F.bround("b_score")) | (F.col("own_start") != F.col("b_other")) | (F.col("other_start") != F.col("b_own"))
    return _found(m.where(odd), "unequal_directions", "error", _id(*FULL))


def asymmetric_flags(flags: DataFrame, matches: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pairs of which one side carries a flag that the other doesn't."""
    back = flags.select(F.col("org1").alias("org2"), F.col("id1").alias("id2"), F.col("org2").alias("org1"), *[F.col(n).alias(f"b_{n}") for n in names])
    m = matches.join(flags, PAIR).join(back, ["org1", "org2", "id2"])
    return reduce(DataFrame.unionByName, [
        _found(m.where(F.col(n) != F.col(f"b_{n}")), f"asymmetric_{n}", "warning", _id(*FULL)) for n in names])


def subset(inner: DataFrame, outer: DataFrame, keys: Sequence[str], check: str = "not_a_candidate") -> DataFrame:
    return _found(inner.select(*keys).distinct().join(outer, list(keys), "left_anti"), check, "error", _id(*keys))


def format_problems(df: DataFrame, expected: dict[str, str], predicates: Sequence[tuple[str, Column]], key: Sequence[str]) -> DataFrame:
    """Missing, unexpected or mistyped columns, and rows that fail a named predicate."""
    have = dict(df.dtypes)
    notes = [f"missing {c}" for c in expected if c not in have] + [f"unexpected {c}" for c in have if c not in expected] + [
        f"{c} is {have[c]}, not {t}" for c, t in expected.items() if c in have and have[c] != t]
    found = df.sparkSession.createDataFrame([("schema", "error", n) for n in notes], "check string, severity string, detail string")
    for name, ok in predicates:
        found = found.unionByName(_found(df.where(~F.coalesce(ok, F.lit(False))), name, "error", _id(*key)))
    return found


def repeated_ids(genes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _found(genes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "repeated_id", "error", _id(*keys, "n"))


def in_several(members: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    many = members.groupBy(*keys).agg(F.countDistinct(group).alias("n")).where("n > 1")
    return _found(many, "in_several_groups", "info", _id(*keys, "n"))


def accounting(**tables: DataFrame) -> DataFrame:
    """One row: the count of each named table, the sum of all but ``total`` and whether it equals ``total``."""
    counts = reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, t in tables.items()])
    wide = counts.groupBy().pivot("k", list(tables)).agg(F.first("n"))
    parts = reduce(Column.__add__, [F.col(k) for k in tables if k != "total"])
    return wide.withColumn("accounted", parts).withColumn("ok", F.col("accounted") == F.col("total"))


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of two independent derivations that don't agree, with ``side``."""
    return expected.exceptAll(actual).withColumn("side", F.lit("expected")).unionByName(
        actual.exceptAll(expected).withColumn("side", F.lit("actual")))


def drop_reasons(matches: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(reason, n)``: why matches of all kinds aren't among the ``chosen`` ones of their pair."""
    kept = chosen.select(*FULL, F.lit(True).alias("__kept"))
    reason = (
        F.when(F.col("__kept"), "kept").when(F.col("kind") == "not_considered", "not considered")
        .when((F.col("kind") == "dup") & ~F.coalesce("syntenic", F.lit(False)), "duplication without synteny")
        .otherwise("another match of the pair was chosen"))
    return matches.join(kept, FULL, "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def confirmation_counts(hits: DataFrame) -> DataFrame:
    """``hits(forward boolean, backward boolean, overlap)`` -> counts by which directions confirm, with overlap statistics."""
    kind = F.when(F.col("forward") & F.col("backward"), "both").when(F.col("forward") | F.col("backward"), "one").otherwise("neither")
    return hits.groupBy(kind.alias("confirmed")).agg(
        F.count("*").alias("n"), F.min("overlap").alias("least"), F.median("overlap").alias("median"), F.max("overlap").alias("most"))


def file_states(files: DataFrame, expected: DataFrame) -> DataFrame:
    """``files(path, length, head binary)`` against ``expected(path, kind)``: PASS, FAIL, MISSING or UNKNOWN.

    fasta begins with ">", uint16 has an even length, any other kind must not be empty.
    """
    j = expected.join(files, "path", "left")
    head = F.substring(F.col("head").cast("string"), 1, 1)
    ok = (
        F.when(F.col("kind") == "fasta", head == ">").when(F.col("kind") == "uint16", (F.col("length") % 2 == 0) & (F.col("length") > 0))
        .when(F.col("kind").isin("text", "parquet"), F.col("length") > 0))
    return j.select("path", "kind", F.when(F.col("length").isNull(), "MISSING").when(ok.isNull(), "UNKNOWN").when(ok, "PASS").otherwise("FAIL").alias("state"))


def fail_on_errors(found: DataFrame) -> DataFrame:
    """Raises if any row is an error, naming the first few; else gives the rows back."""
    errors = found.where("severity = 'error'").limit(5).collect()
    if errors:
        raise ValueError("; ".join(f"{r.check}: {r.detail}" for r in errors))
    return found
