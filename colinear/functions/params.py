"""Parameter tables: defaults, reading rules and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULTS
from .sequences import auto_k


def default_parameters(genomes: DataFrame, kind: str) -> DataFrame:
    """One row an organism of ``genomes(org, size)``: kind is kmer, complexity or dups."""
    d = lambda k: F.lit(DEFAULTS[k])
    if kind == "kmer":
        cols = {"k": auto_k(F.col("size")), "e": d("kmer_e"), "window": d("kmer_window"), "pitch": d("kmer_pitch"), "percentile": d("kmer_percent"), "flag": F.lit(0)}
    elif kind == "complexity":
        cols = {"window": d("complexity_window"), "pitch": d("complexity_pitch"), "percentile": d("complexity_percent"), "flag": F.lit(0)}
    else:
        cols = {k: d(f"dup_{k}") for k in ("k1", "e1", "k2", "e2", "window", "pitch", "x1", "y1", "x2", "y2")} | {"flag": F.lit(0)}
    return genomes.select("org", *[v.alias(k) for k, v in cols.items()])


def parameter_problems(params: DataFrame, known: DataFrame) -> DataFrame:
    """``(org, severity, problem)`` of a parameter table of any kind.

    Errors: sizes that aren't positive, a pitch not below its window, a window shorter than k, percentages outside 0..100,
    mismatches outside 0..4, flags other than 0 and 1, organisms named twice.  Warnings: organisms that aren't ``known``, and known
    ones without parameters.
    """
    have = set(params.columns)
    checks = [("pitch not below window", F.col("pitch") >= F.col("window"))]
    checks += [(f"{c} not positive", F.col(c) <= 0) for c in ("window", "pitch", "k", "k1", "k2") if c in have]
    checks += [(f"window shorter than {c}", F.col("window") < F.col(c)) for c in ("k", "k1", "k2") if c in have]
    checks += [(f"{c} not within 0..100", ~F.col(c).between(0, 100)) for c in ("percentile", "y1", "y2") if c in have]
    checks += [(f"{c} not within 0..4", ~F.col(c).between(0, 4)) for c in ("e", "e1", "e2") if c in have]
    checks += [("flag not 0 or 1", ~F.col("flag").isin(0, 1))] if "flag" in have else []
    found = [params.where(cond).select("org", F.lit("error").alias("severity"), F.lit(name).alias("problem")) for name, cond in checks]
    note = lambda df, severity, problem: df.select("org", F.lit(severity).alias("severity"), F.lit(problem).alias("problem"))
    orgs = known.select("org").distinct()
    found += [
        note(params.groupBy("org").count().where("count > 1"), "error", "repeated organism"),
        note(params.join(orgs, "org", "left_anti"), "warning", "unknown organism"), note(orgs.join(params, "org", "left_anti"), "warning", "no parameters")]
    return reduce(DataFrame.unionByName, found)
