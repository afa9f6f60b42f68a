"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, stored

__all__ = ["SPACE_WORD", "UPPER", "ascii_lower", "null_safe", "partitions", "shared_dir", "small", "spread_join",
           "stored", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII texts take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


#: Bytes of a side up to which it is broadcast.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, rows: int, row_bytes: int, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` of ``row_bytes`` each stay within ``limit`` bytes."""
    return F.broadcast(df) if rows * (row_bytes + 16) <= (BROADCAST_BYTES if limit is None else limit) else df


def spread_join(left: DataFrame, right: DataFrame, on: list[str], rows: int, row_bytes: int, how: str = "inner",
                limit: int | None = None, salt: list[str] | None = None, salts: int = 8) -> DataFrame:
    """Join on ``on`` where ``left`` may have hot keys: ``right`` (``rows`` counted) is broadcast if small.

    Else the rows of ``left`` are salted by the columns ``salt`` (all, if none are named) and ``right`` is there
    once for each salt.
    """
    hinted = small(right, rows, row_bytes, limit)
    if hinted is not right:
        return left.join(hinted, on, how)
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = left.withColumn("__salt", F.pmod(F.xxhash64(*(salt or left.columns)), F.lit(salts)).cast("int"))
    return own.join(copies, [*on, "__salt"], how).drop("__salt")


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` where null equals null; keeps the left side's key columns."""
    other = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(other[f"__r_{k}"])
        cond = one if cond is None else cond & one
    return left.join(other, cond, how).drop(*[f"__r_{k}" for k in keys])
