"""The library's inputs made from the generic test tables.

Sequence = user_id, position = seconds of ``events.ts``; interval = [pos, pos + floor(100 * value)]
with ``value`` as its score; scored hit = lineitem (part, supplier).  ``SQL_*`` say the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL_EVENTS = (
    "SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS start, "
    "CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(100 * value) AS BIGINT) AS \"end\" FROM events"
)
SQL_PAIRS = (
    "SELECT l_partkey AS part, l_suppkey AS supp, CAST(sum(l_quantity) AS DOUBLE) AS score, count(*) AS n "
    "FROM lineitem GROUP BY l_partkey, l_suppkey"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", pos.alias("start"),
        (pos + F.floor(F.lit(100) * F.col("value"))).alias("end"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, supplier) pairs with their summed quantity as score."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")
    ).agg(F.sum("l_quantity").alias("score"), F.count("*").alias("n"))
