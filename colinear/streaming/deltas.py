"""Change logs as streams: tombstones applied batch by batch, and windows along time.

The batch operators are the definition; a stream folds each micro-batch into stored state with
the same functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.delta import apply_tombstones


def merge_tombstones(stones: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None],
                     checkpoint: str) -> StreamingQuery:
    """Starts a query that applies each batch of tombstones to the match table.

    ``load`` gives the current table, ``save(df, batch)`` stores a new version; a batch that is
    run again after a failure gives the same version.
    """

    def batch(df: DataFrame, number: int) -> None:
        save(apply_tombstones(load(), df), number)

    return stones.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_scores(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Counts and summed value by window and type, late rows up to ``late`` included."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Sessions by gap: the streaming relative of merging islands."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), "user_id").agg(F.count("*").alias("n"))
