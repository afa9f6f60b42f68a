"""Seeded two-pass shuffle of records into shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, small, stored


def shard_of(key: Column, n_shards: int, seed: int = 7) -> Column:
    """Shard of ``key`` by highest random weight: one more shard takes rows only into itself."""
    weights = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(k)).alias("w"), F.lit(k).alias("k"))
               for k in range(n_shards)]
    return (weights[0] if n_shards == 1 else F.greatest(*weights))["k"]


def _fisher_yates(seed: int, slot: str):
    """Pass 2 over rows sorted by bucket and canonical order: a seeded permutation of each bucket."""

    def mix(table: pa.Table) -> Iterator[pa.RecordBatch]:
        shard, bucket, base = (table.column(c)[0].as_py() for c in ("__shard", "__bucket", "__base"))
        order = np.arange(len(table))
        draw = np.random.Generator(np.random.PCG64([seed, shard, bucket])).integers(
            0, np.arange(len(table), 0, -1))  # j_i in [0, n - i)
        for i, j in enumerate(draw.tolist()):  # swap the i-th last with one at or before it
            last = len(order) - 1 - i
            order[last], order[j] = order[j], order[last]
        out = table.drop_columns(["__shard", "__bucket", "__base", "__order"]).take(pa.array(order))
        yield from out.append_column(slot, pa.array(base + np.arange(len(order)), pa.int64())).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(b.schema.get_field_index("__shard")).to_numpy(zero_copy_only=False).astype(np.int64) << 32
            ids = ids | b.column(b.schema.get_field_index("__bucket")).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, z in zip(cuts, cuts[1:]):
                part = b.slice(a, z - a)
                if held and (held[0].column("__shard")[0], held[0].column("__bucket")[0]) != (
                        part.column("__shard")[0], part.column("__bucket")[0]):
                    yield from mix(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from mix(pa.Table.from_batches(held))

    return run


def shuffle_into_shards(rows: DataFrame, n_shards: int, key: str = "doc_id", content: str | None = "text",
                        seed: int = 7, bucket_bytes: int = 32 << 20, row_bytes: int = 32,
                        shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All ``rows`` with the int column ``shard`` and the long column ``slot`` (gapless from 0).

    Pass 1 scatters rows by seeded hashes: the key alone gives the shard (highest random
    weight), key and ``content`` together a bucket of about ``bucket_bytes``.  Pass 2 sorts each
    bucket canonically, so that reruns and lost tasks agree, and shuffles it by Fisher-Yates.
    Only counts, one row a bucket, are gathered besides.

    Null keys share one shard but spread over its buckets by content.  Repeated rows each have
    a slot of their own; rows equal in key and content that would fill a bucket by themselves are numbered
    and spread over several, so a bucket stays near its size.  Such rows may hold no map columns.  Columns named ``shard`` or ``slot`` are replaced.  ``content`` may be
    null, empty or absent (None).  An empty table gives no rows.
    """
    kept = rows.drop(shard, slot)
    texts = [f.name for f in kept.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    load = F.lit(row_bytes)
    for c in texts:
        load = load + F.coalesce(F.octet_length(c), F.lit(0))
    own = [key, content] if content else [key]
    order = F.xxhash64(*own, F.lit(seed))
    at = shard_of(F.col(key), n_shards, seed)
    narrow = stored(kept.select(at.alias("__shard"), order.alias("__order"), load.cast("long").alias("__load")), "narrow")
    total = narrow.agg(F.sum("__load")).first()[0] or 0
    n_buckets = max(1, -(-total // (n_shards * bucket_bytes)))
    bucket = lambda *parts: F.pmod(F.xxhash64(*parts, F.lit(seed + 1)), F.lit(n_buckets)).cast("int").alias("__bucket")
    tasks = partitions(rows.sparkSession)
    # rows equal in key and content that fill a bucket by themselves: at most one order a bucket's worth of bytes
    hot = stored(
        narrow.groupBy("__order").agg(F.sum("__load").alias("b"), F.count("*").alias("n")).where((F.col("b") > bucket_bytes) & (F.col("n") > 1))
        .select("__order", F.ceil(2 * F.col("b") / bucket_bytes).cast("int").alias("__pieces")), "hot")
    n_hot = hot.count()
    placed = kept.select(*kept.columns, at.alias("__shard"), order.alias("__order"))
    if n_hot:
        side = small(hot, n_hot, 16)
        # equal rows are summed where they are read and told apart again by a number of their own
        rows_ = placed.join(side, "__order").groupBy(*kept.columns, "__shard", "__order", "__pieces").agg(F.count("*").alias("__n"))
        chunk = 4096
        parts = rows_.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / chunk))))
        parts = parts.repartition(tasks, "__order", "__chunk", F.xxhash64(*kept.columns))
        each = parts.withColumn("__copy", F.explode(F.sequence(F.col("__chunk") * chunk, F.least((F.col("__chunk") + 1) * chunk, F.col("__n")) - 1)))
        piece = F.pmod(F.xxhash64(*kept.columns, "__copy"), F.col("__pieces"))
        split = stored(each.select(*kept.columns, "__shard", "__order", bucket("__order", piece)), "split")
        cool = narrow.join(side, "__order", "left_anti")
        counted = cool.select("__shard", bucket("__order")).unionAll(split.select("__shard", "__bucket"))
        placed = placed.join(side, "__order", "left_anti").select(*placed.columns, bucket("__order")).unionByName(split)
    else:
        counted = narrow.select("__shard", bucket("__order"))
        placed = placed.select(*placed.columns, bucket("__order"))
    counts = counted.groupBy("__shard", "__bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__shard", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    based = placed.join(small(bases, n_shards * n_buckets, 16), ["__shard", "__bucket"])
    mixed = based.repartition(tasks, "__shard", "__bucket").sortWithinPartitions(
        "__shard", "__bucket", "__order", *own)
    schema = T.StructType([*kept.schema.fields, T.StructField("__slot", T.LongType())])
    columns = [*kept.columns, "__shard", "__bucket", "__base", "__order"]
    out = mixed.select(*columns).mapInArrow(_fisher_yates(seed, "__slot"), schema)
    return out.select(
        *kept.columns, shard_of(F.col(key), n_shards, seed).alias(shard), F.col("__slot").alias(slot))


def write_shards(sharded: DataFrame, path: str, shard: str = "shard", slot: str = "slot",
                 records_per_file: int = 1_000_000) -> None:
    """Writes one folder a shard, its files in slot order, of at most ``records_per_file`` rows each."""
    part = F.floor(F.col(slot) / records_per_file)
    n = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        sharded.withColumn("__part", part).repartition(n, shard, "__part").sortWithinPartitions(shard, "__part", slot)
        .drop("__part").write.option("maxRecordsPerFile", records_per_file).partitionBy(shard).parquet(path)
    )
