"""Tables written to the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a folder of the warehouse, or a temporary one in local mode.

    On a cluster a warehouse on a local disk is refused: executors don't share it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not local and (warehouse.startswith("file:") or "://" not in warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(
            tempfile.mkdtemp(prefix="colinear-") if local else f"{warehouse}/_checkpoints")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read back: cuts lineage, is computed once, survives lost executors.

    ``sweep`` deletes what was stored, when no frame that reads it is needed any more.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def sweep(spark: SparkSession) -> int:
    """Deletes the tables that ``stored`` wrote in this process; their number."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path, fs = _file_system(spark, _WRITTEN.pop())
        fs.delete(path, True)
    return n


def content_key(df: DataFrame, version: str = "") -> str:
    """Digest of what ``df`` computes and of the files it reads (name, length, time of change)."""
    spark = df.sparkSession
    parts = [version, df._jdf.queryExecution().analyzed().canonicalized().toString(), df.schema.simpleString()]
    for name in sorted(df.inputFiles()):
        path, fs = _file_system(spark, name)
        status = fs.getFileStatus(path)
        parts.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


def resumed(df: DataFrame, stage: str, folder: str | None = None, version: str = "", cache: bool = True) -> DataFrame:
    """A stage that is read back if an earlier run finished it on the same files by the same plan, else written.

    The table's name holds the ``content_key``, so changed inputs, plans or ``version`` make a new one; a run that
    was cut off left no mark of success and is written again.  ``cache=False`` always writes.  Plans that hold functions
    of one's own should change ``version`` with them.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/stages/{stage}-{content_key(df, version)}"
    mark, fs = _file_system(spark, f"{path}/_SUCCESS")
    if not (cache and fs.exists(mark)):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if counting shows at most ``limit`` rows; else unchanged."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
