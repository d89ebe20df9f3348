"""Tables written to the cluster's shared folder, to cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one part of a shuffle should hold, so that a task's memory does not grow with the input.
PART_ROWS = 500_000
#: Bytes of texts that one broadcast may hold.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset a session of one machine gets a temporary folder, as in
    tests; on a cluster its executors could not see it, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lodeline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back: lineage is cut, the files survive executors.

    The write is a job; a lost executor makes Spark redo only its tasks, and later readers depend on the files alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``keys`` over as many parts as keep one near PART_ROWS rows; as it is where
    the session's own number of shuffle partitions does."""
    parts = -(-rows // PART_ROWS)
    return df if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(parts, *keys)


def small(df: DataFrame, rows: int, weight: Column | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, which must be cheap to count; else as it is.

    ``weight``, the bytes of a row's columns of unknown width, adds a bound on their sum.
    """
    if df.limit(rows + 1).count() > rows:
        return df
    if weight is not None and (df.agg(F.sum(weight)).first()[0] or 0) > most:
        return df
    return F.broadcast(df)
