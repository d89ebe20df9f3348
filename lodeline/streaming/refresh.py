"""Change-driven refresh: file events in micro-batches, each applied once, and the feed of recorded answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES_PER_BATCH = 200


def file_stream(spark: SparkSession, place: str, per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """New files under ``place`` as a stream; a batch is bounded, the rest is the next one's."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(place)


def applied_once(apply: Callable[[DataFrame, int], None], ledger: str) -> Callable[[DataFrame, int], None]:
    """``apply`` guarded by a ledger of batch ids: a batch that is replayed after a failure is not applied again.

    ``apply`` writes to a place named by the batch id, so a half-written batch is overwritten by its replay.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = f"{ledger}/batch={batch_id}"
        fs = spark._jvm.org.apache.hadoop.fs.Path(path)
        if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
            return
        apply(batch, batch_id)
        spark.createDataFrame([(batch_id,)], "batch_id long").write.mode("overwrite").parquet(path)

    return run


def drain(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, ledger: str) -> StreamingQuery:
    """Work off all that is there in bounded batches, then stop."""
    return stream.writeStream.foreachBatch(applied_once(apply, ledger)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, ledger: str, every: str = "2 seconds") -> StreamingQuery:
    return stream.writeStream.foreachBatch(applied_once(apply, ledger)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def change_feed(spark: SparkSession, retrievals: str, notify: Callable[[int], None], checkpoint: str) -> StreamingQuery:
    """Tell the greatest id of newly recorded answers; rows stay where they are."""
    stream = spark.readStream.schema("id long, created_at_ms long").parquet(retrievals)

    def tell(batch: DataFrame, batch_id: int) -> None:
        most = batch.agg(F.max("id").alias("id")).first().id
        if most is not None:
            notify(most)

    return stream.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Native extra: events per user and session of a stream, rows later than ``late`` left out."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
