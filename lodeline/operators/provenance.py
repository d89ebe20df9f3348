"""The record of every answer: a header row and the rows served, with the next ones cut and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.operators.rank import CUT_RECORDED

HEADER = "id long, session_key string, tool string, query string, focus_files array<string>, budget long, limit_n long, index_version string, git_head string, stale_count long, created_at_ms long"


def items(ranked: DataFrame, retrieval_id: int, served: int, cut: int = CUT_RECORDED) -> DataFrame:
    """The served rows of ``ranked`` (with rank) and the ``cut`` below them."""
    return ranked.filter(F.col("rank") <= served + cut).withColumn("retrieval_id", F.lit(retrieval_id).cast("long")).withColumn("served", F.col("rank") <= served)


def record(base: str, header: tuple, rows: DataFrame) -> None:
    """Append header and rows under one id, the header last: readers join on it, so half a record is never seen."""
    spark = rows.sparkSession
    rows.write.mode("append").parquet(f"{base}/retrieval_items")
    spark.createDataFrame([header], HEADER).write.mode("append").parquet(f"{base}/retrievals")


def next_id(retrievals: DataFrame) -> int:
    return retrievals.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).first().id + 1


def listed(retrievals: DataFrame, rows: DataFrame) -> DataFrame:
    """Headers with counts of served and cut rows."""
    counts = rows.groupBy(F.col("retrieval_id").alias("id")).agg(F.count_if("served").alias("served"), F.count_if(~F.col("served")).alias("cut"))
    return retrievals.join(counts, "id", "left").fillna(0, ["served", "cut"])
