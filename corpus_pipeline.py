"""A training corpus from raw documents, in five stages; each is written as Parquet and read again by the next.

1. quality classifier: documents that it rejects go
2. quality rules: documents that they reject go
3. MinHash near-dedup: one document of each group stays, the one with the smallest doc_id
4. benchmark decontamination: documents that hold a benchmark item go
5. mixing sources to target weights: how many words of each document left the mix takes

All stages but the last return the columns of their input, whatever their names. A document is a row: rows that share a
doc_id, or have none, are judged each like any other. Where ids are null or repeat, the third and fourth stage write
their input once with a number for each row; else the ids themselves are the numbers. Of a group the row with the
smallest doc_id stays, nulls last, among equals the first in the table as written. Ids that leave are broadcast only up to
BROADCAST_IDS, else joined by shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm import decontaminate, mixing, near_dup, quality_model, quality_rules
from lodeline.storage import settle, shared_dir, small

#: Ids of eight bytes; the bound is 16 MB.
BROADCAST_IDS = 2_000_000


def _numbered(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``), ``id``, ``text`` and ``rid``, a number that no other row has."""
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    doubted = rows.filter("id is null").limit(1).count() or rows.groupBy("id").count().filter("count > 1").limit(1).count()
    if not doubted:
        return rows.withColumn("rid", F.col("id"))
    return settle(rows.withColumn("rid", F.monotonically_increasing_id()), "numbered")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of ``rows`` whose ``rid`` is not in ``gone``."""
    gone = small(settle(gone.select("rid"), "gone"), BROADCAST_IDS)
    return rows.join(gone, "rid", "left_anti").select("row.*")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    groups = near_dup.near_duplicates(rows.select(F.col("rid").alias("doc_id"), "text")).select(F.col("doc_id").alias("rid"), "component_id")
    groups = settle(groups.join(rows.select("rid", "id"), "rid"), "groups")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
    kept = groups.groupBy("component_id").agg(first.alias("first")).select("first.rid")
    return _without(rows, groups.join(kept, "rid", "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    found = decontaminate.leaks(rows.select(F.col("rid").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, found.select(F.col("doc_id").alias("rid")).distinct())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix),
]

#: The classifier and the fingerprints are outside SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return docs
