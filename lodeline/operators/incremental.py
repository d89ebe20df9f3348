"""Incremental maintenance: scan differences, versions, upserts, removal, and the work queue's replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3
STALE_CLAIM_MS = 600_000
#: Hex digits of a path's digest that name its leaf of the version tree: 16^5 leaves, a thousand lines each for 10^9 files.
BUCKET_DIGITS = 5


def scan_changes(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """``path, change``: new, changed (time or size differ), unchanged, removed. Both: path, mtime_ms, size."""
    k, s = known.alias("k"), scanned.alias("s")
    both = s.join(k, F.col("s.path") == F.col("k.path"), "full_outer")
    same = F.col("s.mtime_ms").eqNullSafe(F.col("k.mtime_ms")) & F.col("s.size").eqNullSafe(F.col("k.size"))
    change = F.when(F.col("k.path").isNull(), "new").when(F.col("s.path").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.select(F.coalesce("s.path", "k.path").alias("path"), change.alias("change"))


def content_changes(known: DataFrame, scanned: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``path, change`` of rows that were read: touched (equal hash), forced (code indexed under another vocabulary),
    index. ``known``: path, content_hash, vocab; ``scanned``: path, content_hash, code (boolean)."""
    k = known.select("path", F.col("content_hash").alias("_h"), F.col("vocab").alias("_v"))
    rows = scanned.join(k, "path", "left")
    forced = F.lit(vocabulary is not None) & F.col("code") & ~F.col("_v").eqNullSafe(F.lit(vocabulary))
    return rows.select("path", F.when(~F.col("content_hash").eqNullSafe(F.col("_h")), "index").when(forced, "forced").otherwise("touched").alias("change"))


def index_version(files: DataFrame, path: str = "path", hash_: str = "content_hash") -> DataFrame:
    """One row, ``version``: twelve hex digits over all paths and hashes.

    A tree of digests: lines by the first BUCKET_DIGITS hex digits of their path's digest, those digests by one digit less,
    and so on. A level's buckets hold sixteen digests each, and a leaf's lines are joined by their own digests, so no task
    holds more than a leaf's; the number of leaves does not depend on the input, so equal files give equal versions.
    """
    line = F.concat(F.col(path), F.lit("\t"), F.coalesce(hash_, F.lit("")), F.lit("\n"))
    rows = files.select(F.left(F.sha2(F.col(path), 256), F.lit(BUCKET_DIGITS)).alias("bucket"), F.col(path).alias("p"), line.alias("l"))

    def joined(rows: DataFrame, key: Column, value: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col(value).alias("v"))))
        return rows.groupBy("bucket").agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["v"]), ""), 256).alias("l"))

    level = joined(rows, F.col("p"), "l")
    for digits in range(BUCKET_DIGITS - 1, -1, -1):
        level = joined(level.select(F.left("bucket", F.lit(digits)).alias("bucket"), F.col("bucket").alias("own"), "l"), F.col("own"), "l")
    return level.agg(F.left(F.coalesce(F.max("l"), F.sha2(F.lit(""), 256)), F.lit(12)).alias("version"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with rows of equal keys replaced."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those rows whose keys are new."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row per key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def without_removed(table: DataFrame, removed: DataFrame, key: str = "path") -> DataFrame:
    return table.join(removed.select(key), key, "left_anti")


#: Events of the queue's log: queued, requeued, claimed, released, extracted, has_process, stepped, failed, outage.
QUEUE_LOG = "seq long, symbol_id long, hash string, event string, error string, stamp string, at_ms long"


def claimable(queue: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """The oldest rows that are free or whose claim is stale, with attempts left."""
    free = F.col("claimed_at_ms").isNull() | (F.col("claimed_at_ms") < now_ms - STALE_CLAIM_MS)
    return queue.filter(free & (F.col("attempts") < MAX_ATTEMPTS)).orderBy("queued_at_ms", "symbol_id").limit(limit)


def events(rows: DataFrame, event: str, at_ms: int, error: str | None = None, stamp: str | None = None) -> DataFrame:
    """Log rows of one event for ``rows`` (symbol_id, hash). The log's order is by time, then symbol."""
    seq = F.lit(at_ms) * 1000 + F.pmod(F.xxhash64("symbol_id", F.lit(event)), F.lit(1000))
    return rows.select(seq.alias("seq"), "symbol_id", "hash", F.lit(event).alias("event"), F.lit(error).cast("string").alias("error"), F.lit(stamp).cast("string").alias("stamp"), F.lit(at_ms).cast("long").alias("at_ms"))


def to_queue(log: DataFrame, sections: DataFrame, now_ms: int) -> DataFrame:
    """Queueing events for sections (symbol_id, hash) whose text is new: never queued, or last queued with another hash."""
    last = log.filter(F.col("event").isin("queued", "requeued")).groupBy("symbol_id").agg(F.max_by("hash", "seq").alias("_last"))
    new = sections.select("symbol_id", "hash").join(last, "symbol_id", "left").filter(~F.col("hash").eqNullSafe(F.col("_last")))
    return events(new.dropDuplicates(["symbol_id"]), "queued", now_ms)


def claims(log: DataFrame) -> DataFrame:
    """The claim that holds each symbol: ``symbol_id, stamp, claimed_at_ms``.

    Of claims that were appended at the same time the first in (time, stamp) holds; a later one holds only if the holder's
    was stale by then or had ended. So a claimer reads back what it got and leaves the rest.
    """
    over = Window.partitionBy("symbol_id").orderBy("at_ms", F.when(F.col("event") == "claimed", 0).otherwise(1), "stamp")
    rows = log.withColumn("_ends", F.col("event").isin("queued", "requeued", "released", "extracted", "stepped", "has_process", "failed", "outage"))
    rows = rows.withColumn("_epoch", F.sum(F.col("_ends").cast("int")).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    epoch = F.coalesce(F.col("_epoch"), F.lit(0))
    last = rows.withColumn("_epoch", epoch).withColumn("_now", F.max(epoch + F.col("_ends").cast("int")).over(Window.partitionBy("symbol_id")))
    own = last.filter((F.col("event") == "claimed") & (F.col("_epoch") == F.col("_now")))
    step = F.aggregate(
        F.array_sort(F.collect_list(F.struct("at_ms", "stamp"))), F.struct(F.lit(None).cast("long").alias("at_ms"), F.lit(None).cast("string").alias("stamp")),
        lambda held, x: F.when(held["at_ms"].isNull() | (held["at_ms"] < x["at_ms"] - STALE_CLAIM_MS), x).otherwise(held),
    )
    return own.groupBy("symbol_id").agg(step.alias("h")).select("symbol_id", "h.stamp", F.col("h.at_ms").alias("claimed_at_ms"))


def queue_state(log: DataFrame) -> DataFrame:
    """What waits: ``replay_queue`` with hash, queued_at_ms and the claim that holds each row."""
    queued = log.filter(F.col("event").isin("queued", "requeued")).groupBy("symbol_id").agg(F.max_by("hash", "seq").alias("hash"), F.max("at_ms").alias("queued_at_ms"))
    return replay_queue(log).join(queued, "symbol_id").join(claims(log), "symbol_id", "left")


def replay_queue(log: DataFrame) -> DataFrame:
    """Final state of each symbol (symbol_id, stage, attempts, last_error) from its log (seq, symbol_id, hash, event, error).

    A requeue with another hash starts anew, what was done for an older hash counts for nothing. ``extracted`` ends the
    work or, with ``has_process``, leads to stage 1; ``stepped`` ends it; ``failed`` counts an attempt, ``outage`` none.
    """
    w = Window.partitionBy("symbol_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    queued = F.col("event").isin("queued", "requeued")
    rows = log.withColumn("_start", F.max(F.when(queued, F.col("seq"))).over(w))
    current = F.last(F.when(queued, F.col("hash")), ignorenulls=True).over(w)
    rows = rows.withColumn("_hash", current).filter((F.col("seq") >= F.col("_start")) & (F.col("hash") == F.col("_hash")))
    failed = F.col("event") == "failed"
    state = rows.groupBy("symbol_id").agg(
        F.max((F.col("event") == "has_process").cast("int")).alias("stage"),
        F.count_if(failed).cast("int").alias("attempts"),
        F.max_by("error", F.when(F.col("event").isin("failed", "outage"), F.col("seq"))).alias("last_error"),
        F.bool_or(F.col("event") == "stepped").alias("_stepped"), F.bool_or(F.col("event") == "extracted").alias("_extracted"),
    )
    done = F.col("_stepped") | (F.col("_extracted") & (F.col("stage") == 0))
    return state.filter(~done).drop("_stepped", "_extracted")
