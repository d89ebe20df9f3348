"""Unified diffs without context lines, as changed line ranges and the symbols they touch."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.operators.joins import overlap_join

CHANGED_MAX = 50
WHOLE = 2**31 - 1


def parse(lines: DataFrame) -> DataFrame:
    """``path, first, last`` from ``diff_id, line_no, line``: each diff's target path is carried down to its hunks."""
    head = F.when(F.col("line").startswith("+++ b/"), F.substring("line", 7, 1 << 30)).when(F.col("line").startswith("+++ "), F.lit(""))
    w = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("path", F.last(head, ignorenulls=True).over(w))
    hunk = r"^@@ [^+]*\+(\d+)(?:,(\d+))? @@"
    rows = rows.filter(F.col("line").rlike(hunk) & (F.coalesce("path", F.lit("")) != ""))
    start, count = F.regexp_extract("line", hunk, 1).cast("int"), F.regexp_extract("line", hunk, 2)
    count = F.when(count == "", 1).otherwise(count.cast("int"))
    first = F.greatest(start, F.lit(1))
    last = F.when(count == 0, first).otherwise(F.greatest(start + count - 1, F.lit(1)))
    return rows.select("diff_id", "path", first.alias("first"), last.alias("last"))


def from_git(spark: SparkSession, root: str, base: str = "HEAD") -> DataFrame:
    """Ranges of a work tree against ``base``; an untracked file counts as a whole."""

    def git(*args: str) -> list[str]:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout.split("\n")

    lines = git("diff", "--unified=0", base)
    rows = parse(spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "diff_id int, line_no int, line string")).drop("diff_id")
    new = [(p, 1, WHOLE) for p in git("ls-files", "--others", "--exclude-standard") if p]
    return rows.unionByName(spark.createDataFrame(new, "path string, first int, last int"))


def changed(ranges: DataFrame, symbols: DataFrame, refs: DataFrame, most: int = CHANGED_MAX) -> tuple[DataFrame, DataFrame]:
    """Symbols that a range touches with their referring files, and files touched outside any symbol."""
    hit = overlap_join(ranges, symbols, ["path"], ("first", "last"), ("line_start", "line_end")).select(*symbols.columns).distinct()
    users = refs.select("name", F.col("path").alias("by")).distinct()
    found = hit.join(users, (hit["name"] == users["name"]) & (hit["path"] != users["by"]), "left").groupBy(*[hit[c] for c in symbols.columns]).agg(F.array_sort(F.collect_set("by")).alias("referrers"))
    outside = ranges.select("path").distinct().join(hit.select("path"), "path", "left_anti")
    return found.orderBy("path", "line_start", "name").limit(most), outside
