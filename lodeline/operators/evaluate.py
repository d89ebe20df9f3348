"""Evaluation: recall and precision against gold, graded walks, condition statistics, paired differences, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.operators.graph import hops

Z = 1.96
TOLERANCE = 0.10
MIN_PAIRS = 2
NOTHING = 1e-9


def recall(served: Column, gold: Column, failed: Column | None = None) -> Column:
    """Share of gold served; 1 without gold, 0 for a failed run."""
    value = F.when(F.size(gold) == 0, 1.0).otherwise(F.size(F.array_intersect(gold, served)) / F.size(F.array_distinct(gold)))
    return value if failed is None else F.when(failed, 0.0).otherwise(value)


def precision(answer: Column, gold: Column) -> Column:
    return F.when(F.size(answer) == 0, 0.0).otherwise(F.size(F.array_intersect(answer, gold)) / F.size(F.array_distinct(answer)))


def graded(rows: DataFrame, answer: str = "answer", gold: str = "gold") -> DataFrame:
    """``rows`` with hit, miss, recall and precision."""
    a, g = F.col(answer), F.col(gold)
    return rows.withColumn("hit", F.array_sort(F.array_intersect(g, a))).withColumn("miss", F.array_sort(F.array_except(g, a))).withColumn("recall", recall(a, g)).withColumn("precision", precision(a, g))


def passes_any(served: Column, gold: Column) -> Column:
    return F.arrays_overlap(served, gold)


def passes_all(served: Column, gold: Column) -> Column:
    return F.size(F.array_except(gold, served)) == 0


def process_passes(steps: DataFrame, role: str | None, text: str | None, linked: str | None, gold: list[str]) -> DataFrame:
    """``process_id, passed``: one process must cite gold and meet every given condition, each by some of its steps."""
    met = [F.bool_or(F.col("section").isin(*gold)) if gold else F.lit(True)]
    if role is not None:
        met.append(F.bool_or(F.lower("role") == role.lower()))
    if text is not None:
        met.append(F.bool_or(F.lower("text").contains(text.lower())))
    if linked is not None:
        met.append(F.bool_or(F.array_contains("implemented_by", linked)))
    every = met[0]
    for m in met[1:]:
        every = every & m
    return steps.groupBy("process_id").agg(F.coalesce(every, F.lit(False)).alias("passed"))


def walk_totals(walks: DataFrame) -> DataFrame:
    """Passed and all walks by kind, and over all (kind null)."""
    return walks.rollup("kind").agg(F.count_if("passed").alias("passed"), F.count("*").alias("walks"))


def condition_stats(rows: DataFrame, condition: str, value: str, cost: str, failed: str) -> DataFrame:
    """Per condition: count, failures, sum, mean, exact median of ``value`` and total cost."""
    return rows.groupBy(condition).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("failed"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.sum(cost).alias("cost"),
    )


def paired(baseline: DataFrame, condition: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One row: pairs, mean difference and its 95 % interval. The first of each side's repeats counts; odd ones drop."""

    def first(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.min_by(value, order).alias(name))

    diff = first(baseline, "_a").join(first(condition, "_b"), keys).select((F.col("_b") - F.col("_a")).alias("d"))
    half = Z * F.stddev_samp("d") / F.sqrt(F.count("d"))
    enough = F.count("d") >= MIN_PAIRS
    return diff.agg(F.count("d").alias("pairs"), F.when(enough, F.avg("d")).alias("mean"), F.when(enough, F.avg("d") - half).alias("low"), F.when(enough, F.avg("d") + half).alias("high"))


def verdict(recall_low: Column, calls_high: Column, cost_baseline: Column, cost_condition: Column) -> Column:
    """Better recall or fewer calls for sure, at a mean cost of at most a tenth more; null without intervals."""
    better = (recall_low > NOTHING) | (calls_high < -NOTHING)
    cheap = cost_condition <= cost_baseline * (1 + TOLERANCE)
    return F.when(recall_low.isNull() | calls_high.isNull(), F.lit(None)).when(better & cheap, "passes").otherwise("fails")


def pivoted(records: DataFrame, row: str, condition: str, value: str, conditions: list[str]) -> DataFrame:
    """Mean of ``value`` by row and condition, a column each."""
    return records.groupBy(row).pivot(condition, conditions).agg(F.avg(value))


def session_groups(rows: DataFrame, key: str) -> DataFrame:
    """Counts of served and cut rows for each recorded answer."""
    return rows.groupBy(key).agg(F.count_if("served").alias("served"), F.count_if(~F.col("served")).alias("cut"))


def keyset_page(rows: DataFrame, id_: str, before: int | None, limit: int) -> DataFrame:
    """The ``limit`` newest rows before an id; all newest without one."""
    rows = rows if before is None else rows.filter(F.col(id_) < before)
    return rows.orderBy(F.desc(id_)).limit(limit)


def first_of(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row per key in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


# --- walks and sessions


def walk_budget(walk: Column, flag: int | None, file: int | None, default: int = 1024, least: int = 64, most: int = 8192) -> Column:
    """A walk's own budget, else the caller's, else the file's, else the default; clamped."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(walk, F.lit(flag), F.lit(file), F.lit(default)))).cast("int")


def connection_keys(relations: DataFrame, mentions: DataFrame, sections: DataFrame, start, most: int) -> DataFrame:
    """``key`` (path::name) of the sections that mention an entity within ``most`` relations of ``start``."""
    near = hops(relations.select(F.col("src_entity").alias("src"), F.col("dst_entity").alias("dst")), start, most)
    met = mentions.join(near.select(F.col("node").alias("entity_id")), "entity_id", "left_semi").select("section").distinct()
    return sections.join(met, "section", "left_semi").select(F.concat_ws("::", "path", "name").alias("key")).distinct()


def session_records(sessions: DataFrame, questions: DataFrame) -> DataFrame:
    """Scored sessions: why each failed, hit, miss, recall and precision of its answer, denials by hooks and others.

    ``sessions``: question, condition, repeat, spawn_error, is_error, outcome (null without a result line), structured
    (whether the result holds structured output), answer (null if malformed), denials (array of tool, by_hook);
    ``questions``: question, gold. A failed session answers nothing.
    """
    reason = (
        F.when(F.col("spawn_error").isNotNull(), F.col("spawn_error")).when(F.col("outcome").isNull(), "no result line").when(F.col("is_error"), "result reported an error")
        .when(F.col("outcome") != "success", F.concat(F.lit("result subtype "), F.col("outcome"))).when(~F.col("structured"), "no structured output").when(F.col("answer").isNull(), "malformed structured output")
    )
    rows = sessions.join(questions.select("question", "gold"), "question").withColumn("reason", reason).withColumn("failed", F.col("reason").isNotNull())
    rows = rows.withColumn("answer", F.when(F.col("failed"), F.array().cast("array<string>")).otherwise(F.col("answer")))
    hook, other = F.filter("denials", lambda x: x["by_hook"]), F.filter("denials", lambda x: ~x["by_hook"])
    rows = rows.withColumn("hook_denials", F.size(hook)).withColumn("denied", F.array_distinct(F.transform(other, lambda x: x["tool"])))
    rows = graded(rows).withColumn("recall", recall(F.col("answer"), F.col("gold"), F.col("failed")))
    return rows.drop("denials", "structured", "is_error", "spawn_error")


def run_summary(records: DataFrame, conditions: list[str]) -> DataFrame:
    """Mean recall of every question by condition, and of all (question null)."""
    wide = pivoted(records, "question", "condition", "recall", conditions)
    whole = records.withColumn("question", F.lit(None).cast("string")).groupBy("question").pivot("condition", conditions).agg(F.avg("recall"))
    return wide.unionByName(whole)


def category_recall(results: DataFrame) -> DataFrame:
    """Mean recall, whole answers and questions by category, and of all (category null)."""
    return results.rollup("category").agg(F.avg("recall").alias("recall"), F.count_if(F.col("recall") >= 1).alias("cited"), F.count("*").alias("questions"))
