"""Evaluation operators: labels as gold, sources and event types as conditions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeline.catalogue import query, table
from lodeline.operators import evaluate as E


def answers(spark, d):
    """Per source: gold are its good documents, the answer its longest ten."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    listed = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n_chars")).alias("k"), "doc_id"))), 1, 10)
    return docs.groupBy("source").agg(F.array_sort(F.collect_list(F.when((F.col("quality") == 1) & (F.col("n_chars") > 2000), F.col("doc_id")))).alias("gold"), F.transform(listed, lambda x: x["doc_id"]).alias("answer"))


ANSWERS = """
x AS (SELECT d.doc_id, d.source, d.n_chars, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS k FROM documents AS d LEFT JOIN labels AS l USING (doc_id)),
a AS (SELECT source, coalesce(list(doc_id ORDER BY doc_id) FILTER (WHERE quality = 1 AND n_chars > 2000), []) AS gold, list(doc_id) FILTER (WHERE k <= 10) AS answer FROM x GROUP BY source),
g AS (SELECT source, gold, answer, list_sort(list_intersect(gold, answer)) AS hit FROM a)"""


@query("q70_recall_precision", f"""
WITH {ANSWERS} SELECT source, hit, list_sort(list_filter(gold, lambda v: NOT list_contains(answer, v))) AS miss, round(CASE WHEN len(gold) = 0 THEN 1.0 ELSE len(hit)::DOUBLE / len(gold) END, 9) AS recall, round(len(hit)::DOUBLE / len(answer), 9) AS precision FROM g""")
def q70(spark, d):
    return E.graded(answers(spark, d)).select("source", "hit", "miss", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


@query("q71_walk_grading", f"""
WITH {ANSWERS}, w AS (SELECT CASE WHEN right(source, 1) IN ('1', '3', '5', '7', '9') THEN 'change' ELSE 'locate' END AS kind, CASE WHEN right(source, 1) IN ('1', '3', '5', '7', '9') THEN len(hit) = len(gold) ELSE len(hit) > 0 END AS passed FROM g)
SELECT kind, count(*) FILTER (WHERE passed) AS passed, count(*) AS walks FROM w GROUP BY ROLLUP (kind)""")
def q71(spark, d):
    odd = F.right(F.col("source"), F.lit(1)).isin("1", "3", "5", "7", "9")
    a, g = F.col("answer"), F.col("gold")
    walks = answers(spark, d).select(F.when(odd, "change").otherwise("locate").alias("kind"), F.when(odd, E.passes_all(a, g)).otherwise(E.passes_any(a, g)).alias("passed"))
    return E.walk_totals(walks)


@query("q72_condition_stats", """
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS failed, round(sum(value), 6) AS sum, round(avg(value), 9) AS mean, round(median(value), 9) AS median, sum(user_id)::BIGINT AS cost FROM events GROUP BY event_type""")
def q72(spark, d):
    rows = table(spark, d, "events").withColumn("failed_run", F.col("value") > 50)
    out = E.condition_stats(rows, "event_type", "value", "user_id", "failed_run")
    return out.select("event_type", "n", "failed", F.round("sum", 6).alias("sum"), F.round("mean", 9).alias("mean"), F.round("median", 9).alias("median"), "cost")


PAIRED = """
v AS (SELECT user_id, arg_min(value, event_id) AS a FROM events WHERE event_type = 'view' GROUP BY user_id), c AS (SELECT user_id, arg_min(value, event_id) AS b FROM events WHERE event_type = 'click' GROUP BY user_id),
df AS (SELECT b - a AS d FROM v JOIN c USING (user_id)),
s AS (SELECT count(*) AS pairs, avg(d) AS mean, avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)) AS low, avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)) AS high FROM df)"""


def paired(spark, d):
    rows = table(spark, d, "events")
    return E.paired(rows.filter("event_type = 'view'"), rows.filter("event_type = 'click'"), ["user_id"], "value", "event_id")


@query("q73_paired_difference", f"WITH {PAIRED} SELECT pairs, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high FROM s")
def q73(spark, d):
    return paired(spark, d).select("pairs", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query("q74_verdict", f"""
WITH {PAIRED}, k AS (SELECT avg(value) FILTER (WHERE event_type = 'view') AS cv, avg(value) FILTER (WHERE event_type = 'click') AS cc FROM events)
SELECT CASE WHEN (low > 1e-9 OR high < -1e-9) AND cc <= cv * 1.1 THEN 'passes' ELSE 'fails' END AS verdict FROM s CROSS JOIN k""")
def q74(spark, d):
    cost = table(spark, d, "events").agg(F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("cv"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("cc"))
    return paired(spark, d).crossJoin(F.broadcast(cost)).select(E.verdict(F.col("low"), F.col("high"), F.col("cv"), F.col("cc")).alias("verdict"))


@query("q75_transcript_pivot", """
SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS user, count(*) FILTER (WHERE role = 'assistant') AS assistant, count(*) FILTER (WHERE role = 'system') AS system, count(*) AS turns FROM conversations GROUP BY conv_id""")
def q75(spark, d):
    rows = table(spark, d, "conversations")
    wide = rows.groupBy("conv_id").pivot("role", ["user", "assistant", "system"]).agg(F.count(F.lit(1))).fillna(0)
    return wide.withColumn("turns", F.col("user") + F.col("assistant") + F.col("system"))


@query("q76_mean_by_condition", """
SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'view'), 9) AS view, round(avg(value) FILTER (WHERE event_type = 'click'), 9) AS click FROM events GROUP BY user_id""")
def q76(spark, d):
    wide = E.pivoted(table(spark, d, "events"), "user_id", "event_type", "value", ["view", "click"])
    return wide.select("user_id", F.round("view", 9).alias("view"), F.round("click", 9).alias("click"))


@query("q90_session_scores", f"""
WITH {ANSWERS}, k AS (SELECT source, gold, answer, row_number() OVER (ORDER BY source) AS n FROM a),
r AS (SELECT source, gold, CASE WHEN n % 5 = 1 THEN 'no result line' WHEN n % 5 = 2 THEN 'result subtype error_max_turns' WHEN n % 5 = 3 THEN 'no structured output' END AS reason, answer, n FROM k),
b AS (SELECT source, gold, reason, CASE WHEN reason IS NULL THEN answer ELSE [] END AS answer, n FROM r)
SELECT source AS question, reason, reason IS NOT NULL AS failed, len(list_intersect(gold, answer))::INT AS hits,
  round(CASE WHEN reason IS NOT NULL THEN 0.0 WHEN len(gold) = 0 THEN 1.0 ELSE len(list_intersect(gold, answer))::DOUBLE / len(gold) END, 9) AS recall,
  (n % 3)::INT AS hook_denials, CASE WHEN n % 2 = 0 THEN ['Bash'] ELSE [] END AS denied FROM b""")
def q90(spark, d):
    """Sources as questions of a run, whose sessions end in different ways."""
    rows = answers(spark, d).select(F.col("source").alias("question"), F.transform("gold", lambda x: x.cast("string")).alias("gold"), F.transform("answer", lambda x: x.cast("string")).alias("answer"))
    n = F.row_number().over(Window.orderBy("question"))  # a row per source
    rows = rows.withColumn("n", n)
    hook = F.array_repeat(F.struct(F.lit("Read").alias("tool"), F.lit(True).alias("by_hook")), (F.col("n") % 3).cast("int"))
    other = F.when(F.col("n") % 2 == 0, F.array_repeat(F.struct(F.lit("Bash").alias("tool"), F.lit(False).alias("by_hook")), 2)).otherwise(F.array_repeat(F.struct(F.lit("").alias("tool"), F.lit(False).alias("by_hook")), 0))
    runs = rows.select(
        "question", "answer", F.lit(None).cast("string").alias("spawn_error"), F.lit(False).alias("is_error"), F.when(F.col("n") % 5 == 2, "error_max_turns").when(F.col("n") % 5 != 1, "success").alias("outcome"),
        (F.col("n") % 5 != 3).alias("structured"), F.concat(hook, other).alias("denials"),
    )
    scored = E.session_records(runs, rows)
    return scored.select("question", "reason", "failed", F.size("hit").alias("hits"), F.round("recall", 9).alias("recall"), "hook_denials", "denied")


@query("q91_connection_walk", """
WITH RECURSIVE r AS (SELECT o_custkey AS a, o_custkey * 7 % 1499 AS b FROM orders), b2 AS (SELECT a, b FROM r UNION SELECT b, a FROM r),
w AS (SELECT 7::BIGINT AS node, 0 AS hops UNION SELECT b2.b, w.hops + 1 FROM w JOIN b2 ON b2.a = w.node WHERE w.hops < 3)
SELECT DISTINCT o_orderpriority || '::' || o_orderstatus AS key FROM orders WHERE o_custkey IN (SELECT node FROM w)""")
def q91(spark, d):
    orders = table(spark, d, "orders")
    relations = orders.select(F.col("o_custkey").alias("src_entity"), (F.col("o_custkey") * 7 % 1499).alias("dst_entity"))
    sections = orders.select(F.col("o_orderkey").alias("section"), F.col("o_orderpriority").alias("path"), F.col("o_orderstatus").alias("name"))
    return E.connection_keys(relations, orders.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("section")), sections, 7, 3)


@query("q92_category_recall", f"""
WITH {ANSWERS}, c AS (SELECT 'k' || right(source, 1) AS category, CASE WHEN len(gold) = 0 THEN 1.0 ELSE len(hit)::DOUBLE / len(gold) END AS recall FROM g)
SELECT category, round(avg(recall), 9) AS recall, count(*) FILTER (WHERE recall >= 1) AS cited, count(*) AS questions FROM c GROUP BY ROLLUP (category)""")
def q92(spark, d):
    rows = E.graded(answers(spark, d)).select(F.concat(F.lit("k"), F.right(F.col("source"), F.lit(1))).alias("category"), "recall")
    return E.category_recall(rows).withColumn("recall", F.round("recall", 9))
