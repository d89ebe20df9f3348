"""Logs: sessions, intervals, nearest rows, the queue's replay, and windows over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalogue import query, table
from lodeline.operators import evaluate as E
from lodeline.operators import incremental as I
from lodeline.operators import joins as J


@query("q80_sessions_page", """
SELECT user_id AS id, count(*) FILTER (WHERE event_type <> 'error') AS served, count(*) FILTER (WHERE event_type = 'error') AS cut FROM events WHERE user_id < 100 GROUP BY user_id ORDER BY user_id DESC LIMIT 20""")
def q80(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), (F.col("event_type") != "error").alias("served"))
    return E.keyset_page(E.session_groups(rows, "id"), "id", 100, 20)


@query("q81_interval_overlap", """
WITH h AS (SELECT event_id, user_id % 10 AS path, event_id % 5000 AS first, event_id % 5000 + user_id % 5 AS last FROM events WHERE event_type = 'click'),
s AS (SELECT o_orderkey, o_custkey % 10 AS path, o_orderkey % 5000 AS line_start, o_orderkey % 5000 + o_custkey % 7 AS line_end FROM orders WHERE o_orderstatus = 'F')
SELECT event_id, o_orderkey FROM h JOIN s ON h.path = s.path AND line_start <= last AND line_end >= first""")
def q81(spark, d):
    e, o = table(spark, d, "events").filter("event_type = 'click'"), table(spark, d, "orders").filter("o_orderstatus = 'F'")
    hunks = e.selectExpr("event_id", "user_id % 10 AS path", "event_id % 5000 AS first", "event_id % 5000 + user_id % 5 AS last")
    spans = o.selectExpr("o_orderkey", "o_custkey % 10 AS path", "o_orderkey % 5000 AS line_start", "o_orderkey % 5000 + o_custkey % 7 AS line_end")
    return J.overlap_join(hunks, spans, ["path"], ("first", "last"), ("line_start", "line_end"), width=64).select("event_id", "o_orderkey")


@query("q82_point_in_range", """
WITH s AS (SELECT o_orderkey, o_custkey % 10 AS path, o_orderkey % 5000 AS line_start, o_orderkey % 5000 + o_custkey % 7 AS line_end FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, count(*) AS n FROM events JOIN s ON user_id % 10 = path AND event_id % 5000 BETWEEN line_start AND line_end GROUP BY o_orderkey""")
def q82(spark, d):
    points = table(spark, d, "events").selectExpr("event_id", "user_id % 10 AS path", "event_id % 5000 AS line")
    spans = table(spark, d, "orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey", "o_custkey % 10 AS path", "o_orderkey % 5000 AS line_start", "o_orderkey % 5000 + o_custkey % 7 AS line_end")
    return J.point_join(points, spans, ["path"], "line", ("line_start", "line_end"), width=64).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("q83_asof", """
WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT c.event_id, c.user_id, v.view_id, v.ts AS view_ts FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def q83(spark, d):
    rows = table(spark, d, "events")
    views = rows.filter("event_type = 'view'").groupBy("user_id", F.col("ts").alias("view_ts")).agg(F.max("event_id").alias("view_id"))
    return J.asof_join(rows.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "view_ts", "view_id").select("event_id", "user_id", "view_id", "view_ts")


@query("q84_queue_replay", """
WITH l AS (SELECT event_id AS seq, user_id AS symbol_id, CASE event_type WHEN 'signup' THEN 'requeued' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'embedded' WHEN 'view' THEN 'has_process' ELSE 'extracted' END AS event, CASE WHEN event_type = 'error' THEN 'E' || (event_id % 5) END AS error FROM events),
s AS (SELECT symbol_id, max(seq) FILTER (WHERE event = 'requeued') AS st FROM l GROUP BY symbol_id), r AS (SELECT l.* FROM l JOIN s USING (symbol_id) WHERE seq >= st),
g AS (SELECT symbol_id, max(CASE WHEN event = 'has_process' THEN 1 ELSE 0 END)::INT AS stage, count(*) FILTER (WHERE event = 'failed')::INT AS attempts, arg_max(error, seq) FILTER (WHERE event = 'failed') AS last_error, bool_or(event = 'extracted') AS ex FROM r GROUP BY symbol_id)
SELECT symbol_id, stage, attempts, last_error FROM g WHERE NOT (ex AND stage = 0)""")
def q84(spark, d):
    event = F.when(F.col("event_type") == "signup", "requeued").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "embedded").when(F.col("event_type") == "view", "has_process").otherwise("extracted")
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("symbol_id"), F.lit("h").alias("hash"), event.alias("event"), F.when(F.col("event_type") == "error", F.concat(F.lit("E"), F.col("event_id") % 5)).alias("error"))
    return I.replay_queue(log)


@query("q85_session_windows", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def q85(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("q86_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q86(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("q87_claimable", """
SELECT event_id AS symbol_id, epoch_us(ts) // 1000 AS queued_at_ms FROM events WHERE user_id % 4 < 3 AND (event_type <> 'click' OR value > 50) ORDER BY queued_at_ms, symbol_id LIMIT 50""")
def q87(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("symbol_id"), F.timestamp_diff("MILLISECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), "ts").alias("queued_at_ms"), (F.col("user_id") % 4).alias("attempts"), F.when((F.col("event_type") == "click") & (F.col("value") <= 50), F.lit(2_000_000)).when(F.col("event_type") == "click", F.lit(0)).alias("claimed_at_ms"))
    return I.claimable(rows, 2_000_000, 50).select("symbol_id", "queued_at_ms")


LOG = """
l AS (SELECT event_id AS seq, user_id AS symbol_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'released' ELSE 'claimed' END AS event, event_id % 11 AS stamp, epoch_us(ts) // 1000 AS at_ms FROM events)"""


@query("q88_claim_holders", f"""
WITH RECURSIVE {LOG}, n AS (SELECT *, sum(CASE WHEN event = 'claimed' THEN 0 ELSE 1 END) OVER (PARTITION BY symbol_id ORDER BY at_ms, CASE WHEN event = 'claimed' THEN 0 ELSE 1 END, stamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ep FROM l),
e AS (SELECT *, coalesce(ep, 0) AS epoch, max(coalesce(ep, 0) + CASE WHEN event = 'claimed' THEN 0 ELSE 1 END) OVER (PARTITION BY symbol_id) AS last FROM n),
o AS (SELECT symbol_id, at_ms, stamp::VARCHAR AS stamp, row_number() OVER (PARTITION BY symbol_id ORDER BY at_ms, stamp::VARCHAR) AS k FROM e WHERE event = 'claimed' AND epoch = last),
h AS (SELECT symbol_id, k, at_ms, stamp FROM o WHERE k = 1 UNION ALL SELECT o.symbol_id, o.k, CASE WHEN h.at_ms < o.at_ms - 600000 THEN o.at_ms ELSE h.at_ms END, CASE WHEN h.at_ms < o.at_ms - 600000 THEN o.stamp ELSE h.stamp END FROM h JOIN o ON o.symbol_id = h.symbol_id AND o.k = h.k + 1)
SELECT symbol_id, arg_max(stamp, k) AS stamp, arg_max(at_ms, k) AS claimed_at_ms FROM h GROUP BY symbol_id""")
def q88(spark, d):
    """Who holds each symbol after all claims, releases and failures of the log."""
    event = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "released").otherwise("claimed")
    at = F.timestamp_diff("MILLISECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), "ts")
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("symbol_id"), F.lit("h").alias("hash"), event.alias("event"), F.lit(None).cast("string").alias("error"), (F.col("event_id") % 11).cast("string").alias("stamp"), at.alias("at_ms"))
    return I.claims(log)
