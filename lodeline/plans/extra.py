"""Native extras: categories that the engine gives for free."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeline.catalogue import query, table


@query("extra_rollup", """
SELECT n_regionkey, n_nationkey, count(*) AS customers, round(sum(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)""")
def rollup(spark, d):
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 4).alias("balance"))


@query("extra_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("extra_set_operations", """
WITH f AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM f INTERSECT SELECT * FROM o) UNION ALL SELECT 'only' AS part, count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM o) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM f UNION SELECT * FROM o)""")
def sets(spark, d):
    rows = table(spark, d, "orders")
    f, o = rows.filter("o_orderstatus = 'F'").select("o_custkey"), rows.filter("o_orderstatus = 'O'").select("o_custkey")
    return f.intersect(o).agg(F.lit("both").alias("part"), F.count("*").alias("n")).union(f.subtract(o).agg(F.lit("only"), F.count("*"))).union(f.union(o).distinct().agg(F.lit("any"), F.count("*")))


@query("extra_semi_anti", """
SELECT c_mktsegment, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS buyers, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS others FROM customer GROUP BY c_mktsegment""")
def semi(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    both = c.join(o, "c_custkey", "left_semi").withColumn("b", F.lit(1)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("b", F.lit(0)))
    return both.groupBy("c_mktsegment").agg(F.sum("b").alias("buyers"), F.sum(1 - F.col("b")).alias("others"))


@query("extra_ranking_windows", """
SELECT s_suppkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS quarter, lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS above FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC)""")
def windows(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"))
    t = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.ntile(4).over(t).alias("quarter"), F.lag("s_suppkey").over(t).alias("above"))
