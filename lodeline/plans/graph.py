"""The reference graph of customers, suppliers and parts: suppliers define parts, customers refer to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalogue import query, table
from lodeline.operators import graph as G
from lodeline.storage import settle, spread

EDGES = """
d AS (SELECT DISTINCT 's' || l_suppkey AS dst, l_partkey AS name FROM lineitem),
f AS (SELECT 'c' || o_custkey AS src, l_partkey AS name, count(*) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
n AS (SELECT name, count(*) AS c FROM d GROUP BY name),
e AS (SELECT src, dst, f.name, k, k * 1.0::DOUBLE / c AS weight FROM f JOIN n USING (name) JOIN d USING (name))"""
PAIRS = EDGES + ", pr AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight, count(DISTINCT name) AS names FROM e GROUP BY src, dst)"
NODES = "nd AS MATERIALIZED (SELECT DISTINCT node FROM (SELECT src AS node FROM pr UNION ALL SELECT dst FROM pr))"


def pagerank_sql(start: str, head: str, tail: str) -> str:
    """Fifty unrolled rounds; ``start`` is the personalisation of a node."""
    steps = [
        f"b AS MATERIALIZED (SELECT node, {start} AS w FROM nd), z AS MATERIALIZED (SELECT node, w / (SELECT sum(w) FROM b) AS p FROM b)",
        "o AS MATERIALIZED (SELECT src, sum(weight) AS ow FROM pr GROUP BY src)",
        "st AS MATERIALIZED (SELECT pr.src, pr.dst, weight / ow AS sh FROM pr JOIN o ON o.src = pr.src)",
        "r0 AS MATERIALIZED (SELECT node, p AS rank FROM z)",
    ]
    for k in range(1, G.ITERATIONS + 1):
        steps.append(
            f"r{k} AS MATERIALIZED (SELECT z.node, 0.15 * z.p + 0.85 * (coalesce(g.got, 0) + z.p * (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM o))) AS rank "
            f"FROM z LEFT JOIN (SELECT st.dst AS node, sum(r.rank * st.sh) AS got FROM st JOIN r{k - 1} AS r ON r.node = st.src GROUP BY st.dst) AS g ON g.node = z.node)"
        )
    return f"WITH {head}, {NODES}, " + ", ".join(steps) + f", rk AS MATERIALIZED (SELECT node, rank / (SELECT sum(rank) FROM r{G.ITERATIONS}) AS rank FROM r{G.ITERATIONS}) " + tail


def tables(spark, d):
    """Definitions (file, name) and references (file, name, count)."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    n = lines.count()
    defs = spread(lines.select(F.concat(F.lit("s"), "l_suppkey").alias("file"), F.col("l_partkey").alias("name")), n, "file", "name").distinct()
    bought = spread(lines.select("l_orderkey", "l_partkey"), n, "l_orderkey").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    refs = spread(bought.select(F.concat(F.lit("c"), "o_custkey").alias("file"), F.col("l_partkey").alias("name")), n, "file", "name").groupBy("file", "name").agg(F.count("*").alias("count"))
    return defs, refs


def settled(spark, d):
    """The same, written once for queries that read them more than once."""
    defs, refs = tables(spark, d)
    return settle(defs, "defs"), settle(refs, "refs")


def ranks(defs, refs, p=None):
    both = refs.join(defs.select("name").distinct(), "name", "left_semi").select("file").union(defs.join(refs.select("name").distinct(), "name", "left_semi").select("file"))
    nodes = both.select(F.col("file").alias("node")).distinct()
    return G.pagerank_of_names(nodes.withColumn("p", F.lit(1.0) if p is None else p), defs, refs)


@query("q20_weighted_edges", f"WITH {EDGES} SELECT src, dst, name, k AS count, round(weight, 9) AS weight FROM e")
def q20(spark, d):
    return G.weighted_edges(*tables(spark, d), digits=9)


@query("q21_pagerank", pagerank_sql("1.0::DOUBLE", PAIRS, "SELECT node, round(rank, 9) AS rank FROM rk"))
def q21(spark, d):
    return ranks(*settled(spark, d)).withColumn("rank", F.round("rank", 9))


@query("q22_pagerank_personalised", pagerank_sql("1.0::DOUBLE + CASE WHEN node IN ('c1', 'c2', 's3') THEN 10 ELSE 0 END", PAIRS, "SELECT node, round(rank, 9) AS rank FROM rk"))
def q22(spark, d):
    return ranks(*settled(spark, d), F.lit(1.0) + F.when(F.col("node").isin("c1", "c2", "s3"), 10.0).otherwise(0.0)).withColumn("rank", F.round("rank", 9))


@query("q23_edge_projection", f"WITH {PAIRS} SELECT src, dst, round(weight, 9) AS weight, names FROM pr")
def q23(spark, d):
    return G.projected_names(*tables(spark, d)).withColumn("weight", F.round("weight", 9))


# files are orders and parts: an order refers to its parts, a supplier-part pair is defined by the part's orders of one flag
BLAST = """
u AS (SELECT DISTINCT 'o' || l_orderkey AS file, l_partkey AS name FROM lineitem WHERE l_linenumber > 1),
df AS (SELECT DISTINCT 'o' || l_orderkey AS file, l_partkey AS name FROM lineitem WHERE l_linenumber = 1),
root AS (SELECT file, name FROM df ORDER BY name, file LIMIT 1),
b1 AS MATERIALIZED (SELECT u.file, min(u.name) AS via FROM u JOIN root ON root.name = u.name WHERE u.file NOT IN (SELECT file FROM root) GROUP BY u.file),
b2 AS MATERIALIZED (SELECT u.file, min(u.name) AS via FROM u WHERE u.name IN (SELECT name FROM df WHERE file IN (SELECT file FROM b1)) AND u.file NOT IN (SELECT file FROM b1 UNION ALL SELECT file FROM root) GROUP BY u.file),
b3 AS MATERIALIZED (SELECT u.file, min(u.name) AS via FROM u WHERE u.name IN (SELECT name FROM df WHERE file IN (SELECT file FROM b2)) AND u.file NOT IN (SELECT file FROM b1 UNION ALL SELECT file FROM b2 UNION ALL SELECT file FROM root) GROUP BY u.file),
b4 AS (SELECT u.file FROM u WHERE u.name IN (SELECT name FROM df WHERE file IN (SELECT file FROM b3)) AND u.file NOT IN (SELECT file FROM b1 UNION ALL SELECT file FROM b2 UNION ALL SELECT file FROM b3 UNION ALL SELECT file FROM root)),
al AS (SELECT file, 1 AS depth, via FROM b1 UNION ALL SELECT file, 2, via FROM b2 UNION ALL SELECT file, 3, via FROM b3)"""


def blast(spark, d):
    lines = table(spark, d, "lineitem")
    row = F.concat(F.lit("o"), "l_orderkey").alias("file")
    refs = lines.filter("l_linenumber > 1").select(row, F.col("l_partkey").alias("name")).distinct()
    defs = lines.filter("l_linenumber = 1").select(row, F.col("l_partkey").alias("name")).distinct()
    root = defs.orderBy("name", "file").first()
    return G.blast_radius(defs, refs, root.file, root.name)


@query("q24_blast_radius", f"WITH {BLAST} SELECT file, depth, via FROM al ORDER BY depth, file LIMIT 200")
def q24(spark, d):
    return blast(spark, d)[0].select("file", F.col("depth").cast("int").alias("depth"), "via")


@query("q25_blast_truncation", f"""
WITH {BLAST} SELECT CASE WHEN (SELECT count(*) FROM al) > 200 THEN 'files' WHEN EXISTS (SELECT 1 FROM b4) THEN 'depth' END AS truncated,
  least((SELECT count(*) FROM al), 200) AS files""")
def q25(spark, d):
    found, cut = blast(spark, d)
    return found.agg(F.count("*").alias("files")).select(F.lit(cut).cast("string").alias("truncated"), "files")


LINKS = r"""
pg AS (SELECT page_id, '/' || regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS own FROM pages),
lk AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""


@query("q26_hops", """
WITH RECURSIVE ed AS (SELECT 'n' || n_nationkey AS u, 'r' || n_regionkey AS v FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
bo AS (SELECT u, v FROM ed UNION SELECT v, u FROM ed),
w AS (SELECT 's1' AS node, 0 AS hops UNION SELECT bo.v, w.hops + 1 FROM w JOIN bo ON bo.u = w.node WHERE w.hops < 6)
SELECT node, min(hops) AS hops FROM w GROUP BY node""")
def q26(spark, d):
    a = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    b = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    return G.hops(a.union(b), "s1").select("node", F.col("hops").cast("int").alias("hops"))


@query("q27_link_degrees", f"""
WITH {LINKS}, e AS (SELECT 'p' || page_id AS src, href AS dst, 1.0::DOUBLE AS w FROM lk)
SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(w) AS out_weight FROM (SELECT src AS node, 1 AS o, 0 AS i, w FROM e UNION ALL SELECT dst, 0, 1, 0 FROM e) GROUP BY node""")
def q27(spark, d):
    links = table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("dst"))
    return G.degrees(links.withColumn("weight", F.lit(1.0)))
