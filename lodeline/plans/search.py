"""Full-text search over the documents and lookup of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalogue import query, table
from lodeline.functions.stem import stem, stemmed_tokens
from lodeline.functions.text import split_identifier
from lodeline.operators import search as S

TERMS = ["ther", "onthe", "in"]
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
POSTINGS = f"p AS (SELECT doc_id, t AS token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS t FROM documents) GROUP BY ALL), l AS (SELECT doc_id, len({TOKENS}) AS n FROM documents)"
TERM_SQL = "q AS (SELECT unnest(['ther', 'onthe', 'in']) AS term)"


@query("q10_postings", f"""
WITH {POSTINGS} SELECT token, count(*) AS docs, sum(tf)::BIGINT AS tf, max(n) AS longest FROM p JOIN l USING (doc_id) GROUP BY token""")
def q10(spark, d):
    docs = table(spark, d, "documents")
    return S.postings(docs, "doc_id", "text").groupBy("token").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"), F.max("n_tokens").alias("longest"))


@query("q11_bm25", f"""
WITH {POSTINGS}, {TERM_SQL},
f AS (SELECT p.doc_id, q.term, sum(tf) AS tf FROM p JOIN q ON starts_with(p.token, q.term) GROUP BY ALL),
g AS (SELECT term, count(*) AS df FROM f GROUP BY term), s AS (SELECT count(*) AS rows, avg(n) AS mean FROM l),
w AS (SELECT f.doc_id, CASE WHEN ln((rows - df + 0.5) / (df + 0.5)) > 0 THEN ln((rows - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / mean)) AS x
  FROM f JOIN g USING (term) JOIN l USING (doc_id) CROSS JOIN s)
SELECT doc_id, round(sum(x), 9) AS score FROM w GROUP BY doc_id ORDER BY round(sum(x), 9) DESC, doc_id LIMIT 50""")
def q11(spark, d):
    return S.bm25(table(spark, d, "documents"), "doc_id", S.tokens(F.col("text")), TERMS).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(50)


@query("q12_prefix_hits", f"WITH {POSTINGS}, {TERM_SQL} SELECT DISTINCT doc_id FROM p JOIN q ON starts_with(p.token, q.term)")
def q12(spark, d):
    return S.hit_ids(table(spark, d, "documents"), "doc_id", S.tokens(F.col("text")), TERMS)


@query("q13_find", """
WITH s AS (SELECT p_partkey, p_name, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS parts FROM part),
h AS (SELECT p_partkey, p_name, (lower(p_name) = 'red widget')::INT AS exact FROM s WHERE lower(p_name) = 'red widget' OR len(list_filter(parts, lambda x: starts_with(x, 'red widget'))) > 0 OR list_has_all(parts, ['red', 'widget'])),
t AS (SELECT * FROM h ORDER BY exact DESC, length(p_name), p_name, p_partkey LIMIT 20),
c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS k FROM c)
SELECT p_partkey, p_name, exact, coalesce(count(l_suppkey), 0) AS n_files, coalesce(sum(n), 0)::BIGINT AS n_refs, coalesce(list(l_suppkey ORDER BY k) FILTER (WHERE k <= 5), []) AS top
FROM t LEFT JOIN r ON l_partkey = p_partkey GROUP BY ALL""")
def q13(spark, d):
    symbols = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_name").alias("path"), F.col("p_partkey").alias("line_start"))
    found = S.find(symbols, "red widget", 20)
    refs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("path"))
    by = S.referrers(refs.join(F.broadcast(found.select(F.col("line_start").alias("name"))), "name", "left_semi")).withColumnRenamed("name", "line_start")
    rows = found.join(by, "line_start", "left")
    return rows.select(
        F.col("line_start").alias("p_partkey"), F.col("name").alias("p_name"), "exact", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_refs", F.lit(0)).alias("n_refs"),
        F.coalesce(F.transform("top", lambda x: x["path"]), F.array().cast("array<bigint>")).alias("top"),
    )


@query("q14_stemmed_bm25")
def q14(spark, d):
    """Stemming is outside SQL; tested on hand-made cases."""
    docs = table(spark, d, "documents").select("doc_id", stemmed_tokens(F.col("text")).alias("stems"))
    return S.bm25(docs, "doc_id", F.col("stems"), [stem(t) for t in TERMS]).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(50)


@query("q16_own_references", """
WITH f AS (SELECT l_suppkey AS path, l_partkey AS name FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL ORDER BY name, path LIMIT 200),
c AS (SELECT l_partkey AS name, l_suppkey AS src, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT f.path, f.name, src, n, row_number() OVER (PARTITION BY f.path, f.name ORDER BY src = f.path, n DESC, src) AS k FROM f JOIN c ON c.name = f.name)
SELECT path, name, count(*) FILTER (WHERE src <> path) AS n_files, coalesce(sum(n) FILTER (WHERE src <> path), 0)::BIGINT AS n_refs, coalesce(sum(n) FILTER (WHERE src = path), 0)::BIGINT AS n_own,
  coalesce(list(src ORDER BY k) FILTER (WHERE src <> path AND k <= 5), []) AS top FROM r GROUP BY path, name""")
def q16(spark, d):
    """References in a symbol's own file apart from those of others; an answer's 200 symbols are the feature."""
    lines = table(spark, d, "lineitem")
    found = lines.filter("l_linenumber = 1").select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("name")).distinct().orderBy("name", "path").limit(200)
    rows = S.referrers_of(found, lines.select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("name")))
    return rows.select("path", "name", "n_files", "n_refs", "n_own", F.transform("top", lambda x: x["path"]).alias("top"))


@query("q15_identifier_parts", """
WITH u AS (SELECT unnest(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> '')) AS part FROM part)
SELECT part, count(*) AS n FROM u GROUP BY part""")
def q15(spark, d):
    rows = table(spark, d, "part").select(F.explode(split_identifier(F.lower(F.concat_ws(" ", "p_name", "p_type")))).alias("part"))
    return rows.groupBy("part").agg(F.count("*").alias("n"))
