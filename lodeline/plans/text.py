"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalogue import query, table
from lodeline.functions import text as T

STOP = ", ".join(f"'{w}'" for w in T.QUERY_STOPWORDS)
#: Identifier boundaries for an engine without lookaround: spaces put in, then split.
SPACED = r"regexp_replace(regexp_replace({0}, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
PARTS = r"list_transform(list_filter(regexp_split_to_array(" + SPACED + r", '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), lambda x: lower(x))"


@query("q01_split_identifier", f"""
SELECT p_partkey, {PARTS.format("replace(p_name, ' ', '') || p_brand")} AS parts FROM part""")
def q01(spark, d):
    return table(spark, d, "part").select("p_partkey", T.split_identifier(F.concat(F.regexp_replace("p_name", " ", ""), "p_brand")).alias("parts"))


@query("q02_query_terms", f"""
WITH w AS (SELECT item_id, {PARTS.format(r"regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g')")} AS p FROM benchmark),
u AS (SELECT item_id, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM w),
f AS (SELECT item_id, t, min(i) AS i FROM u WHERE length(t) >= 2 AND t NOT IN ({STOP}) GROUP BY item_id, t)
SELECT item_id, list(t ORDER BY i) AS terms FROM f GROUP BY item_id""")
def q02(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.query_terms(F.col("text")).alias("terms")).filter(F.size("terms") > 0)


@query("q03_approx_tokens", """
SELECT lang, count(*) AS docs, sum(t)::BIGINT AS tokens, max(t)::BIGINT AS longest, round(avg(t), 6) AS mean
FROM (SELECT lang, ceil(length(text) / 4.0)::BIGINT AS t FROM documents) GROUP BY lang""")
def q03(spark, d):
    rows = table(spark, d, "documents").select("lang", T.approx_tokens(F.col("text")).alias("t"))
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("t").alias("tokens"), F.max("t").alias("longest"), F.round(F.avg("t"), 6).alias("mean"))


@query("q04_norm_names", r"""
WITH n AS (SELECT p_partkey, trim(regexp_replace(lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))), '[.,;:!?]+$', '')) AS norm FROM part)
SELECT norm, count(*) AS parts, min(p_partkey) AS first FROM n GROUP BY norm""")
def q04(spark, d):
    return table(spark, d, "part").groupBy(T.norm_name(F.col("p_name")).alias("norm")).agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first"))


@query("q05_clean_squeeze", r"""
SELECT doc_id, md5(left(trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')), 300)) AS cleaned,
  md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{2,}', chr(10) || chr(10), 'g'))) AS squeezed FROM documents""")
def q05(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean(F.col("text"), 300)).alias("cleaned"), F.md5(T.squeeze_ws(F.col("text"))).alias("squeezed"))


@query("q06_hash_groups", """
SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1""")
def q06(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.section_hash(F.col("text")).alias("hash"))
    return rows.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1")


@query("q07_url_classes", r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1), '/+$', '') AS path FROM pages),
b AS (SELECT *, regexp_extract(path, '[^/]*$') AS base, string_split(path, '/') AS parts FROM p)
SELECT page_id, path, CASE WHEN contains(base, '.') THEN CASE lower(regexp_extract(base, '[^.]*$')) WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'json' THEN 'json' WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'text' END END AS lang,
  starts_with(path, 'de/') OR path = 'en/1' AS excluded,
  list_has_any(parts[1:len(parts) - 1], ['__tests__', '__mocks__', 'test', 'tests', 'bench', 'benches', 'benchmarks']) AS support FROM b""")
def q07(spark, d):
    path = F.regexp_replace(F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1), "/+$", "")
    rows = table(spark, d, "pages").select("page_id", path.alias("path"))
    excluded = T.is_excluded(F.col("path"), F.array(F.lit("de/"), F.lit("en/1")))
    return rows.select("page_id", "path", T.language(F.col("path")).alias("lang"), excluded.alias("excluded"), T.is_support_file(F.col("path"), F.lit(False)).alias("support"))


@query("q08_price_weighted_cost", """
SELECT l_returnflag, sum(l_quantity + 1.25 * l_tax + 0.1 * l_discount + 5 * l_linenumber)::DECIMAL(38, 4)::DOUBLE AS cost, count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def q08(spark, d):
    cost = T.token_cost(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_tax"), F.col("l_discount"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(cost).cast("decimal(38,4)").cast("double").alias("cost"), F.count("*").alias("n"))


@query("q09_text_labels", r"""
SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'Claudia Desk' WHEN 1 THEN 'CLI' WHEN 2 THEN 'UI' ELSE 'raw-' || user_id END AS label,
  least(4 + sqrt(n) * 1.5, 14) AS size, replace(replace(k, '%', '\%'), '_', '\_') AS escaped
FROM (SELECT user_id, count(*) AS n, max(event_type) || '_50%' AS k FROM events GROUP BY user_id)""")
def q09(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.concat(F.max("event_type"), F.lit("_50%")).alias("k"))
    key = F.when(F.col("user_id") % 4 == 0, "mcp:claudia-desk:12:34").when(F.col("user_id") % 4 == 1, F.concat(F.lit("cli-"), "user_id")).when(F.col("user_id") % 4 == 2, "serve").otherwise(F.concat(F.lit("raw-"), "user_id"))
    return rows.select("user_id", T.session_label(key).alias("label"), T.node_size(F.col("n")).alias("size"), T.like_escape(F.col("k")).alias("escaped"))
