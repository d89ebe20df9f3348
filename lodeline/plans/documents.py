"""Extraction, gates and incremental maintenance over pages, documents and event properties."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeline.catalogue import query, table
from lodeline.functions import text as T
from lodeline.functions.secrets import assigned_values, secret_rule
from lodeline.operators import incremental as I
from lodeline.operators.incremental import BUCKET_DIGITS as DIGITS
from lodeline.sources import gates


@query("q50_html_headings", r"""
SELECT page_id, level::INT AS level, replace(replace(trim(regexp_replace(regexp_replace(body, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '&amp;', '&'), '&quot;', '"') AS heading
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h([1-6])[^>]*>(.*?)</h[1-6]>', 1)) AS level, unnest(regexp_extract_all(html, '<h([1-6])[^>]*>(.*?)</h[1-6]>', 2)) AS body FROM pages)""")
def q50(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(gates.html_headings(F.col("html"))).alias("h"))
    return rows.select("page_id", "h.level", "h.heading")


@query("q51_link_mentions", r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(href, '[?#].*$', ''), '/+$', ''), '^.*/', ''), '\.[^.]*$', '') AS stem, href FROM l)
SELECT page_id, stem, count(*) AS n FROM s WHERE stem <> '' AND NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT starts_with(href, '//') AND NOT starts_with(href, '#') GROUP BY ALL""")
def q51(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return rows.select("page_id", T.link_stem(F.col("href")).alias("stem")).filter("stem is not null").groupBy("page_id", "stem").agg(F.count("*").alias("n"))


@query("q52_document_tags", r"""
SELECT doc_id, CASE WHEN length(l) > 160 THEN left(l, 159) || '…' ELSE l END AS signature
FROM (SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS l FROM documents)""")
def q52(spark, d):
    return table(spark, d, "documents").select("doc_id", gates.first_line(F.col("text")).alias("signature"))


@query("q53_running_headings", r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS line_no FROM d),
h AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^#{1,3} ') THEN trim(regexp_replace(line, '^#+ ', '')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading FROM l)
SELECT doc_id, coalesce(heading, '') AS heading, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM h GROUP BY ALL""")
def q53(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    head = F.when(F.col("line").rlike("^#{1,3} "), F.trim(F.regexp_replace("line", "^#+ ", "")))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("heading", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit("")))
    return rows.groupBy("doc_id", "heading").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("q54_json_keys", """
WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events)
SELECT key, CASE json_type(props, '$.' || key) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' ELSE 'number' END AS type, count(*) AS n FROM k GROUP BY ALL""")
def q54(spark, d):
    rows = table(spark, d, "events").select(F.parse_json("props").alias("v"))
    return gates.json_keys(rows, "v").groupBy("key", "type").agg(F.count("*").alias("n"))


@query("q55_content_gates", """
SELECT doc_id, CASE WHEN strlen(text) > 262144 THEN 'too-large' WHEN strlen(text) // greatest(lines, 1) > 500 THEN 'minified' END AS skipped_reason
FROM (SELECT doc_id, text, len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines FROM documents)""")
def q55(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", gates.document_reason(F.lit("doc.txt"), F.octet_length("text"), F.col("text")).alias("skipped_reason"))


@query("q56_secrets", r"""
WITH a AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?i)\b(?:api[_-]?key|secret|token|password|passwd|auth)\w*\s*[:=]\s*[''"]([A-Za-z0-9_\-/+=]{32,})[''"]', 1)) AS v FROM documents),
c AS (SELECT doc_id, v, unnest(string_split(v, '')) AS ch FROM a), f AS (SELECT doc_id, v, ch, count(*) AS n, length(v) AS l FROM c GROUP BY ALL)
SELECT doc_id, 'secret-assignment' AS rule, count(*) AS assignments, round(max(e), 6) AS entropy FROM (SELECT doc_id, v, -sum(n * 1.0 / l * log2(n * 1.0 / l)) AS e FROM f GROUP BY doc_id, v) GROUP BY doc_id HAVING max(e) > 3.5""")
def q56(spark, d):
    rows = table(spark, d, "documents").select("doc_id", secret_rule(F.col("text")).alias("rule"), F.array_distinct(assigned_values(F.col("text"))).alias("v")).filter("rule is not null")
    return rows.select("doc_id", "rule", F.size("v").cast("long").alias("assignments"), F.round(F.array_max(F.transform("v", T.entropy)), 6).alias("entropy"))


@query("q57_incremental_diff", """
WITH k AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 10 < 8),
s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 10 > 0)
SELECT coalesce(s.doc_id, k.doc_id) AS path, CASE WHEN k.doc_id IS NULL THEN 'new' WHEN s.doc_id IS NULL THEN 'removed' WHEN k.n_chars = s.n_chars THEN 'unchanged' ELSE 'changed' END AS change FROM s FULL JOIN k ON s.doc_id = k.doc_id""")
def q57(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("mtime_ms"), F.col("n_chars").alias("size"))
    scanned = docs.filter("path % 10 > 0").withColumn("size", F.when(F.col("path") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return I.scan_changes(docs.filter("path % 10 < 8"), scanned)


def version_sql() -> str:
    levels = [f"b{DIGITS} AS (SELECT left(sha256(path), {DIGITS}) AS bucket, sha256(string_agg(l, '' ORDER BY path)) AS dg FROM (SELECT path, path || chr(9) || h || chr(10) AS l FROM r) GROUP BY bucket)"]
    levels += [f"b{k} AS (SELECT left(b.bucket, {k}) AS bucket, sha256(string_agg(dg, '' ORDER BY b.bucket)) AS dg FROM b{k + 1} AS b GROUP BY left(b.bucket, {k}))" for k in range(DIGITS - 1, -1, -1)]
    return "WITH r AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS path, sha256(text) AS h FROM documents), " + ", ".join(levels) + " SELECT left(dg, 12) AS version FROM b0"


@query("q58_index_version", version_sql())
def q58(spark, d):
    docs = table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.sha2("text", 256).alias("content_hash"))
    return I.index_version(docs)


@query("q59_upsert", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE lang END AS lang FROM documents")
def q59(spark, d):
    """Even ids are held, every fourth is replaced, odd ones and every third are inserted where they are new."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    fresh = docs.filter("doc_id % 4 = 0").withColumn("lang", F.lit("new"))
    return I.insert_ignore(I.upsert(docs.filter("doc_id % 2 = 0"), fresh, ["doc_id"]), docs.filter("doc_id % 2 = 1 or doc_id % 3 = 0"), ["doc_id"])
