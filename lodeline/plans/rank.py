"""Ranking on the graph of suppliers and customers, budgets and provenance over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalogue import query, table
from lodeline.functions.text import approx_tokens
from lodeline.operators import graph as G
from lodeline.operators import provenance as P
from lodeline.operators import rank as R
from lodeline.plans.graph import PAIRS, pagerank_sql, ranks, settled, tables
from lodeline.storage import settle

FLOW = "fl AS (SELECT e.dst, e.name, sum(rk.rank * e.weight / oe.ow) AS score FROM e JOIN (SELECT src, sum(weight) AS ow FROM e GROUP BY src) AS oe ON oe.src = e.src JOIN rk ON rk.node = e.src GROUP BY e.dst, e.name)"
REFS = "rb AS (SELECT dst, name, src, max(k) AS k FROM e GROUP BY ALL), rr AS (SELECT *, row_number() OVER (PARTITION BY dst, name ORDER BY k DESC, src) AS p FROM rb)"


@query("q30_score_distribution", pagerank_sql("1.0::DOUBLE", PAIRS, f", {FLOW} SELECT dst, name, round(score, 9) AS score FROM fl"))
def q30(spark, d):
    defs, refs = settled(spark, d)
    return R.distribute(defs, refs, ranks(defs, refs)).withColumn("score", F.round("score", 9))


@query("q31_hit_shares", """
WITH h AS (SELECT doc_id, source, lang = 'en' AS name_hit, CASE WHEN doc_id % 3 <> 0 THEN n_chars::DOUBLE END AS body, CASE WHEN doc_id % 5 = 0 THEN 0.25::DOUBLE END AS semantic FROM documents),
m AS (SELECT *, max(body) OVER (PARTITION BY source) AS top FROM h),
w AS (SELECT *, CASE WHEN name_hit THEN 1.0::DOUBLE ELSE 0 END + greatest(CASE WHEN body IS NULL THEN 0.0 WHEN top > 0 THEN body / top ELSE 1.0 END, coalesce(semantic, 0)) AS x FROM m)
SELECT doc_id, source, round(CASE WHEN sum(x) OVER (PARTITION BY source) > 0 THEN x / sum(x) OVER (PARTITION BY source) ELSE 0 END, 9) AS share FROM w""")
def q31(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("lang") == "en").alias("name_hit"), F.when(F.col("doc_id") % 3 != 0, F.col("n_chars").cast("double")).alias("body"), F.when(F.col("doc_id") % 5 == 0, 0.25).alias("semantic"))
    return R.hit_shares(docs, "source").select("doc_id", "source", F.round("share", 9).alias("share"))


@query("q32_referenced_by", f"""
WITH {PAIRS}, {REFS} SELECT dst, name, count(*) AS referrers, sum(k)::BIGINT AS total, list(src || ':' || k ORDER BY p) FILTER (WHERE p <= 5) AS top FROM rr GROUP BY dst, name""")
def q32(spark, d):
    rows = R.referenced_by(*tables(spark, d), rows=table(spark, d, "lineitem").count())
    return rows.select("dst", "name", "referrers", "total", F.transform("referenced_by", lambda x: F.concat_ws(":", x["path"], x["count"])).alias("top"))


def final(spark, d, limit: int = 100):
    """The ranked symbols (supplier, part) with their reasons."""
    defs, refs = settled(spark, d)
    file_ranks = settle(ranks(defs, refs), "ranks")
    scored = R.symbol_scores(defs, R.distribute(defs, refs, file_ranks), file_ranks).withColumn("score", F.round("score", 9))
    # cut before the reasons are gathered: only answers need them
    top = scored.orderBy(F.desc("score"), "file", "name").limit(limit)
    top = R.numbered(top, F.desc("score"), "file", "name")
    shown = F.broadcast(top.select("name").distinct())
    reasons = R.referenced_by(top.select("file", "name"), refs.join(shown, "name", "left_semi")).withColumnRenamed("dst", "file")
    return top.join(F.broadcast(reasons), ["file", "name"], "left")


@query("q33_final_ranking", pagerank_sql("1.0::DOUBLE", PAIRS, f""", {FLOW}, {REFS},
sc AS (SELECT d.dst AS file, d.name, round(coalesce(fl.score, rk.rank * 0.001), 9) AS score, round(rk.rank, 9) AS file_rank FROM d JOIN rk ON rk.node = d.dst LEFT JOIN fl ON fl.dst = d.dst AND fl.name = d.name),
tp AS (SELECT *, row_number() OVER (ORDER BY score DESC, file, name)::INT AS rank FROM sc ORDER BY rank LIMIT 100)
SELECT tp.file, tp.name, tp.score, tp.file_rank, tp.rank, max(x.referrers) AS referrers, max(x.top) AS top FROM tp LEFT JOIN
 (SELECT dst, name, count(*) AS referrers, list(src || ':' || k ORDER BY p) FILTER (WHERE p <= 5) AS top FROM rr GROUP BY dst, name) AS x ON x.dst = tp.file AND x.name = tp.name GROUP BY ALL"""))
def q33(spark, d):
    return final(spark, d).select("file", "name", "score", F.round("file_rank", 9).alias("file_rank"), "rank", "referrers", F.transform("referenced_by", lambda x: F.concat_ws(":", x["path"], x["count"])).alias("top"))


BUDGETED = "t AS (SELECT doc_id, source, n_chars, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents ORDER BY n_chars DESC, doc_id LIMIT 500), rn AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id)::INT AS rank, sum(tokens) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM t)"


def budgeted(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", approx_tokens(F.col("text")).alias("tokens"))
    # an answer's rows: the top 500 are the feature, as a budget serves no more
    top = docs.orderBy(F.desc("n_chars"), "doc_id").limit(500)
    return R.within_budget(R.numbered(top, F.desc("n_chars"), "doc_id"), "tokens", 100_000, F.desc("n_chars"), "doc_id")


@query("q34_budget_prefix", f"WITH {BUDGETED} SELECT doc_id, tokens, running, running <= 100000 AS served FROM rn")
def q34(spark, d):
    return budgeted(spark, d).select("doc_id", "tokens", "running", "served")


@query("q35_provenance", f"""
WITH {BUDGETED}, n AS (SELECT count(*) AS s FROM rn WHERE running <= 100000)
SELECT 1::BIGINT AS retrieval_id, rank, doc_id, round(1.0::DOUBLE / rank, 9) AS score, rank <= s AS served FROM rn CROSS JOIN n WHERE rank <= s + 25""")
def q35(spark, d):
    rows = budgeted(spark, d)
    served = rows.filter("served").count()
    return P.items(rows.drop("served"), 1, served).select("retrieval_id", "rank", "doc_id", F.round(R.reciprocal(F.col("rank")), 9).alias("score"), "served")


@query("q36_file_groups", f"""
WITH {BUDGETED}, s AS (SELECT *, min(rank) OVER (PARTITION BY source) AS best FROM rn WHERE running <= 100000)
SELECT source AS path, doc_id AS line_start, rank, dense_rank() OVER (ORDER BY best, source)::INT AS file_order, row_number() OVER (PARTITION BY source ORDER BY doc_id, rank)::INT AS row_order FROM s""")
def q36(spark, d):
    served = budgeted(spark, d).filter("served").select(F.col("source").alias("path"), F.col("doc_id").alias("line_start"), "rank")
    return R.file_groups(served).drop("best")


SEEDED = "1.0::DOUBLE + CASE WHEN starts_with(node, 'c') AND substr(node, 2)::BIGINT % 5 = 0 THEN 5 * 0.25 ELSE 0 END + CASE WHEN starts_with(node, 's') AND substr(node, 2)::BIGINT % 7 = 0 THEN 5 ELSE 0 END + CASE WHEN starts_with(node, 's') AND substr(node, 2)::BIGINT % 11 = 0 THEN 2.5 ELSE 0 END + CASE WHEN starts_with(node, 'c') AND substr(node, 2)::BIGINT % 13 = 0 THEN 5 * 0.5 ELSE 0 END"


@query("q37_knowledge_seeds", pagerank_sql(SEEDED, PAIRS, """SELECT node, round(rank, 9) AS rank,
 list_filter([CASE WHEN starts_with(node, 'c') AND substr(node, 2)::BIGINT % 5 = 0 THEN 'semantic' END, CASE WHEN starts_with(node, 's') AND substr(node, 2)::BIGINT % 7 = 0 THEN 'entity:Seven' END,
  CASE WHEN starts_with(node, 's') AND substr(node, 2)::BIGINT % 11 = 0 THEN 'implements:Eleven' END, CASE WHEN starts_with(node, 'c') AND substr(node, 2)::BIGINT % 13 = 0 THEN 'theme' END], lambda x: x IS NOT NULL) AS seeds FROM rk"""))
def q37(spark, d):
    """Ranks personalised by what vectors, entities, implementing code and themes say of files."""
    defs, refs = settled(spark, d)
    nodes = defs.select(F.col("file").alias("node")).union(refs.select("file")).distinct()
    number = F.substring("node", 2, 20).cast("long")
    c, s = F.col("node").startswith("c"), F.col("node").startswith("s")
    none = F.lit(False)
    facts = nodes.select(
        "node", none.alias("focus"), none.alias("pinned"), none.alias("text_hit"), none.alias("note"), F.when(c & (number % 5 == 0), 0.25).alias("semantic"), F.when(c & (number % 13 == 0), 0.5).alias("theme"),
        F.when(s & (number % 7 == 0), F.array(F.lit("Seven"))).alias("entities"), F.when(s & (number % 11 == 0), F.array(F.lit("Eleven"))).alias("implements"), F.lit("").alias("query"),
    )
    person = R.personalisation(facts)
    return G.pagerank_of_names(person.select("node", "p"), defs, refs).join(person.drop("p"), "node").select("node", F.round("rank", 9).alias("rank"), "seeds")
