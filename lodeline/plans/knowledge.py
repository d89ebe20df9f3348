"""The knowledge layer over parts, customers, orders and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeline.catalogue import query, table
from lodeline.functions.text import extend_description, norm_name
from lodeline.operators import knowledge as K
from lodeline.storage import PART_ROWS

#: Token windows of a name, about.
WINDOWS = 15


@query("q60_entity_merge", r"""
WITH n AS (SELECT p_partkey, p_name, lower(trim(p_name)) AS norm, p_type, CASE WHEN p_size > 48 THEN 'process' ELSE 'concept' END AS type FROM part),
f AS (SELECT norm, p_type, min(p_partkey) AS k FROM n GROUP BY ALL)
SELECT n.norm AS norm_name, arg_min(p_name, p_partkey) AS name, CASE WHEN bool_or(type = 'process') THEN 'process' ELSE arg_min(type, p_partkey) END AS type,
  left((SELECT string_agg(p_type, '; ' ORDER BY k) FROM f WHERE f.norm = n.norm), 300) AS description, count(DISTINCT p_partkey) AS mentions FROM n GROUP BY n.norm""")
def q60(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("section"), F.col("p_name").alias("name"), norm_name(F.col("p_name")).alias("norm_name"), F.when(F.col("p_size") > 48, "process").otherwise("concept").alias("type"), F.col("p_type").alias("description"))
    return K.merge_entities(rows, "section")


def customers(spark, d):
    """Customers as entities by their orders; a relation joins customers who order in sequence on one day."""
    orders = table(spark, d, "orders")
    entities = orders.groupBy(F.col("o_custkey").alias("entity_id")).agg(F.count("*").alias("mentions")).join(table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name")), "entity_id")
    relations = orders.select(F.col("o_orderkey").alias("relation_id"), F.col("o_custkey").alias("src_entity"), (F.col("o_custkey") * 7 % 1499).alias("dst_entity"))
    return entities, relations


OVERLAY = """
en AS (SELECT o_custkey AS entity_id, c_name AS name, count(*) AS mentions FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
re AS (SELECT o_orderkey AS relation_id, o_custkey AS src_entity, o_custkey * 7 % 1499 AS dst_entity FROM orders),
tp AS (SELECT * FROM en ORDER BY mentions DESC, name, entity_id LIMIT 500)"""


@query("q61_overlay", f"""
WITH {OVERLAY} SELECT relation_id, src_entity, dst_entity, (SELECT count(*) > 500 FROM en) AS truncated FROM re WHERE src_entity IN (SELECT entity_id FROM tp) AND dst_entity IN (SELECT entity_id FROM tp)""")
def q61(spark, d):
    _, inside, cut = K.overlay(*customers(spark, d))
    return inside.crossJoin(F.broadcast(cut)).select("relation_id", "src_entity", "dst_entity", "truncated")


@query("q62_entity_search", """
WITH e AS (SELECT p_name AS name, min(p_partkey) AS entity_id, count(*) AS mentions FROM part GROUP BY p_name)
SELECT entity_id, name, mentions, (lower(name) = 'red')::INT AS exact FROM e WHERE starts_with(lower(name), 'red') ORDER BY exact DESC, mentions DESC, name, entity_id LIMIT 20""")
def q62(spark, d):
    rows = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity_id"), F.count("*").alias("mentions"))
    return K.search(rows, "Red")


@query("q63_recount", """
WITH m AS (SELECT DISTINCT l_suppkey AS e, l_orderkey AS s FROM lineitem), c AS (SELECT e, count(*) AS n FROM m GROUP BY e),
r AS (SELECT s_suppkey AS a, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b FROM supplier)
SELECT s_suppkey AS entity_id, s_name AS name, n AS mentions, (SELECT count(*) FROM r WHERE r.a = s_suppkey AND b IN (SELECT e FROM c)) AS relations FROM supplier JOIN c ON e = s_suppkey""")
def q63(spark, d):
    suppliers = table(spark, d, "supplier")
    mentions = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("section"))
    after = F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    relations = suppliers.select(F.col("s_suppkey").alias("src_entity"), after.alias("dst_entity")).filter("dst_entity is not null")
    kept, left = K.recount(suppliers.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name")), mentions, relations)
    return kept.join(left.groupBy(F.col("src_entity").alias("entity_id")).agg(F.count("*").alias("relations")), "entity_id", "left").fillna(0, ["relations"])


def steps(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("process_id"), F.col("turn").alias("line_start"), F.lit(1).alias("ordinal"), F.col("role"), F.length("text").alias("chars"))


@query("q64_ordered_steps", """
WITH r AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS roles FROM conversations GROUP BY conv_id)
SELECT conv_id AS process_id, turn AS line_start, role, length(text)::INT AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS number, roles FROM conversations JOIN r USING (conv_id)""")
def q64(spark, d):
    rows = steps(spark, d)
    return K.ordered_steps(rows).join(K.process_roles(rows), "process_id").select("process_id", "line_start", "role", F.col("chars").cast("int").alias("chars"), "number", "roles")


@query("q65_system_windows", r"""
WITH y AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS system FROM part), s AS (SELECT p_partkey, p_name, p_type FROM part)
SELECT p_partkey, system FROM s JOIN y ON list_contains(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> ''), system)
 OR list_contains(list_concat(list_transform(range(1, len(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'))), lambda i: array_to_string(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+')[i:i + 1], '')), []), system)
WHERE length(system) >= 3""")
def q65(spark, d):
    parts = table(spark, d, "part")
    systems = parts.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("system")).distinct()
    # a small file of many names is few tasks: the windows are made in more, and what is found stays where its part is
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() * WINDOWS // PART_ROWS))
    symbols = parts.select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("name")).repartition(many, "p_partkey")
    return K.system_matches(systems, symbols).select("p_partkey", "system").distinct()


@query("q66_process_page", """
WITH p AS (SELECT conv_id, count(*) AS mentions FROM conversations GROUP BY conv_id), g AS (SELECT *, (SELECT count(*) FROM p) AS total FROM p ORDER BY mentions, conv_id LIMIT 20 OFFSET 40)
SELECT g.conv_id AS process_id, g.mentions, total, sum(length(text))::BIGINT AS chars FROM g JOIN conversations AS c ON c.conv_id = g.conv_id GROUP BY ALL""")
def q66(spark, d):
    rows = steps(spark, d)
    paged = K.page(rows.groupBy("process_id").agg(F.count("*").alias("mentions")), 40, 20, "mentions", "process_id")
    # the page is cut before its steps are read
    return rows.join(F.broadcast(paged), "process_id").groupBy("process_id", "mentions", "total").agg(F.sum("chars").alias("chars"))


@query("q67_either_end", f"""
WITH {OVERLAY} SELECT relation_id, src_entity, dst_entity, coalesce(a.c_name, '') AS src_name, coalesce(b.c_name, '') AS dst_name FROM re LEFT JOIN customer AS a ON a.c_custkey = src_entity LEFT JOIN customer AS b ON b.c_custkey = dst_entity WHERE src_entity = 7 OR dst_entity = 7""")
def q67(spark, d):
    _, relations = customers(spark, d)
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    return K.named_relations(K.relations_of(relations, 7), names).select("relation_id", "src_entity", "dst_entity", "src_name", "dst_name")


@query("q68_match_entities", """
WITH e AS (SELECT p_name AS norm_name, min(p_partkey) AS entity_id, count(*) AS mentions FROM part GROUP BY p_name),
m AS (SELECT *, CASE WHEN norm_name = 'hot gear' THEN 0 WHEN instr(' the blue bolt and a red widget ', ' ' || norm_name || ' ') > 0 THEN 1 END AS class, CASE WHEN norm_name = 'hot gear' THEN 0 ELSE instr(' the blue bolt and a red widget ', ' ' || norm_name || ' ') END AS pos FROM e)
SELECT entity_id, norm_name, mentions, class FROM m WHERE class IS NOT NULL ORDER BY class, pos, mentions DESC, entity_id LIMIT 10""")
def q68(spark, d):
    rows = table(spark, d, "part").groupBy(norm_name(F.col("p_name")).alias("norm_name")).agg(F.min("p_partkey").alias("entity_id"), F.count("*").alias("mentions"))
    return K.match_entities(rows, "The blue bolt, and a RED widget?", ["Hot  gear."]).select("entity_id", "norm_name", "mentions", "class")


@query("q69_description_fold", """
SELECT s_nationkey, left(string_agg(x, '; ' ORDER BY k), 120) AS description FROM (SELECT s_nationkey, floor(s_acctbal / 1000)::INT::VARCHAR AS x, min(s_suppkey) AS k FROM supplier GROUP BY ALL) GROUP BY s_nationkey""")
def q69(spark, d):
    rows = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.floor(F.col("s_acctbal") / 1000).cast("int").cast("string").alias("x"))
    return K.first_parts(rows, ["s_nationkey"], "x", "s_suppkey", most=120).select("s_nationkey", extend_description(F.col("parts"), 120).alias("description"))


def told_steps(spark, d):
    """Turns as extracted steps of sections: what is said is a step, who says it a role, its first word a system."""
    rows = table(spark, d, "conversations")
    return rows.select(F.col("conv_id").alias("section"), F.concat(F.lit("Process "), F.col("conv_id") % 40).alias("process"), F.col("turn").cast("int").alias("ordinal"), "text", "role", F.array(F.substring("text", 1, 3)).alias("systems"))


@query("q77_normalised_steps", r"""
WITH t AS (SELECT conv_id AS section, 'Process ' || conv_id % 40 AS process, turn, role, left(trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F-\x9F]', '', 'g'), '\s+', ' ', 'g')), 300) AS text FROM conversations)
SELECT section, process, row_number() OVER (PARTITION BY section, process ORDER BY turn)::INT AS ordinal, role, text FROM t WHERE text <> ''""")
def q77(spark, d):
    return K.normalise_steps(told_steps(spark, d)).select("section", "process", "ordinal", "role", "text")


PREFERRED = """
m AS (SELECT conv_id AS section, role AS norm, turn % 2 AS kind FROM conversations), e AS (SELECT DISTINCT norm || kind AS entity_id, norm, CASE kind WHEN 0 THEN 'role' ELSE 'system' END AS type FROM m),
mt AS (SELECT DISTINCT section, norm || kind AS entity_id FROM m)"""


@query("q78_preferred_mention", f"""
WITH {PREFERRED}, w AS (SELECT DISTINCT section, norm, CASE WHEN section % 2 = 0 THEN 'role' ELSE 'system' END AS type FROM m),
r AS (SELECT w.*, e.entity_id, row_number() OVER (PARTITION BY w.section, w.norm, w.type ORDER BY e.type = w.type DESC, e.entity_id) AS k FROM w JOIN mt ON mt.section = w.section JOIN e ON e.entity_id = mt.entity_id AND e.norm = w.norm)
SELECT section, norm, type, entity_id FROM r WHERE k = 1""")
def q78(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("section"), F.col("role").alias("norm"), (F.col("turn") % 2).alias("kind")).withColumn("entity_id", F.concat("norm", F.col("kind")))
    entities = rows.select("entity_id", F.col("norm").alias("norm_name"), F.when(F.col("kind") == 0, "role").otherwise("system").alias("type")).distinct()
    wanted = rows.select("section", "norm", F.when(F.col("section") % 2 == 0, "role").otherwise("system").alias("type"))
    return K.preferred(rows.select("section", "entity_id"), entities, wanted)


@query("q79_texts_to_embed", """
WITH t AS (SELECT p_name || ': ' || p_type AS text FROM part UNION SELECT c_name || ' → ' || n_name || CASE WHEN c_mktsegment <> 'BUILDING' THEN ': ' || c_mktsegment ELSE '' END FROM customer JOIN nation ON n_nationkey = c_nationkey),
h AS (SELECT text, sha256(text) AS hash FROM t) SELECT hash, text FROM h WHERE hash NOT IN (SELECT sha256(p_name || ': ' || p_type) FROM part WHERE p_partkey % 3 = 0)""")
def q79(spark, d):
    parts = table(spark, d, "part")
    entities = parts.select(F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dst_name"))
    relations = table(spark, d, "customer").join(nations, "c_nationkey").select(F.col("c_name").alias("src_name"), "dst_name", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("").alias("description"))
    known = parts.filter("p_partkey % 3 = 0").select(F.sha2(F.concat_ws(": ", "p_name", "p_type"), 256).alias("hash"))
    return K.texts_to_embed(entities, relations, known)
