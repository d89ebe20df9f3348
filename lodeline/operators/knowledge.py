"""Entities, relations and process steps extracted from sections: applying, matching, paging and read models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.operators.vectors import ENTITY_K, SEMANTIC_K, THEME_K, knn, knn_many
from lodeline.storage import settle, small
from lodeline.functions.text import clean, extend_description, norm_name, normalise_system, split_identifier, token_windows

#: The closed list of entity types, and words that no query matches as an entity.
ENTITY_TYPES = ("person", "organisation", "system", "concept", "event", "place", "document", "process", "role")
ENTITY_STOPWORDS = tuple(
    "the a an and or of to in on at by for with from as is are was were be it its this that these those i you he she we they me him her us them my your our their not no".split()
)
NAME_MAX, DESCRIPTION_MAX, STEP_MAX, STEPS_MAX = 80, 300, 300, 30
RELATIONS_SHOWN, VIA_STEP_MAX, LINK_LIMIT, MIN_SYSTEM = 30, 5, 3, 3
OVERLAY_MAX, SEARCH_MAX = 500, 20
#: Systems that a broadcast may hold.
BROADCAST_SYSTEMS = 100_000
ENTITY_MIN = 0.5
#: Matched entities that are broadcast.
SHOWN_ENTITIES = 10_000


def entity_type(kind: Column) -> Column:
    return F.when(F.lower(F.trim(kind)).isin(*ENTITY_TYPES), F.lower(F.trim(kind))).otherwise("concept")


def normalise_entities(rows: DataFrame) -> DataFrame:
    """Extracted (section, ordinal, name, type, description) cleaned; names without a letter or digit go."""
    out = rows.withColumn("name", clean(F.col("name"), NAME_MAX)).withColumn("type", entity_type(F.col("type"))).withColumn("description", clean(F.coalesce("description", F.lit("")), DESCRIPTION_MAX))
    return out.filter(F.col("name").rlike("[\\p{L}\\p{N}]")).withColumn("norm_name", norm_name(F.col("name")))


def normalise_relations(rows: DataFrame) -> DataFrame:
    """(section, source, target, description) by normalised ends; relations to oneself or without an end go."""
    out = rows.withColumn("source", norm_name(F.col("source"))).withColumn("target", norm_name(F.col("target"))).withColumn("description", clean(F.coalesce("description", F.lit("")), DESCRIPTION_MAX))
    return out.filter("source <> '' and target <> '' and source <> target")


def first_parts(rows: DataFrame, keys: list[str], column: str, *order: str, most: int = DESCRIPTION_MAX) -> DataFrame:
    """``keys, parts``: the first texts of a group in order, each once, as many as ``most`` characters can hold.

    A text and its separator take three characters at least, so a group of any size leaves a bounded list; equal texts
    are merged by partial aggregation before anything is ordered.
    """
    said = rows.filter(F.col(column) != "").groupBy(*keys, column).agg(F.min(F.struct(*order)).alias("_o"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_o", column))
    few = said.withColumn("_p", place).filter(F.col("_p") <= most // 3 + 1)
    return few.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.col(column).alias("d")))), lambda x: x["d"]).alias("parts"))


def merge_entities(rows: DataFrame, *order: str) -> DataFrame:
    """One row per norm_name: first name and type in order (``process`` wins), descriptions folded, sections counted."""
    key = F.struct(*order)
    kind = F.when(F.bool_or(F.col("type") == "process"), "process").otherwise(F.min_by("type", key))
    whole = rows.groupBy("norm_name").agg(F.min_by("name", key).alias("name"), kind.alias("type"), F.count_distinct("section").alias("mentions"))
    parts = first_parts(rows, ["norm_name"], "description", *order).withColumnRenamed("norm_name", "_norm")
    met = whole.join(parts, F.col("norm_name").eqNullSafe(F.col("_norm")), "left")
    return met.select("norm_name", "name", "type", F.coalesce(extend_description(F.col("parts")), F.lit("")).alias("description"), "mentions")


def apply_extraction(entities: DataFrame, relations: DataFrame, *order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables (entities, mentions, relations) of extracted rows; a relation's ends must be known entities. Idempotent."""
    clean_rows = normalise_entities(entities)
    merged = merge_entities(clean_rows, *order).withColumn("entity_id", F.xxhash64("norm_name"))
    mentions = clean_rows.select(F.xxhash64("norm_name").alias("entity_id"), "section").distinct()
    ends = normalise_relations(relations)
    known = merged.select("entity_id", "norm_name")
    out = ends.join(known.select(F.col("entity_id").alias("src_entity"), F.col("norm_name").alias("source")), "source").join(known.select(F.col("entity_id").alias("dst_entity"), F.col("norm_name").alias("target")), "target")
    return merged, mentions, out.select("src_entity", "dst_entity", "description", "section").distinct()


def recount(entities: DataFrame, mentions: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions counted anew; entities without any go, and their relations with them."""
    counted = mentions.distinct().groupBy("entity_id").agg(F.count("*").alias("mentions"))
    kept = entities.drop("mentions").join(counted, "entity_id")
    ids = kept.select("entity_id")
    left = relations.join(ids.withColumnRenamed("entity_id", "src_entity"), "src_entity", "left_semi").join(ids.withColumnRenamed("entity_id", "dst_entity"), "dst_entity", "left_semi")
    return kept, left


def matchable(norm: Column) -> Column:
    return (F.length(norm) >= 3) & ~norm.isin(*ENTITY_STOPWORDS)


def match_entities(entities: DataFrame, query: str, arguments: list[str] = (), similar: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Entities that arguments name, then those the query holds as a phrase, then similar ones (entity_id, similarity).

    Each once, by its first class; inside a class by argument or place in the query or similarity, then mentions, id.
    """
    given = [" ".join(a.lower().split()).rstrip(".,;:!?").strip() for a in arguments]
    order = F.coalesce(*[F.when(F.col("norm_name") == a, F.lit(float(i))) for i, a in enumerate(given)], F.lit(None).cast("double"))
    asked = F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.lower(F.lit(query)), "[^\\p{L}\\p{N}]+"), lambda x: x != ""), " "), F.lit(" "))
    flat = F.concat(F.lit(" "), F.array_join(F.filter(F.split("norm_name", "[^\\p{L}\\p{N}]+"), lambda x: x != ""), " "), F.lit(" "))
    place = F.when(matchable(F.col("norm_name")) & (F.trim(flat) != ""), F.nullif(F.instr(asked, flat), F.lit(0)).cast("double"))
    rows = entities.withColumn("_a", order).withColumn("_p", place)
    if similar is not None:
        rows = rows.join(similar.filter(F.col("similarity") >= ENTITY_MIN).select("entity_id", F.col("similarity").alias("_s")), "entity_id", "left")
    else:
        rows = rows.withColumn("_s", F.lit(None).cast("double"))
    rows = rows.filter("_a is not null or _p is not null or _s is not null")
    kind = F.when(F.col("_a").isNotNull(), 0).when(F.col("_p").isNotNull(), 1).otherwise(2)
    inside = F.when(kind == 0, F.col("_a")).when(kind == 1, F.col("_p")).otherwise(-F.col("_s"))
    return rows.withColumn("class", kind).withColumn("_in", inside).orderBy("class", "_in", F.desc("mentions"), "entity_id").limit(limit).drop("_a", "_p", "_s", "_in")


def overlay(entities: DataFrame, relations: DataFrame, most: int = OVERLAY_MAX) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The top entities by mentions, relations among them, and whether any were left out."""
    top = entities.orderBy(F.desc("mentions"), "name", "entity_id").limit(most)
    ids = small(top.select("entity_id"), OVERLAY_MAX)
    inside = relations.join(ids, F.col("src_entity") == F.col("entity_id"), "left_semi").join(ids, F.col("dst_entity") == F.col("entity_id"), "left_semi")
    return top, inside, entities.limit(most + 1).agg((F.count("*") > most).alias("truncated"))


def search(entities: DataFrame, text: str, most: int = SEARCH_MAX) -> DataFrame:
    """The exact name first, then names that start so, by mentions."""
    want = text.lower()
    hit = F.lower("name").startswith(want)
    return entities.filter(hit).withColumn("exact", (F.lower("name") == want).cast("int")).orderBy(F.desc("exact"), F.desc("mentions"), "name", "entity_id").limit(most)


def relations_of(relations: DataFrame, entity) -> DataFrame:
    """Relations with the entity at either end, as the union of two equalities."""
    return relations.filter(F.col("src_entity") == entity).union(relations.filter((F.col("dst_entity") == entity) & (F.col("src_entity") != entity)))


def named_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with the names of their ends, where known."""
    names = entities.select("entity_id", "name")
    a, b = names.toDF("src_entity", "src_name"), names.toDF("dst_entity", "dst_name")
    return relations.join(a, "src_entity", "left").join(b, "dst_entity", "left").withColumn("src_name", F.coalesce("src_name", F.lit(""))).withColumn("dst_name", F.coalesce("dst_name", F.lit("")))


def shown_relations(relations: DataFrame, order: DataFrame, most: int = RELATIONS_SHOWN) -> DataFrame:
    """Of matched entities in order (entity_id, place): each relation under its first entity, ``most`` in all."""
    ends = relations.select("*", F.explode(F.array("src_entity", "dst_entity")).alias("entity_id")).join(small(order, SHOWN_ENTITIES), "entity_id")
    first = ends.withColumn("_r", F.row_number().over(Window.partitionBy("relation_id").orderBy("place"))).filter("_r = 1").drop("_r")
    return first.orderBy("place", "relation_id").limit(most)


def ordered_steps(steps: DataFrame) -> DataFrame:
    """Steps (process_id, line_start, ordinal, text, …) numbered across sections by line, then ordinal."""
    return steps.withColumn("number", F.row_number().over(Window.partitionBy("process_id").orderBy("line_start", "ordinal")))


def process_roles(steps: DataFrame) -> DataFrame:
    return steps.filter("role <> ''").groupBy("process_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def page(rows: DataFrame, offset: int, limit: int, *order: str) -> DataFrame:
    """A page in order with the total of all rows; the limit stands before anything that is joined to the page."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def system_matches(systems: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols one of whose token windows spells a system's name: an equality on exploded windows, not a pair test.

    Few words make up most windows, so they are not shuffled by word: systems of a checked size are broadcast.
    """
    norm = settle(systems.withColumn("norm", normalise_system(F.col("system"))).filter(F.length("norm") >= MIN_SYSTEM), "systems")
    norm = small(norm, BROADCAST_SYSTEMS, F.octet_length("norm") + F.octet_length("system"))
    windows = symbols.withColumn("norm", F.explode(token_windows(split_identifier(F.col("name")))))
    return windows.join(norm, "norm").drop("norm").distinct()


def implemented_by(section_links: DataFrame, system_links: DataFrame, most: int = LINK_LIMIT) -> DataFrame:
    """Code of each step (step, symbol_id, path, name, referrers): section mentions first, then systems by referrers."""
    both = section_links.withColumn("class", F.lit(0)).unionByName(system_links.withColumn("class", F.lit(1)))
    once = both.withColumn("_r", F.row_number().over(Window.partitionBy("step", "symbol_id").orderBy("class"))).filter("_r = 1").drop("_r")
    w = Window.partitionBy("step")
    ranked = once.withColumn("place", F.row_number().over(w.orderBy("class", F.desc("referrers"), "path", "name"))).withColumn("more", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return ranked.filter(F.col("place") <= most)


def process_hops(processes: DataFrame, steps: DataFrame, systems: DataFrame, matched: DataFrame, most: int = VIA_STEP_MAX) -> DataFrame:
    """Processes (rows of entities) that a matched entity acts in or is touched by, by mentions; none that is matched itself."""
    acts = steps.join(matched.withColumnRenamed("entity_id", "role_id"), "role_id", "left_semi").select("process_id")
    touched = steps.join(systems.join(matched, "entity_id", "left_semi").select("step_id"), "step_id", "left_semi").select("process_id")
    ids = acts.union(touched).distinct().join(matched.withColumnRenamed("entity_id", "process_id"), "process_id", "left_anti")
    return processes.join(ids.withColumnRenamed("process_id", "entity_id"), "entity_id", "left_semi").orderBy(F.desc("mentions"), "entity_id").limit(most)


def entity_detail(entity, entities: DataFrame, relations: DataFrame, mentions: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One entity's row, its relations with the names of their ends, and the sections that mention it in document order.

    ``sections``: section, path, name, line_start, line_end.
    """
    own = entities.filter(F.col("entity_id") == entity)
    said = named_relations(relations_of(relations, entity), entities)
    told = sections.join(mentions.filter(F.col("entity_id") == entity).select("section").distinct(), "section").orderBy("path", "line_start", "section")
    return own, said, told


# --- from extracted rows to tables


def normalise_steps(rows: DataFrame) -> DataFrame:
    """Extracted steps (section, process, ordinal, text, role, systems) cleaned and numbered anew: empty ones go, the first
    STEPS_MAX of a section stay, texts and names have their caps."""
    cut = rows.withColumn("process", clean(F.col("process"), NAME_MAX)).withColumn("text", clean(F.coalesce("text", F.lit("")), STEP_MAX)).withColumn("role", clean(F.coalesce("role", F.lit("")), NAME_MAX))
    names = F.transform(F.coalesce("systems", F.array().cast("array<string>")), lambda x: clean(x, NAME_MAX))
    cut = cut.withColumn("systems", F.array_distinct(F.filter(names, lambda x: x != ""))).filter("text <> '' and process <> ''")
    place = F.row_number().over(Window.partitionBy("section", "process").orderBy("ordinal"))
    return cut.withColumn("ordinal", place).filter(F.col("ordinal") <= STEPS_MAX)


def preferred(mentions: DataFrame, entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (section, norm, type) the entity that the section mentions by that name, one of that type first."""
    named = mentions.select("section", "entity_id").distinct().join(entities.select("entity_id", F.col("norm_name").alias("norm"), F.col("type").alias("_type")), "entity_id")
    met = wanted.select("section", "norm", "type").distinct().join(named, ["section", "norm"])
    place = F.row_number().over(Window.partitionBy("section", "norm", "type").orderBy((F.col("_type") == F.col("type")).desc(), "entity_id"))
    return met.withColumn("_p", place).filter("_p = 1").select("section", "norm", "type", "entity_id")


def apply_steps(steps: DataFrame, entities: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables (entities, steps, step systems) of normalised steps: a process is found by its name or made, and has that
    type; roles and systems are resolved inside the step's own section."""
    named = steps.withColumn("norm_name", norm_name(F.col("process")))
    made = named.groupBy("norm_name").agg(F.min_by("process", F.struct("section", "ordinal")).alias("_name"), F.count_distinct("section").alias("_sections"))
    both = entities.join(made, "norm_name", "full_outer")
    found = F.col("_name").isNotNull()
    out = both.select(
        F.coalesce("entity_id", F.xxhash64("norm_name")).alias("entity_id"), "norm_name", F.coalesce("name", "_name").alias("name"), F.when(found, "process").otherwise(F.col("type")).alias("type"),
        F.coalesce("description", F.lit("")).alias("description"), F.coalesce("mentions", "_sections").alias("mentions"),
    )
    rows = named.select(F.xxhash64("norm_name").alias("_made"), "norm_name", "section", "ordinal", "text", "role", "systems")
    rows = rows.join(out.select(F.col("entity_id").alias("process_id"), "norm_name"), "norm_name").drop("_made", "norm_name")
    rows = rows.withColumn("step_id", F.xxhash64("process_id", "section", "ordinal"))
    roles = preferred(mentions, out, rows.filter("role <> ''").select("section", norm_name(F.col("role")).alias("norm"), F.lit("role").alias("type"))).select("section", F.col("norm").alias("_role"), F.col("entity_id").alias("role_id"))
    placed = rows.withColumn("_role", norm_name(F.col("role"))).join(roles, ["section", "_role"], "left").drop("_role")
    each = placed.select("step_id", "section", F.posexplode("systems").alias("place", "system")).withColumn("norm", norm_name(F.col("system")))
    met = preferred(mentions, out, each.select("section", "norm", F.lit("system").alias("type"))).drop("type")
    systems = each.join(met, ["section", "norm"], "left").select("step_id", "place", "system", "entity_id")
    return out, placed.select("step_id", "process_id", "section", "ordinal", "text", "role", "role_id"), systems


# --- vectors of texts


def texts_to_embed(entities: DataFrame, relations: DataFrame, known: DataFrame) -> DataFrame:
    """``hash, text`` of entities and named relations that ``known`` (hash) lacks, each text once."""
    one = entities.select(F.concat_ws(": ", "name", F.nullif("description", F.lit(""))).alias("text"))
    two = relations.select(F.concat(F.concat_ws(" → ", "src_name", "dst_name"), F.when(F.col("description") != "", F.concat(F.lit(": "), "description")).otherwise(F.lit(""))).alias("text"))
    texts = one.unionByName(two).distinct().withColumn("hash", F.sha2("text", 256))
    return texts.join(known.select("hash").distinct(), "hash", "left_anti").select("hash", "text")


def lacking(rows: DataFrame, vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` that have a vector, and those that lack one."""
    ids = vectors.select(key).distinct()
    return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti")


def embedded(texts: DataFrame, cache: DataFrame, model: str, dim: int, embed, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``hash, vector`` of ``texts`` (hash, text), and the rows that the cache (hash, model, vector) gains.

    A cached vector counts for its model and dimension alone. What is missed, at most ``most`` texts, goes to ``embed``: a
    function of a table (hash, text) to a table (hash, vector), such as a mapInArrow over batches.
    """
    good = cache.filter((F.col("model") == model) & (F.size("vector") == dim)).select("hash", "vector")
    asked = texts.select("hash", "text").dropDuplicates(["hash"])
    hits, misses = asked.join(good.dropDuplicates(["hash"]), "hash").select("hash", "vector"), asked.join(good, "hash", "left_anti")
    fresh = embed(misses.orderBy("hash").limit(most) if most is not None else misses).select("hash", "vector").filter(F.size("vector") == dim)
    return hits.unionByName(fresh), fresh.select("hash", F.lit(model).alias("model"), "vector")


# --- what knowledge says of a question


def section_links(steps: DataFrame, section_refs: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Code that a step's own section mentions: (step, symbol_id, path, name, referrers). ``section_refs``: section, name;
    ``symbols``: symbol_id, path, name of code; ``refs``: path, name."""
    by = refs.groupBy("name").agg(F.count_distinct("path").alias("referrers"))
    met = steps.select(F.col("step_id").alias("step"), "section").join(section_refs.select("section", "name").distinct(), "section").join(symbols.select("symbol_id", "path", "name"), "name")
    return met.join(by, "name", "left").select("step", "symbol_id", "path", "name", F.coalesce("referrers", F.lit(0)).alias("referrers"))


def system_links(step_systems: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Code whose name spells a step's system: (step, symbol_id, path, name, referrers, system)."""
    by = refs.groupBy("name").agg(F.count_distinct("path").alias("referrers"))
    met = system_matches(step_systems.select("system").distinct(), symbols.select("symbol_id", "path", "name"))
    rows = step_systems.select(F.col("step_id").alias("step"), "system").distinct().join(met, "system").join(by, "name", "left")
    return rows.select("step", "symbol_id", "path", "name", F.coalesce("referrers", F.lit(0)).alias("referrers"), "system")


def implements_seeds(matched: DataFrame, steps: DataFrame, step_systems: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """``symbol_id, name, place``: code of the systems of matched processes' steps, LINK_LIMIT a step, system by system."""
    own = steps.join(matched.filter("type = 'process'").select(F.col("entity_id").alias("process_id"), "place"), "process_id").select("step_id", "place", "ordinal")
    links = system_links(step_systems.join(own.select("step_id").distinct(), "step_id", "left_semi"), symbols, refs)
    rank = F.row_number().over(Window.partitionBy("step").orderBy(F.desc("referrers"), "path", "name", "system"))
    few = links.withColumn("_r", rank).filter(F.col("_r") <= LINK_LIMIT).join(own, F.col("step") == F.col("step_id"))
    return few.groupBy("symbol_id", F.col("system").alias("name")).agg(F.min(F.struct("place", "ordinal", "_r")).alias("_o")).withColumn("place", F.row_number().over(Window.partitionBy("symbol_id").orderBy("_o"))).select("symbol_id", "name", "place")


def entity_seeds(matched: DataFrame, mentions: DataFrame) -> DataFrame:
    """``symbol_id, name, place``: the sections that mention matched entities (entity_id, name, place)."""
    return mentions.join(small(matched.select("entity_id", "name", "place"), SHOWN_ENTITIES), "entity_id").select(F.col("section").alias("symbol_id"), "name", "place").distinct()


def semantic_seeds(section_vectors: DataFrame, query: list[float] | None, k: int = SEMANTIC_K) -> DataFrame | None:
    """``symbol_id, similarity`` of the sections nearest to the question, those on its side alone."""
    return None if query is None else knn(section_vectors, "symbol_id", "vector", query, k).filter("similarity > 0")


def theme_seeds(relation_vectors: DataFrame, relations: DataFrame, themes: DataFrame, k: int = THEME_K) -> DataFrame:
    """``symbol_id, similarity``: sections of the relations nearest to each theme (query, vector), the best of each."""
    near = knn_many(relation_vectors, "relation_id", "vector", themes, k).filter("similarity > 0")
    return near.join(relations.select("relation_id", "section"), "relation_id").groupBy(F.col("section").alias("symbol_id")).agg(F.max("similarity").alias("similarity"))


def similar_entities(entity_vectors: DataFrame, query: list[float] | None, k: int = ENTITY_K) -> DataFrame | None:
    return None if query is None else knn(entity_vectors, "entity_id", "vector", query, k)


def entities_answer(matched: DataFrame, knowledge: dict[str, DataFrame], sections: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """What is told of matched entities (entity_id, place) and of the processes their steps lead to, a row each.

    ``knowledge``: entities, mentions, relations (relation_id, src_entity, dst_entity, description, section), steps and
    systems as ``apply_steps`` gives them; ``sections``: section, path, name, line_start, line_end; ``links``: code of
    steps as ``implemented_by`` gives it. Sections stand in document order; a relation under its first entity; steps of
    processes by line; processes reached through a step come after the matched ones.
    """
    entities, steps = knowledge["entities"], knowledge["steps"]
    order = matched.select("entity_id", "place")
    reached = process_hops(entities, steps, knowledge["systems"], order.select("entity_id"))
    last = F.lit(1_000_000)
    hops = reached.select("entity_id", (last + F.row_number().over(Window.orderBy(F.desc("mentions"), "entity_id"))).cast("int").alias("place"))
    every = small(order.select("entity_id", F.col("place").cast("int").alias("place"), F.lit(False).alias("via_step")).unionByName(hops.withColumn("via_step", F.lit(True))), SHOWN_ENTITIES)
    told = knowledge["mentions"].join(every.select("entity_id"), "entity_id", "left_semi").select("entity_id", "section").distinct().join(sections, "section")
    told = told.groupBy("entity_id").agg(F.array_sort(F.collect_set(F.struct("path", "line_start", "name", "line_end"))).alias("_s"))
    told = told.select("entity_id", F.transform("_s", lambda x: F.struct(x["path"].alias("path"), x["name"].alias("name"), x["line_start"].alias("line_start"), x["line_end"].alias("line_end"))).alias("sections"))
    named = named_relations(knowledge["relations"], entities).join(sections, "section")
    shown = shown_relations(named, every.filter("not via_step").select("entity_id", "place"))
    said = shown.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("relation_id", F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "description", "path", F.col("name"), "line_start", "line_end"))).alias("relations"))
    own = steps.join(every.select(F.col("entity_id").alias("process_id")), "process_id", "left_semi").join(sections, "section")
    own = own.join(knowledge["systems"].groupBy("step_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "system"))), lambda x: x["system"]).alias("systems")), "step_id", "left")
    if links is None:
        own = own.withColumn("code", F.array().cast("array<struct<place: int, path: string, name: string>>")).withColumn("more", F.lit(0).cast("long"))
    else:
        code = links.groupBy(F.col("step").alias("step_id")).agg(F.array_sort(F.collect_list(F.struct("place", "path", "name"))).alias("code"), F.max("more").alias("more"))
        own = own.join(code, "step_id", "left")
    own = ordered_steps(own)
    acts = own.groupBy(F.col("process_id").alias("entity_id")).agg(F.array_sort(F.collect_list(F.struct("number", "text", "role", "systems", "path", "name", "code", "more"))).alias("steps"))
    rows = entities.join(every, "entity_id").join(told, "entity_id", "left").join(said, "entity_id", "left").join(acts, "entity_id", "left")
    return rows.select("place", "entity_id", "name", "type", "description", "mentions", "via_step", "sections", "relations", F.when(F.col("type") == "process", F.col("steps")).alias("steps")).orderBy("place")
