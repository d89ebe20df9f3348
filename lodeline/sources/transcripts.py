"""Session transcripts of JSON lines, run directories, question and walk files, extraction files."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTRACTION = (
    "map<string, struct<entities: array<struct<name: string, type: string, description: string>>, relations: array<struct<source: string, target: string, description: string>>, "
    "steps: struct<process: string, steps: array<struct<text: string, role: string, systems: array<string>>>>>>"
)


def events(lines: DataFrame) -> DataFrame:
    """``session, line_no, v`` with v a variant, null for a line that is not JSON."""
    return lines.withColumn("v", F.try_parse_json("line"))


def sessions(lines: DataFrame, answer_tool: str = "StructuredOutput") -> DataFrame:
    """One row per session: model, bad lines, tool calls by name, denied tools, tokens, cost, turns, duration, error."""
    rows = events(lines)
    kind = F.try_variant_get("v", "$.type", "string")
    rows = rows.withColumn("kind", kind)
    parts = F.from_json(F.to_json(F.try_variant_get("v", "$.message.content", "variant")), "array<struct<type: string, name: string>>")
    used = rows.filter("kind = 'assistant'").select("session", F.explode(parts).alias("p")).filter((F.col("p.type") == "tool_use") & (F.col("p.name") != answer_tool))
    calls = used.groupBy("session", F.col("p.name").alias("tool")).agg(F.count("*").alias("n"))
    calls = calls.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tool_calls"), F.sum("n").alias("calls"))

    def get(path: str, as_: str):
        return F.max_by(F.try_variant_get("v", path, as_), F.when(F.col("kind") == "result", F.col("line_no")))

    whole = rows.groupBy("session").agg(
        F.max(F.when(F.col("kind") == "system", F.try_variant_get("v", "$.model", "string"))).alias("model"), F.count_if(F.col("v").isNull() & (F.trim("line") != "")).alias("bad_lines"),
        get("$.usage.input_tokens", "long").alias("input"), get("$.usage.output_tokens", "long").alias("output"), get("$.usage.cache_creation_input_tokens", "long").alias("cache_creation"), get("$.usage.cache_read_input_tokens", "long").alias("cache_read"),
        get("$.total_cost_usd", "double").alias("cost_usd"), get("$.num_turns", "long").alias("turns"), get("$.duration_ms", "long").alias("duration_ms"), get("$.subtype", "string").alias("outcome"), get("$.structured_output.symbols", "array<string>").alias("answer"),
    )
    return whole.join(calls, "session", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))


def run_records(spark: SparkSession, place: str) -> DataFrame:
    """Records ``<condition>/<question>-<repeat>.json`` of a run directory; other files are passed over."""
    rows = spark.read.option("recursiveFileLookup", True).option("multiLine", True).json(place).withColumn("_file", F.input_file_name())
    name = r"([^/]+)/([^/]+)-(\d+)\.json$"
    return rows.filter(F.col("_file").rlike(name)).withColumn("condition", F.regexp_extract("_file", name, 1)).withColumn("question", F.regexp_extract("_file", name, 2)).withColumn("repeat", F.regexp_extract("_file", name, 3).cast("int")).drop("_file")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """``id, category, query, gold`` of a question file; ids must be unique and gold of the form path::name."""
    with open(path, "rb") as f:
        rows = [(q["id"], q.get("category", ""), q["query"], q.get("gold", [])) for q in tomllib.load(f).get("question", [])]
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a question's id repeats")
    if bad := [g for r in rows for g in r[3] if "::" not in g]:
        raise ValueError(f"gold without ::: {bad[0]}")
    return spark.createDataFrame(rows, "id string, category string, query string, gold array<string>")


WALK_FIELDS = {"locate": {"query"}, "process": {"query"}, "connection": {"from"}, "change": {"patch"}}


def walks(spark: SparkSession, path: str) -> DataFrame:
    """Scripted paths of a walk file: kinds locate, process, connection and change with the fields each needs."""
    with open(path, "rb") as f:
        found = tomllib.load(f).get("walk", [])
    rows = []
    for w in found:
        lacks = WALK_FIELDS[w["kind"]] - set(w) if w.get("kind") in WALK_FIELDS else {"kind"}
        if lacks or any("::" not in g for g in w.get("gold", [])):
            raise ValueError(f"walk {w.get('id')}: {', '.join(sorted(lacks)) or 'gold without ::'}")
        rows.append((w["id"], w["kind"], w.get("query"), w.get("gold", []), w.get("budget"), w.get("role"), w.get("step_text"), w.get("implemented_by"), w.get("from"), w.get("hops"), w.get("patch")))
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a walk's id repeats")
    return spark.createDataFrame(rows, "id string, kind string, query string, gold array<string>, budget int, role string, step_text string, implemented_by string, from string, hops int, patch string")


def extraction(spark: SparkSession, path: str, sections: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Entities, relations and steps of a checked-in extraction keyed ``path::heading``, and its keys without a section.

    ``sections``: symbol_id, path, name, line_start.
    """
    with open(path, encoding="utf-8") as f:
        text = json.dumps(json.load(f))
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(F.from_json("t", EXTRACTION)).alias("key", "x"))
    rows = rows.withColumn("path", F.split_part("key", F.lit("::"), F.lit(1))).withColumn("name", F.element_at(F.split("key", "::", 2), -1))
    known = rows.join(sections.select(F.col("symbol_id").alias("section"), "path", "name", F.col("line_start").alias("line")), ["path", "name"])
    where = ["section", "path", "line"]
    entities = known.select(*where, F.posexplode("x.entities").alias("ordinal", "e")).select(*where, "ordinal", "e.*")
    relations = known.select(*where, F.posexplode("x.relations").alias("ordinal", "e")).select(*where, "ordinal", "e.*")
    steps = known.filter("x.steps is not null").select(*where, F.col("x.steps.process").alias("process"), F.posexplode(F.slice("x.steps.steps", 1, 30)).alias("at", "e"))
    steps = steps.select(*where, "process", (F.col("at") + 1).alias("ordinal"), "e.*").filter(F.trim("text") != "")
    return {"entities": entities, "relations": relations, "steps": steps}, rows.join(known.select("key"), "key", "left_anti").select("key")
