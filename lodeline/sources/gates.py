"""Content gates and the extractions that plain expressions can do."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.secrets import secret_rule
from lodeline.functions.text import language, language_class

MAX_FILE_BYTES = 1 << 20
MAX_DOCUMENT_BYTES = 256 << 10
MINIFIED_LINE = 500
BINARY_HEAD = 8192
SIGNATURE_MAX = 160
#: Files that tools write, and paths that are never read.
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "bun.lock", "bun.lockb", "composer.lock", "Gemfile.lock", "poetry.lock")
DENY = (".env*", "*.pem", "*.key", "id_rsa*", "*.p12", "*.pfx", ".npmrc", ".netrc", "*.tfstate", "secrets/", "credentials*")


def glob_regex(pattern: str) -> str:
    """A deny pattern as a regular expression on whole relative paths: ``dir/`` anything below, else a name anywhere."""
    below = pattern.endswith("/")
    name = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in pattern.rstrip("/"))
    return f"(?:^|.*/){name}/.*" if below else f"(?:^|.*/){name}"


def denied(path: Column, more: tuple[str, ...] = ()) -> Column:
    """The built-in patterns and more; the list only grows."""
    return path.rlike("^(?:" + "|".join(glob_regex(p) for p in (*DENY, *more)) + ")$")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n")) - F.when(text.endswith("\n") | (text == ""), 1).otherwise(0)


def document_reason(path: Column, size: Column, text: Column) -> Column:
    """Why a document is skipped, else null; average line lengths are bytes by lines."""
    minified = F.floor(F.octet_length(text) / F.greatest(line_count(text), F.lit(1))) > MINIFIED_LINE
    return F.when(basename(path).isin(*LOCKFILES), "lockfile").when(size > MAX_DOCUMENT_BYTES, "too-large").when(minified, "minified")


def name_reason(path: Column, size: Column) -> Column:
    """Why a file is skipped that its path and size tell of, before it is read; else null."""
    return F.when(denied(path), "denylisted").when(size > MAX_FILE_BYTES, "too-large").when(basename(path).isin(*LOCKFILES), "lockfile").when(language(path).isNull(), "unsupported-language")


def gate(files: DataFrame) -> DataFrame:
    """``files`` (path, content binary, size) with lang, text and skipped_reason, first reason first."""
    rows = files.withColumn("lang", language(F.col("path")))
    head = F.substring("content", 1, BINARY_HEAD)
    rows = rows.withColumn("_text", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")))
    kind = language_class(F.col("lang"))
    reason = (
        F.when(name_reason(F.col("path"), F.col("size")).isNotNull(), name_reason(F.col("path"), F.col("size")))
        .when(F.contains(head, F.lit(b"\x00")), "binary").when(F.col("_text").isNull(), "not-utf8")
        .when((kind == "document") & document_reason(F.col("path"), F.col("size"), F.col("_text")).isNotNull(), document_reason(F.col("path"), F.col("size"), F.col("_text")))
        .when(secret_rule(F.col("_text")).isNotNull(), "secret-like content")
    )
    rows = rows.withColumn("skipped_reason", reason)
    return rows.withColumn("text", F.when(F.col("skipped_reason").isNull(), F.col("_text"))).drop("_text")


def first_line(text: Column, most: int = SIGNATURE_MAX) -> Column:
    """The first line that is not blank, cut with an ellipsis."""
    line = F.coalesce(F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 0), F.lit(""))
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most - 1)), F.lit("…"))).otherwise(line)


def html_headings(html: Column) -> Column:
    """``array<struct<level, heading>>`` of headings with text, tags and the commonest references resolved."""
    pattern = F.lit("(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>")

    def plain(x: Column) -> Column:
        text = F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), "\\s+", " "))
        return F.replace(F.replace(text, F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"'))

    return F.zip_with(F.regexp_extract_all(html, pattern, 1), F.regexp_extract_all(html, pattern, 2), lambda n, x: F.struct(n.cast("int").alias("level"), plain(x).alias("heading")))


def type_word(schema: Column) -> Column:
    """object, array, string, bool or number, of a variant's schema text."""
    return F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema.startswith("STRING"), "string").when(schema.startswith("BOOLEAN"), "bool").otherwise("number")


def json_keys(rows: DataFrame, column: str) -> DataFrame:
    """``key, type`` of the keys of JSON objects to depth two (``a`` and ``a.b``), never their values."""
    spark = rows.sparkSession
    views = [f"_json_{uuid.uuid4().hex}" for _ in range(2)]
    rows.createOrReplaceTempView(views[0])
    top = spark.sql(f"SELECT k.key, k.value FROM {views[0]}, LATERAL variant_explode({column}) AS k WHERE startswith(schema_of_variant({column}), 'OBJECT')")
    top.createOrReplaceTempView(views[1])
    below = spark.sql(f"SELECT concat(t.key, '.', k.key) AS key, k.value FROM {views[1]} AS t, LATERAL variant_explode(t.value) AS k WHERE startswith(schema_of_variant(t.value), 'OBJECT')")
    both = top.unionByName(below).select("key", type_word(F.schema_of_variant("value")).alias("type"))
    for view in views:  # the plans were made; the names are of no further use
        spark.catalog.dropTempView(view)
    return both
