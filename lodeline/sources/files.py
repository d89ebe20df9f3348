"""Trees of files as tables: workspaces of named roots, ignore rules, gates and extraction.

Trees are listed and pruned folder by folder in tasks (names and stats only); contents are read in parallel by tasks that
see the same file system. A corpus in an object store is read with ``spark.read.format("binaryFile")`` into the same columns.
"""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.sources.extract import EXTRACTED, extract_rows
from lodeline.functions.stem import stemmed_tokens
from lodeline.functions.text import split_identifier
from lodeline.sources.gates import denied, gate, glob_regex, name_reason

#: Directories that are never entered.
PRUNED = (".git", ".lodeline")
ROOT_NAME = re.compile(r"[A-Za-z0-9_-]{1,64}")


@dataclass(frozen=True)
class Workspace:
    """Named roots; a single root without a name gives unprefixed paths."""

    roots: tuple[tuple[str, str], ...]
    deny: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        names, places = [n for n, _ in self.roots], [os.path.realpath(p) for _, p in self.roots]
        if len(names) > 1 and not all(ROOT_NAME.fullmatch(n) for n in names):
            raise ValueError("a root's name has 1 to 64 letters, digits, _ or -")
        if len(set(names)) < len(names):
            raise ValueError("root names repeat")
        for i, a in enumerate(places):
            if any(i != j and (a == b or a.startswith(b + os.sep)) for j, b in enumerate(places)):
                raise ValueError("a root lies inside another")


WORKSPACE_FILE = "workspace.toml"


def open_workspace(folder: str) -> Workspace:
    """The workspace of a folder: the roots ``[[root]]`` (name, path) of its WORKSPACE_FILE and more ``deny`` patterns, or
    the folder itself. Relative paths are taken from the folder; every root must be a folder that is there."""
    path = os.path.join(folder, WORKSPACE_FILE)
    if not os.path.isfile(path):
        return Workspace((("", folder),))
    with open(path, "rb") as f:
        said = tomllib.load(f)
    roots = []
    for k, r in enumerate(said.get("root", [])):
        if not ROOT_NAME.fullmatch(str(r.get("name", ""))):
            raise ValueError(f"{path}: root[{k}].name: a name has 1 to 64 letters, digits, _ or -")
        place = os.path.realpath(os.path.join(folder, r["path"]))
        if not os.path.isdir(place):
            raise ValueError(f"{path}: root[{k}].path: {place} is not a directory")
        roots.append((r["name"], place))
    return Workspace(tuple(roots) or (("", folder),), tuple(said.get("deny", [])))


def ignore_rules(lines: list[str]) -> list[tuple[bool, bool, re.Pattern]]:
    """(keeps, directories only, pattern on the path below the file) for each line of an ignore file, in order."""
    rules = []
    for line in lines:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        line = line.lstrip("!")
        only_dirs, anchored = line.endswith("/"), "/" in line.rstrip("/")
        body = line.strip("/")
        regex = ""
        for part in re.split(r"(\*\*/|/\*\*|\*|\?)", body):
            regex += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
        rules.append((keeps, only_dirs, re.compile(("^" if anchored else "^(?:.*/)?") + regex + "$")))
    return rules


Rules = list[tuple[str, list]]


def _rules_of(root: str, where: str) -> Rules:
    """The ignore rules of one folder, if it has a file of them."""
    ignore = os.path.join(root, where, ".gitignore")
    if not os.path.isfile(ignore):
        return []
    with open(ignore, encoding="utf-8", errors="replace") as f:
        return [(where, ignore_rules(f.read().split("\n")))]


def _entries(root: str, where: str, rules: Rules) -> tuple[list[str], list[str], list[str]]:
    """Of one folder: files, folders to enter, and links that lead outside; ignored ones left out. Links to directories are
    not followed, dangling ones are dropped."""
    found, folders, outside = [], [], []
    for e in sorted(os.scandir(os.path.join(root, where)), key=lambda e: e.name):
        path = f"{where}/{e.name}" if where else e.name
        folder, drop = e.is_dir(follow_symlinks=False), False
        for base, own in rules:
            below = path[len(base) + 1 :] if base else path
            for keeps, only_dirs, pattern in own:
                if (folder or not only_dirs) and pattern.match(below):
                    drop = not keeps
        if drop or (folder and e.name in PRUNED):
            continue
        if folder:
            folders.append(path)
        elif e.is_file():
            inside = os.path.realpath(e.path).startswith(root + os.sep)
            (found if inside else outside).append(path)
    return found, folders, outside


def _walk(root: str, where: str) -> Iterator[tuple[list[str], list[str]]]:
    """Files and outside links of every folder from ``where`` down, by the rules of the folders above it too."""
    above = [where[:i] for i in range(len(where)) if where[i] == "/"]
    rules = [r for place in (["", *above] if where else []) for r in _rules_of(root, place)]
    todo = [(where, rules)]
    while todo:
        place, rules = todo.pop()
        rules = [*rules, *_rules_of(root, place)]
        found, folders, outside = _entries(root, place, rules)
        yield found, outside
        todo.extend((f, rules) for f in reversed(folders))


def list_tree(root: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Relative paths under ``root`` in order, and (path, reason) of those left out: links that lead outside.

    Hidden files count, ignored ones do not.
    """
    root = os.path.realpath(root)
    parts = list(_walk(root, ""))
    return sorted(p for found, _ in parts for p in found), sorted((p, "outside-root") for _, outside in parts for p in outside)


LISTED = "path string, file string, size long, mtime_ms long, skipped_reason string"
_COLUMNS = ["path", "file", "size", "mtime_ms", "skipped_reason"]
#: Rows that one frame of a listing holds, about.
FRAME_ROWS = 20_000


def _stats(prefix: str, root: str, found: list[str], outside: list[str]) -> list[tuple]:
    rows = []
    for p in found:
        try:
            at = os.stat(f"{root}/{p}")
        except OSError:  # gone since it was listed
            continue
        rows.append((prefix + p, f"{root}/{p}", at.st_size, at.st_mtime_ns // 1_000_000, None))
    return rows + [(prefix + p, None, 0, 0, "outside-root") for p in outside]


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for batch in batches:
        for r in batch.itertuples():
            for found, outside in _walk(r.root, r.folder):
                rows += _stats(r.prefix, r.root, found, outside)
                if len(rows) >= FRAME_ROWS:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows = []
    yield pd.DataFrame(rows, columns=_COLUMNS)


def listing(spark: SparkSession, workspace: Workspace) -> DataFrame:
    """``path, file, size, mtime_ms, skipped_reason`` of every root's tree: names and stats alone, nothing is read.

    The driver lists two levels of folders; each folder below is listed by a task.
    """
    rows, folders = [], []
    for name, place in workspace.roots:
        prefix = f"{name}/" if name and len(workspace.roots) > 1 else ""
        root = os.path.realpath(place)
        level = [""]
        for _ in range(2):
            below = []
            for where in level:
                above = [where[:i] for i in range(len(where)) if where[i] == "/"]
                rules = [r for at in dict.fromkeys(["", *above, where]) for r in _rules_of(root, at)]
                found, inner, outside = _entries(root, where, rules)
                rows += _stats(prefix, root, found, outside)
                below += inner
            level = below
        folders += [(prefix, root, f) for f in level]
    listed = spark.createDataFrame(rows, LISTED)
    if folders:
        tasks = min(len(folders), spark.sparkContext.defaultParallelism * 4)
        trees = spark.createDataFrame(folders, "prefix string, root string, folder string").repartition(tasks)
        listed = listed.unionByName(trees.mapInPandas(_subtrees, LISTED))
    # patterns hold below a root, whatever its prefix
    deny = denied(F.col("path"), workspace.deny) & F.col("skipped_reason").isNull()
    return listed.withColumn("skipped_reason", F.when(deny, "denylisted").otherwise(F.col("skipped_reason"))).withColumn("file", F.when(F.col("skipped_reason").isNull(), F.col("file")))


#: Files of one task, about, and contents that one frame of a task's result holds at most, unless a single file is larger.
FILES_PER_TASK, FRAME_BYTES = 64, 8 << 20


def read(listed: DataFrame) -> DataFrame:
    """``listed`` with ``content``. Rows with a reason are not read, nor are files that their name or size rules out."""
    ruled_out = name_reason(F.col("path"), F.col("size"))
    listed = listed.withColumn("skipped_reason", F.coalesce("skipped_reason", ruled_out)).withColumn("file", F.when(F.col("skipped_reason").isNull(), F.col("file")))
    spark = listed.sparkSession
    most = spark.sparkContext.defaultParallelism * 4
    n = listed.filter("file is not null").limit(most * FILES_PER_TASK).count()
    if not n:
        return listed.withColumn("content", F.lit(None).cast("binary")).drop("file")
    return listed.repartition(max(1, min(n // FILES_PER_TASK, most))).mapInPandas(_contents, "path string, size long, mtime_ms long, skipped_reason string, content binary")


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "size", "mtime_ms", "skipped_reason", "content"]
    rows, held = [], 0
    for batch in batches:
        for r in batch.itertuples():
            content, why = None, r.skipped_reason
            if isinstance(r.file, str):
                try:
                    with open(r.file, "rb") as f:
                        content = f.read()
                except OSError:
                    why = "unreadable"
            rows.append((r.path, r.size, r.mtime_ms, why, content))
            held += len(content or b"")
            if held >= FRAME_BYTES:
                yield pd.DataFrame(rows, columns=names)
                rows, held = [], 0
    yield pd.DataFrame(rows, columns=names)


def scan(spark: SparkSession, workspace: Workspace) -> DataFrame:
    """Every path of a workspace with its content or the reason it has none."""
    return read(listing(spark, workspace))


def gated(scanned: DataFrame) -> DataFrame:
    """The scan with lang, text, content_hash and the first reason to skip."""
    before = scanned.withColumnRenamed("skipped_reason", "_before")
    rows = gate(before)
    return rows.withColumn("skipped_reason", F.coalesce("_before", "skipped_reason")).withColumn("content_hash", F.when(F.col("skipped_reason").isNull(), F.sha2("content", 256))).drop("_before", "content")


def extracted(files: DataFrame, vocabulary: dict[str, str] | None = None) -> DataFrame:
    """Definitions, references, section texts and table aliases of gated files; see ``extract.EXTRACTED``."""
    return files.filter("skipped_reason is null").select("path", "lang", "text").mapInPandas(extract_rows(vocabulary or {}), EXTRACTED)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The index tables of extracted rows."""
    key = F.xxhash64("path", "name", "kind", "line_start")
    symbols = rows.filter("role = 'def'").select(key.alias("symbol_id"), "path", "name", "kind", "line_start", "line_end", "signature", "body")
    said = F.concat_ws(" ", F.col("name"), F.array_join(split_identifier(F.col("name")), " "))
    return {
        "symbols": symbols.drop("body").withColumn("stems", F.array_distinct(stemmed_tokens(said))),
        "refs": rows.filter("role = 'ref'").select("path", "name", F.col("line_start").alias("line")),
        "sections": symbols.filter(F.trim("body") != "").select("symbol_id", "path", "name", F.col("body").alias("content"), F.sha2("body", 256).alias("hash"), stemmed_tokens(F.col("body")).alias("stems")),
        "aliases": rows.filter("role = 'alias'").select(F.col("name").alias("alias"), F.col("signature").alias("table_name"), "path"),
    }


def vocabulary(aliases: DataFrame) -> DataFrame:
    """The first table of each alias."""
    return aliases.groupBy("alias").agg(F.min("table_name").alias("table_name"))


__all__ = ["Workspace", "extracted", "gated", "glob_regex", "list_tree", "scan", "tables", "vocabulary"]
