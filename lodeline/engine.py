"""One object per index: build and refresh it from a workspace, then ask it. Every method returns a DataFrame."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline import locks
from lodeline.functions import text as T
from lodeline.functions.stem import fold, stem
from lodeline.operators import graph as G
from lodeline.operators import incremental, provenance, render
from lodeline.operators import knowledge as K
from lodeline.operators import rank as R
from lodeline.operators import search as S
from lodeline.operators.graph import QUERY_FACTOR
from lodeline.sources import diffs, files, git
from lodeline.storage import settle

SCHEMA_VERSION = 2
TABLES = ("files", "symbols", "refs", "sections", "aliases")
KNOWLEDGE = ("entities", "mentions", "relations", "steps", "systems", "section_vectors", "relation_vectors", "entity_vectors", "cache")
#: Changed files that one pass of a bounded refresh reads.
PASS_FILES = 2000
FIND_MAX, ENTITIES_MAX = 50, 25


@dataclass(frozen=True)
class Authored:
    """What people wrote about a workspace: exact pins, excluded paths or ``dir/``, notes (path, symbol or None, text)."""

    pins: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    notes: tuple[tuple[str, str | None, str], ...] = ()


@dataclass(frozen=True)
class Seeds:
    """What knowledge and vectors say of symbols for one question, each table by ``symbol_id`` or absent.

    semantic, themes: ``similarity``; entities (the question's, by what mentions them) and implements (code of matched
    names): ``name, place``, the place giving the order of names.
    """

    semantic: DataFrame | None = None
    themes: DataFrame | None = None
    entities: DataFrame | None = None
    implements: DataFrame | None = None

    def of_symbols(self, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Per symbol (symbol_id, semantic, known) and per file (path, semantic, theme, entities, implements)."""
        own = symbols.select("symbol_id", "path")
        kinds = {"semantic": "double", "theme": "double", "entities": "array<string>", "implements": "array<string>"}
        by_symbol, by_file = own.select("symbol_id", F.lit(None).cast("double").alias("semantic"), F.lit(False).alias("known")).limit(0), own.select("path").distinct()
        for name, rows in zip(kinds, (self.semantic, self.themes, self.entities, self.implements), strict=True):
            if rows is None:
                by_file = by_file.withColumn(name, F.lit(None).cast(kinds[name]))
                continue
            met = own.join(rows, "symbol_id")
            if kinds[name] == "double":
                said = met.groupBy("path").agg(F.max("similarity").cast("double").alias(name))
            else:
                named = met.groupBy("path", "name").agg(F.min("place").alias("place"))
                said = named.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias(name))
            by_file = by_file.join(said, "path", "left")
            close = F.col("similarity").cast("double") if name == "semantic" else F.lit(None).cast("double")
            by_symbol = by_symbol.unionByName(met.select("symbol_id", close.alias("semantic"), F.lit(name != "semantic").alias("known")))
        return by_symbol.groupBy("symbol_id").agg(F.max("semantic").alias("semantic"), F.max("known").alias("known")), by_file


class Engine:
    """An index under ``place``: versioned tables, swapped in whole, and the record of answers beside them."""

    def __init__(self, spark: SparkSession, place: str, authored: Authored = Authored()) -> None:
        self.spark, self.place, self.authored = spark, place.rstrip("/"), authored

    # --- building

    def _pointers(self) -> str:
        return f"{self.place}/v{SCHEMA_VERSION}/current"

    def _generation(self) -> int:
        return (locks.numbers(self.spark, self._pointers()) or [0])[-1]

    def _current(self) -> str | None:
        """Folder of the newest generation. Generations are only added, so a reader always sees a whole index."""
        number = self._generation()
        return locks.text_of(self.spark, f"{self._pointers()}/{number}") if number else None

    def _read_or_none(self, path: str, kind: str) -> DataFrame | None:
        spot = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not spot.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(spot):
            return None
        return self.spark.read.format(kind).load(path)

    def table(self, name: str) -> DataFrame:
        current = self._current()
        if current is None:
            raise ValueError("the index was not built")
        if (self.meta().get("schema") or str(SCHEMA_VERSION)) != str(SCHEMA_VERSION):
            raise ValueError("the index has another schema; build it anew")
        return self.spark.read.parquet(f"{current}/{name}")

    def meta(self) -> dict[str, str]:
        """What a generation says of itself: schema, git_head, built_at_ms, remaining."""
        current = self._current()
        return json.loads(locks.text_of(self.spark, f"{current}/meta.json") or "{}") if current else {}

    def refresh_within(self, workspace: files.Workspace, seconds: float, pass_files: int = PASS_FILES) -> DataFrame:
        """``refresh`` in passes of ``pass_files`` changed files until nothing remains or the time is over; one pass at least."""
        until = time.monotonic() + seconds
        while True:
            out = self.refresh(workspace, pass_files)
            if not out.filter("change = 'remaining'").count() or time.monotonic() >= until:
                return out

    def refresh(self, workspace: files.Workspace, most: int | None = None) -> DataFrame:
        """Index what changed; schema files come first, since code is read with their tables' names.

        Three tiers: files whose stats are as before are not read; those whose content hash is as before keep their rows;
        the others are extracted. Nothing is written if nothing changed. Code is read again where the vocabulary changed.
        With ``most`` only so many changed files are read, in order of their paths; the others count as remaining, and
        what is known of them stays. The answer counts paths by change. Sections with new text are queued for the
        knowledge layer. One writer at a time; a generation that another writer put in place meanwhile is a Conflict.
        """
        with locks.Writer(self.spark, f"{self.place}/v{SCHEMA_VERSION}"):
            return self._refresh(workspace, most)

    def _refresh(self, workspace: files.Workspace, most: int | None) -> DataFrame:
        number = self._generation()
        empty = not number
        listed = settle(files.listing(self.spark, workspace), "listing")
        stamps = ["path", "mtime_ms", "size"]
        known = listed.limit(0).select(*stamps) if empty else self.table("files").select(*stamps)
        changes = settle(incremental.scan_changes(known, listed.select(*stamps)), "changes")
        if most is not None:
            late = changes.filter("change in ('new', 'changed')").orderBy("path").offset(most).select("path", F.lit(True).alias("late"))
            late = settle(late, "late")
            changes = settle(changes.join(late, "path", "left").select("path", F.when(F.col("late"), F.concat(F.lit("late "), "change")).otherwise(F.col("change")).alias("change")), "changes")
        counts = changes.groupBy(F.when(F.col("change").startswith("late "), "remaining").otherwise(F.col("change")).alias("change")).count().collect()
        out = self.spark.createDataFrame(counts, "change string, count long")
        head = git.heads(workspace.roots)
        if not empty and all(r.change in ("unchanged", "remaining") for r in counts) and self.meta().get("git_head") == head:
            return out
        same = changes.filter("change in ('unchanged', 'late changed')").select("path")
        fresh = listed.join(changes.filter("change in ('new', 'changed')").select("path"), "path", "left_semi")
        seen = settle(files.gated(files.read(fresh)), "seen")
        touched = seen.limit(0).select("path")
        if not empty:
            before_ = self.table("files").filter("skipped_reason is null").select("path", F.col("content_hash"), F.lit(None).cast("string").alias("vocab"))
            code = F.col("lang").isin("typescript", "tsx", "javascript", "rust")
            touched = settle(incremental.content_changes(before_, seen.filter("skipped_reason is null").select("path", "content_hash", code.alias("code"))).filter("change = 'touched'").select("path"), "touched")
        todo = seen.join(touched, "path", "left_anti")
        schema = F.coalesce(F.col("lang"), F.lit("")).isin("prisma", "sql")
        parts = files.tables(settle(files.extracted(todo.filter(schema)), "schema"))
        kept = same.unionByName(touched)
        aliases = parts["aliases"]
        if not empty:
            aliases = self.table("aliases").join(kept, "path", "left_semi").unionByName(aliases)
        names = {r.alias: r.table_name for r in files.vocabulary(aliases).collect()}
        before = {} if empty else {r.alias: r.table_name for r in files.vocabulary(self.table("aliases")).collect()}
        rest = todo.filter(~schema)
        if names != before and not empty:
            code = self.table("files").filter(F.col("lang").isin("typescript", "tsx", "javascript", "rust") & F.col("skipped_reason").isNull()).select("path").join(kept, "path", "left_semi")
            again = settle(files.gated(files.read(listed.join(code, "path", "left_semi"))), "again")
            rest, kept = rest.unionByName(again), kept.join(again.select("path"), "path", "left_anti")
        other = files.tables(settle(files.extracted(rest, names), "extracted"))
        target = f"{self.place}/v{SCHEMA_VERSION}/{uuid.uuid4().hex}"
        indexed = seen.drop("text")
        if not empty:
            indexed = indexed.unionByName(self.table("files").join(same, "path", "left_semi"))
        indexed.write.parquet(f"{target}/files")
        for name in TABLES[1:]:
            rows = parts[name].unionByName(other[name])
            if not empty:
                rows = rows.unionByName(self.table(name).join(kept, "path", "left_semi"))
            rows.write.parquet(f"{target}/{name}")
        meta = {"schema": str(SCHEMA_VERSION), "git_head": head, "built_at_ms": str(int(time.time() * 1000)), "remaining": str(sum(r["count"] for r in counts if r.change == "remaining"))}
        locks.create(self.spark, f"{target}/meta.json", json.dumps(meta))
        locks.take_next(self.spark, self._pointers(), target, after=number)
        self._enqueue()
        return out

    def entity(self, name: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """An entity by its name: its row, its relations, the sections that mention it; None if it is not known."""
        held = self.knowledge()
        if not {"entities", "mentions", "relations"} <= set(held):
            return None
        found = held["entities"].filter(F.col("norm_name") == T.norm_name(F.lit(name))).limit(1).collect()
        sections = self._shown(self.table("symbols")).select(F.col("symbol_id").alias("section"), "path", "name", "line_start", "line_end")
        return K.entity_detail(found[0].entity_id, held["entities"], held["relations"], held["mentions"], sections) if found else None

    # --- the queue of sections for the knowledge layer

    def _log(self) -> DataFrame:
        held = self._read_or_none(f"{self.place}/log/queue", "parquet")
        return held if held is not None else self.spark.createDataFrame([], incremental.QUEUE_LOG)

    def _append(self, rows: DataFrame) -> None:
        rows.select(*[c.split()[0] for c in incremental.QUEUE_LOG.split(", ")]).write.mode("append").parquet(f"{self.place}/log/queue")

    def _enqueue(self) -> None:
        self._append(settle(incremental.to_queue(self._log(), self.table("sections"), int(time.time() * 1000)), "queued"))

    def queue(self) -> DataFrame:
        """Sections that wait: symbol_id, hash, stage, attempts, last_error, queued_at_ms, claimed_at_ms, stamp."""
        return incremental.queue_state(self._log())

    def claim(self, limit: int, now_ms: int | None = None) -> tuple[str, DataFrame]:
        """Claim up to ``limit`` of the oldest free sections under a stamp of its own; those it really got are read back."""
        now_ms, stamp = now_ms or int(time.time() * 1000), uuid.uuid4().hex
        rows = incremental.claimable(self.queue(), now_ms, limit)
        self._append(settle(incremental.events(rows, "claimed", now_ms, stamp=stamp), "claimed"))
        return stamp, settle(self.queue().filter((F.col("stamp") == stamp) & (F.col("claimed_at_ms") == now_ms)), "mine")

    def report(self, rows: DataFrame, event: str, error: str | None = None, stamp: str | None = None) -> None:
        """Append an event for claimed rows (symbol_id, hash): extracted, has_process, stepped, failed, outage, released."""
        self._append(incremental.events(rows, event, int(time.time() * 1000), error=error, stamp=stamp))

    def views(self) -> None:
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)

    # --- reading

    def _shown(self, df: DataFrame, column: str = "path") -> DataFrame:
        excludes = self.authored.excludes
        return df.filter(~T.is_excluded(F.col(column), F.array(*map(F.lit, excludes)))) if excludes else df

    def index_version(self) -> str:
        return incremental.index_version(self.table("files").filter("skipped_reason is null")).first().version

    def names(self) -> tuple[DataFrame, DataFrame]:
        """Definitions (file, name) and references (file, name, count) of shown files."""
        defs = self._shown(self.table("symbols")).select(F.col("path").alias("file"), "name")
        return defs, self._shown(self.table("refs")).groupBy(F.col("path").alias("file"), "name").agg(F.count("*").alias("count"))

    def edges(self, named=None) -> DataFrame:
        return G.weighted_edges(*self.names(), named)

    def ranked(self, query: str = "", focus: tuple[str, ...] = (), seeds: Seeds = Seeds()) -> DataFrame:
        """All candidates with score and reasons, unordered; ``seeds`` adds what knowledge and vectors say."""
        asked = self.spark.range(1).select(T.query_terms(F.lit(query)).alias("t")).first().t
        stems = list(dict.fromkeys(stem(fold(t)) for t in asked))
        terms = F.array(*map(F.lit, asked)).cast("array<string>")
        symbols = self._shown(self.table("symbols"))
        by_name = F.exists("stems", lambda p: reduce(lambda a, b: a | b, [p.startswith(t) for t in stems])) if stems else F.lit(False)
        # a name that any symbol of it met counts as asked for, excluded files included
        met_names = self.table("symbols").filter(by_name | T.name_matches_query(F.col("name"), terms)).select("name").distinct()
        met_names = settle(met_names.withColumn("asked", F.lit(True)), "names")
        sections = self._shown(self.table("sections"))
        body = S.bm25(sections, "symbol_id", F.col("stems"), stems).withColumnRenamed("score", "body") if stems else sections.select("symbol_id", F.lit(0.0).alias("body")).limit(0)
        notes = self.spark.createDataFrame([(p, s, x) for p, s, x in self.authored.notes], "path string, symbol string, note string").filter(T.note_matches(F.col("note"), terms))
        rows = symbols.withColumn("fts_hit", by_name).drop("stems").join(body, "symbol_id", "left").join(met_names, "name", "left").withColumn("query_ident_match", F.coalesce("asked", F.lit(False))).drop("asked")
        noted = notes.select("path", F.col("symbol").alias("name"), F.lit(True).alias("noted")).distinct()
        rows = rows.join(noted.filter("name is not null"), ["path", "name"], "left").withColumn("noted", F.coalesce("noted", F.lit(False)))
        by_symbol, by_file = seeds.of_symbols(symbols)
        met = rows.join(by_symbol, "symbol_id", "left").withColumn("name_hit", F.col("fts_hit") | F.coalesce("known", F.lit(False)))
        hits = met.filter("name_hit or body is not null or semantic is not null").select("symbol_id", "path", "name_hit", "body", "semantic")
        shares = R.hit_shares(hits, "path").select("symbol_id", "share")
        hit_files, note_files = rows.filter("fts_hit or body is not null").select("path").distinct().withColumn("hit", F.lit(True)), notes.select("path").distinct().withColumn("note", F.lit(True))
        nodes = self._shown(self.table("files").filter("skipped_reason is null")).select("path").join(hit_files, "path", "left").join(note_files, "path", "left").join(by_file, "path", "left")
        facts = nodes.select(
            F.col("path").alias("node"), F.col("path").isin(*focus).alias("focus") if focus else F.lit(False).alias("focus"), F.col("path").isin(*self.authored.pins).alias("pinned") if self.authored.pins else F.lit(False).alias("pinned"),
            F.coalesce("hit", F.lit(False)).alias("text_hit"), F.coalesce("note", F.lit(False)).alias("note"), "semantic", "theme", "entities", "implements", F.lit(" ".join(asked)).alias("query"),
        )
        person = R.personalisation(facts)
        defs, refs = self.names()
        refs = refs.join(met_names, "name", "left").select("file", "name", (F.col("count") * F.when(F.col("asked"), QUERY_FACTOR).otherwise(1.0)).alias("count"))
        ranks = settle(G.pagerank_of_names(person.select("node", "p"), defs, refs), "ranks")
        scored = R.symbol_scores(rows.join(shares, "symbol_id", "left").withColumn("file", F.col("path")), R.distribute(defs, refs, ranks), ranks)
        documents = F.coalesce(T.language_class(T.language(F.col("path"))) == "document", F.lit(False))
        scored = scored.filter(~T.is_support_file(F.col("path"), documents))
        refs = R.referenced_by(*self.names()).select(F.col("dst").alias("path"), "name", "referenced_by")
        return scored.join(refs, ["path", "name"], "left").join(facts.join(person.drop("p"), "node").select(F.col("node").alias("path"), "seeds", "pinned", F.col("note").alias("note_hit")), "path")

    def repo_map(self, query: str = "", focus: tuple[str, ...] = (), budget: int | None = None, record: bool = True, seeds: Seeds = Seeds()) -> tuple[DataFrame, str]:
        """Served and cut rows with rank and reasons, and the rendered text that fits the budget; recorded."""
        budget = R.clamp_budget(budget)
        # a row takes two tokens at least, so no more rows can be served
        limit = budget + R.CUT_RECORDED
        every = self.ranked(query, focus, seeds)
        total = every.count()
        rows = every.orderBy(F.desc("score"), "path", "line_start", "symbol_id").limit(limit).collect()
        n = R.fit_map(rows, budget, self.authored.notes)
        answer = [(i + 1, r.symbol_id, r.path, r.name, r.line_start, r.signature, r.score, i < n, r.file_rank, r.seeds, [(x.path, x["count"]) for x in r.referenced_by or ()], r.pinned, r.fts_hit, r.query_ident_match, r.note_hit, r.body is not None) for i, r in enumerate(rows[: n + R.CUT_RECORDED])]
        found = self.spark.createDataFrame(
            answer,
            "rank int, symbol_id long, path string, name string, line_start int, signature string, score double, served boolean, file_rank double, seeds array<string>, referenced_by array<struct<path: string, count: long>>, pinned boolean, fts_hit boolean, query_ident_match boolean, note_hit boolean, body_hit boolean",
        )
        if record:
            self._record("repo_map", query, focus, budget, None, found)
        recorded = max(0, min(len(rows) - n, R.CUT_RECORDED))
        last = self.spark.range(1).select(T.footer(F.lit(n), F.lit(total), F.lit(recorded)).alias("f")).first().f
        return found, R.render_map(rows[:n], self.authored.notes) + "# " + last

    def _record(self, tool: str, query: str | None, focus: tuple[str, ...], budget: int | None, limit: int | None, rows: DataFrame) -> int:
        # a number of its own, whoever else records at the same time
        number = locks.take_next(self.spark, f"{self.place}/log/ids")
        header = (number, "cli-" + str(os.getpid()), tool, query, list(focus), budget, limit, self.index_version(), self.meta().get("git_head"), 0, int(time.time() * 1000))
        provenance.record(f"{self.place}/log", header, rows.withColumn("retrieval_id", F.lit(number).cast("long")))
        return number

    def find_symbol(self, name: str, kind: str | None = None, limit: int = 10) -> DataFrame:
        """Matches with their referring files; rank and 1/rank as score."""
        symbols = self._shown(self.table("symbols"))
        if kind:
            symbols = symbols.filter(F.col("kind") == kind)
        found = S.find(symbols, name, min(max(limit, 1), FIND_MAX))
        refs = self._shown(self.table("refs"))
        ranked = R.numbered(S.referrers_of(found, refs), F.desc("exact"), F.length("name"), "path", "line_start")
        return ranked.withColumn("score", R.reciprocal(F.col("rank")))

    def find_text(self, name: str, kind: str | None = None, limit: int = 10) -> str:
        return render.find_text(self.find_symbol(name, kind, limit).orderBy("rank").collect(), self.authored.notes)

    def trace_path(self, start: str, goal: str) -> DataFrame:
        """Hops between the files of two ``path::name`` symbols; empty in one file; an unknown symbol is an error."""
        ends = []
        for asked in (start, goal):
            path, _, name = asked.partition("::")
            if not self.table("symbols").filter((F.col("path") == path) & (F.col("name") == name)).limit(1).count():
                raise ValueError(f"no symbol {asked}")
            ends.append(path)
        hops = G.shortest_trace(self.edges(), *ends)
        rows = [(i + 1, *h) for i, h in enumerate(hops or [])]
        return self.spark.createDataFrame(rows, "hop int, from_path string, name string, to_path string, forward boolean").withColumn("reachable", F.lit(hops is not None))

    def trace_text(self, start: str, goal: str) -> str:
        """The trace as text; its symbols are recorded."""
        found = self.trace_path(start, goal)
        hops = [(r.from_path, r.name, r.to_path, r.forward) for r in found.orderBy("hop").collect()]
        ends = [tuple(x.split("::", 1)) for x in (start, goal)]
        reached = bool(hops) or ends[0][0] == ends[1][0]
        if reached:
            wanted = self.spark.createDataFrame([(k, *x) for k, x in enumerate(render.trace_symbols(*ends, hops))], "place int, path string, name string")
            first = self.table("symbols").groupBy("path", "name").agg(F.min_by(F.struct("symbol_id", "line_start", "signature"), "line_start").alias("s"))
            rows = wanted.join(first, ["path", "name"]).select((F.row_number().over(Window.orderBy("place"))).alias("rank"), "s.symbol_id", "path", "name", "s.line_start", "s.signature")
            self._record("trace_path", f"{start} → {goal}", (), None, None, rows.withColumn("score", R.reciprocal(F.col("rank"))).withColumn("served", F.lit(True)))
        return render.trace_text(*ends, hops if reached else None)

    def blast_radius(self, path: str, name: str, depth: int = 3, most: int = 200) -> tuple[DataFrame, str | None]:
        defs = self._shown(self.table("symbols")).select(F.col("path").alias("file"), "name")
        refs = self._shown(self.table("refs")).select(F.col("path").alias("file"), "name")
        return G.blast_radius(defs, refs, path, name, depth, most)

    def blast_text(self, path: str, name: str, depth: int = 3, most: int = 200) -> str:
        rows, cut = self.blast_radius(path, name, depth, most)
        return render.blast_text(path, name, rows.orderBy("depth", "file").collect(), cut)

    def changed(self, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Symbols and files that changed line ranges (path, first, last) touch."""
        return diffs.changed(self._shown(ranges), self._shown(self.table("symbols")), self._shown(self.table("refs")))

    def changed_text(self, ranges: DataFrame, base: str = "HEAD") -> str:
        """What changed since ``base``, the first MAX_CHANGED symbols."""
        symbols, plain = diffs.changed(self._shown(ranges), self._shown(self.table("symbols")), self._shown(self.table("refs")), render.MAX_CHANGED + 1)
        by = self._shown(self.table("refs")).select("name", F.col("path").alias("by")).distinct()
        first = symbols.orderBy("path", "line_start").limit(render.MAX_CHANGED + 1)
        named = first.select("path", "name").distinct().join(by, "name").filter("by <> path").groupBy("path", "name").agg(F.array_sort(F.collect_set("by")).alias("referenced_by"))
        held = self.table("symbols").select("path", "name", "line_start", "symbol_id", "signature")
        shown = settle(first.limit(render.MAX_CHANGED).select("path", "name", "line_start").join(held, ["path", "name", "line_start"]), "changed")
        if shown.limit(1).count():
            ranked = R.numbered(shown, "path", "line_start", "symbol_id")
            self._record("changed", base, (), None, None, ranked.withColumn("score", R.reciprocal(F.col("rank"))).withColumn("served", F.lit(True)))
        rows = first.select("path", "name", "line_start", "line_end").join(named, ["path", "name"], "left").orderBy("path", "line_start").collect()
        return render.changed_text(rows[: render.MAX_CHANGED], [r.path for r in plain.select("path").distinct().orderBy("path").limit(1000).collect()], base, len(rows) > render.MAX_CHANGED)

    def freshness(self) -> str:
        """The line on the index's state that heads an answer."""
        meta = self.meta()
        line = T.freshness(F.lit(self.index_version()), F.lit(meta.get("git_head")).cast("string"), F.lit(int(meta.get("remaining") or 0)), self.queue().count())
        return self.spark.range(1).select(line.alias("f")).first().f

    def entities(self, entities: DataFrame, query: str, arguments: tuple[str, ...] = (), similar: DataFrame | None = None, limit: int = 10) -> DataFrame:
        return K.match_entities(entities, query, list(arguments), similar, min(max(limit, 1), ENTITIES_MAX))

    # --- knowledge

    def _knowledge_at(self) -> tuple[int, str | None]:
        number = (locks.numbers(self.spark, f"{self.place}/knowledge/current") or [0])[-1]
        return number, locks.text_of(self.spark, f"{self.place}/knowledge/current/{number}") if number else None

    def knowledge(self) -> dict[str, DataFrame]:
        """The knowledge tables that are there, without what rests on sections that are gone; mentions counted anew."""
        _, at = self._knowledge_at()
        found = {n: self._read_or_none(f"{at}/{n}", "parquet") for n in KNOWLEDGE} if at else {}
        found = {n: t for n, t in found.items() if t is not None}
        ids = self.table("sections").select("symbol_id")
        for name in ("mentions", "relations", "steps"):
            if name in found:
                found[name] = found[name].join(ids.withColumnRenamed("symbol_id", "section"), "section", "left_semi")
        if "section_vectors" in found:
            found["section_vectors"] = found["section_vectors"].join(ids, "symbol_id", "left_semi")
        if {"entities", "mentions", "relations"} <= set(found):
            found["entities"], found["relations"] = K.recount(found["entities"], found["mentions"], found["relations"])
        return found

    def put_knowledge(self, model: str | None = None, dim: int | None = None, **tables: DataFrame) -> None:
        """Replace these knowledge tables, keep the others. With vectors of another model or dimension than before, tables
        of vectors that are not given anew go, and every section is queued again. Another writer's change is a Conflict."""
        if unknown := set(tables) - set(KNOWLEDGE):
            raise ValueError(f"no knowledge tables: {sorted(unknown)}")
        number, at = self._knowledge_at()
        said = json.loads(locks.text_of(self.spark, f"{at}/meta.json") or "{}") if at else {}
        new = {"model": model or said.get("model"), "dim": dim or said.get("dim")}
        moved = bool(said.get("model")) and (new["model"], new["dim"]) != (said["model"], said["dim"])
        target = f"{self.place}/knowledge/{uuid.uuid4().hex}"
        for name in KNOWLEDGE:
            rows = tables.get(name)
            if rows is None and at and not (moved and name.endswith("_vectors")):
                rows = self._read_or_none(f"{at}/{name}", "parquet")
            if rows is not None:
                rows.write.parquet(f"{target}/{name}")
        locks.create(self.spark, f"{target}/meta.json", json.dumps(new))
        locks.take_next(self.spark, f"{self.place}/knowledge/current", target, after=number)
        if moved:
            self._append(incremental.events(self.table("sections").select("symbol_id", "hash"), "requeued", int(time.time() * 1000)))

    def tick(self, extract: Callable[[DataFrame], tuple[dict[str, DataFrame], DataFrame]], extracts: int = 5) -> int:
        """Claim up to ``extracts`` sections, extract them and apply what they say; how many were claimed.

        ``extract`` takes (symbol_id, path, name, line_start, content) and gives tables entities, relations and steps as
        ``transcripts.extraction`` does, and (symbol_id, error) of sections that failed; they stay queued until their
        attempts are used up. What was known of the sections before is replaced.
        """
        stamp, mine = self.claim(extracts)
        n = mine.count()
        if not n:
            return 0
        symbols = self.table("symbols").select("symbol_id", "line_start")
        rows = self.table("sections").join(mine.select("symbol_id"), "symbol_id", "left_semi").join(symbols, "symbol_id").select("symbol_id", "path", "name", "line_start", "content")
        tables, failed = extract(rows)
        failed = settle(failed.select("symbol_id", "error"), "failed")
        done = settle(mine.join(failed.select("symbol_id"), "symbol_id", "left_anti").select("symbol_id", "hash"), "done")
        parts = {name: settle(rows.join(done.select(F.col("symbol_id").alias("section")), "section", "left_semi"), name) for name, rows in tables.items()}
        self._apply(parts, done)
        for r in failed.limit(extracts).collect():
            self.report(mine.filter(F.col("symbol_id") == r.symbol_id), "failed", error=r.error, stamp=stamp)
        self.report(done, "extracted", stamp=stamp)
        return n

    def _apply(self, parts: dict[str, DataFrame], done: DataFrame) -> None:
        """Merge extracted rows of ``done`` sections into the knowledge tables."""
        held = self.knowledge()
        merged, mentions, relations = K.apply_extraction(parts["entities"], parts["relations"], "path", "line", "ordinal")
        gone = done.select(F.col("symbol_id").alias("section"))
        relations = relations.withColumn("relation_id", F.xxhash64("src_entity", "dst_entity", "description", "section"))
        entities = merged.select("entity_id", "norm_name", "name", "type", "description", "mentions")
        if "entities" in held:
            old = held["entities"].select("entity_id", "norm_name", "name", "type", "description", "mentions")
            both = old.withColumn("_new", F.lit(0)).unionByName(entities.withColumn("_new", F.lit(1)))
            text = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_new", "description"))), lambda x: x["description"]))
            kind = F.when(F.bool_or(F.col("type") == "process"), "process").otherwise(F.min_by("type", "_new"))
            entities = both.groupBy("entity_id", "norm_name").agg(F.min_by("name", "_new").alias("name"), kind.alias("type"), T.extend_description(text).alias("description"), F.sum("mentions").alias("mentions"))
            mentions = mentions.unionByName(held["mentions"].select("entity_id", "section").join(gone, "section", "left_anti"))
            relations = relations.unionByName(held["relations"].select(*relations.columns).join(gone, "section", "left_anti"))
        entities, steps, systems = K.apply_steps(K.normalise_steps(parts["steps"]), settle(entities, "entities"), settle(mentions, "mentions"))
        processes = steps.select(F.col("process_id").alias("entity_id"), "section").distinct()
        mentions = mentions.select("entity_id", "section").unionByName(processes).distinct()
        if "steps" in held:
            kept = held["steps"].join(gone, "section", "left_anti")
            steps, systems = steps.unionByName(kept), systems.unionByName(held["systems"].join(kept.select("step_id"), "step_id", "left_semi"))
        kept_entities, relations = K.recount(entities, mentions, relations)
        self.put_knowledge(entities=kept_entities.select("entity_id", "norm_name", "name", "type", "description", "mentions"), mentions=mentions, relations=relations, steps=steps, systems=systems)

    def seeds(self, query: str = "", arguments: tuple[str, ...] = (), query_vector: list[float] | None = None, themes: DataFrame | None = None) -> Seeds:
        """What the knowledge tables say of a question: entities that it or the arguments name or its vector is near to,
        code of matched processes, sections near to its vector, and sections of relations near to themes (query, vector).
        Without vectors names alone count."""
        held = self.knowledge()
        semantic = K.semantic_seeds(held["section_vectors"], query_vector) if "section_vectors" in held else None
        theme = K.theme_seeds(held["relation_vectors"], held["relations"], themes) if themes is not None and "relation_vectors" in held else None
        if "entities" not in held:
            return Seeds(semantic, theme)
        similar = K.similar_entities(held["entity_vectors"], query_vector) if "entity_vectors" in held else None
        matched = K.match_entities(held["entities"], query, list(arguments), similar, ENTITIES_MAX)
        matched = settle(matched.withColumn("place", F.monotonically_increasing_id()), "matched")
        implements = None
        if "steps" in held:
            implements = K.implements_seeds(matched, held["steps"], held["systems"], self._code(), self._shown(self.table("refs")))
        return Seeds(semantic, theme, K.entity_seeds(matched, held["mentions"]), implements)

    def _code(self) -> DataFrame:
        return self._shown(self.table("symbols")).filter(T.language_class(T.language(F.col("path"))) == "code").select("symbol_id", "path", "name")

    def entities_text(self, query: str = "", arguments: tuple[str, ...] = (), query_vector: list[float] | None = None, limit: int = 10) -> str:
        """The rendered answer about matched entities; the sections it cites are recorded."""
        held = self.knowledge()
        if not {"entities", "mentions", "relations", "steps", "systems"} <= set(held):
            return render.entities_text([])
        similar = K.similar_entities(held["entity_vectors"], query_vector) if "entity_vectors" in held else None
        matched = self.entities(held["entities"], query, arguments, similar, limit)
        matched = settle(matched.withColumn("place", F.monotonically_increasing_id()), "matched")
        symbols = self._shown(self.table("symbols"))
        sections = symbols.select(F.col("symbol_id").alias("section"), "path", "name", "line_start", "line_end")
        refs = self._shown(self.table("refs"))
        mentioned = refs.join(sections.withColumnRenamed("path", "_p"), (F.col("path") == F.col("_p")) & F.col("line").between(F.col("line_start"), F.col("line_end"))).select("section", refs["name"])
        own = K.section_links(held["steps"], mentioned, self._code(), refs)
        spelled = K.system_links(held["systems"], self._code(), refs).drop("system").distinct()
        rows = K.entities_answer(matched, held, sections, K.implemented_by(own, spelled)).collect()
        cited = list(dict.fromkeys((s["path"], s["name"]) for r in rows for s in r.sections or ()))
        if cited:
            asked = self.spark.createDataFrame([(i + 1, *c) for i, c in enumerate(cited)], "rank int, path string, name string")
            found = asked.join(symbols.select("path", "name", "symbol_id", "line_start", "signature"), ["path", "name"]).dropDuplicates(["path", "name"])
            self._record("entities", query, (), None, limit, found.withColumn("score", R.reciprocal(F.col("rank"))).withColumn("served", F.lit(True)))
        return render.entities_text(rows)

    def doctor_text(self) -> str:
        """The state of the knowledge layer."""
        _, at = self._knowledge_at()
        said = json.loads(locks.text_of(self.spark, f"{at}/meta.json") or "{}") if at else {}
        queue = settle(self.queue(), "queue")
        failed = queue.filter(F.col("attempts") >= incremental.MAX_ATTEMPTS).orderBy("symbol_id")
        return render.doctor_text(queue.filter(F.col("attempts") < incremental.MAX_ATTEMPTS).count(), failed.limit(1000).collect(), said.get("dim"), said.get("model"))

    def skipped(self) -> DataFrame:
        return self.table("files").filter("skipped_reason is not null").select("path", "skipped_reason")

    def status(self) -> DataFrame:
        rows = self.table("files")
        return rows.agg(F.count("*").alias("scanned"), F.count_if(F.col("skipped_reason").isNull()).alias("indexed"), F.count_if(F.col("skipped_reason").isNotNull()).alias("skipped"))
