"""The knowledge layer, the index's writers and states, authored configuration, and rendered answers."""

from __future__ import annotations

import builtins
import os
import re
import subprocess
import time
from types import SimpleNamespace as Row

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_engine import TREE

from lodeline import locks, storage
from lodeline.engine import Engine
from lodeline.functions import stem as S
from lodeline.functions import text as T
from lodeline.operators import evaluate as E
from lodeline.operators import graph as G
from lodeline.operators import incremental as I
from lodeline.operators import knowledge as K
from lodeline.operators import rank as R
from lodeline.operators import render
from lodeline.operators import vectors as V
from lodeline.sources import config, files, git


@pytest.fixture()
def tree(tmp_path):
    for path, text in TREE.items():
        p = tmp_path / "tree" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path / "tree"


def space(tree):
    return files.Workspace((("", str(tree)),))


def counts(df):
    return {r.change: r["count"] for r in df.collect()}


# --- graph and vectors beyond their bounds


def test_pagerank_of_names_by_joins(spark, monkeypatch):
    defs = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("b", "y"), ("d", "z"), ("a", "w")], "file string, name string")
    refs = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 2), ("c", "z", 1), ("d", "x", 4), ("e", "y", 2), ("f", "none", 9), ("gone", "x", 1)], "file string, name string, count int")
    nodes = spark.createDataFrame([(n, 1.0 + (n == "e") * 5) for n in "abcdef"], "node string, p double")
    arrays = {r.node: r.rank for r in G.pagerank_of_names(nodes, defs, refs).collect()}
    fan_out = {r.node: r.rank for r in G.pagerank(nodes, G.projected(G.weighted_edges(defs, refs))).collect()}
    monkeypatch.setattr(G, "KERNEL_EDGES", 3)
    monkeypatch.setattr(G, "projected", lambda *a: pytest.fail("the fan-out is not built"))
    joins = {r.node: r.rank for r in G.pagerank_of_names(nodes, defs, refs, iterations=50).collect()}
    assert sum(joins.values()) == pytest.approx(1)
    for node, rank in arrays.items():
        assert joins[node] == pytest.approx(rank, abs=1e-12) == pytest.approx(fan_out[node], abs=1e-9)


def test_joins_without_steps_where_no_file_defines_and_refers(spark, monkeypatch):
    defs = spark.createDataFrame([("s1", "x"), ("s2", "x"), ("s2", "y"), ("s3", "z")], "file string, name string")
    refs = spark.createDataFrame([("c1", "x", 3), ("c1", "y", 1), ("c2", "y", 2), ("c3", "none", 4)], "file string, name string, count int")
    nodes = spark.createDataFrame([(n, 1.0 + 4 * (n == "c2")) for n in ("s1", "s2", "s3", "c1", "c2", "c3")], "node string, p double")
    arrays = {r.node: r.rank for r in G.pagerank_of_names(nodes, defs, refs).collect()}
    monkeypatch.setattr(G, "KERNEL_EDGES", 3)
    written, settle = [], G.settle
    monkeypatch.setattr(G, "settle", lambda df, name: written.append(name) or settle(df, name))
    joins = {r.node: r.rank for r in G.pagerank_of_names(nodes, defs, refs).collect()}
    assert joins == pytest.approx(arrays, abs=1e-12)
    assert len(written) < 10  # not one or more for each of the fifty steps


def test_edges_summed_where_they_arise(spark, monkeypatch):
    defs = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("b", "y"), ("a", "y")], "file string, name string")
    refs = spark.createDataFrame([("a", "x", 3), ("d", "y", 1), ("d", "x", 2), ("b", "none", 4)], "file string, name string, count int")
    want = sorted([("a", "b", 1.0, 1), ("a", "c", 1.0, 1), ("d", "a", 0.5 + 2 / 3, 2), ("d", "b", 0.5 + 2 / 3, 2), ("d", "c", 2 / 3, 1)])
    for most in (1000, 2):  # the second deals a name's definers into several lists
        monkeypatch.setattr(G, "LIST_FILES", most)
        found = G.projected_names(defs, refs)
        assert sorted((r.src, r.dst, pytest.approx(r.weight), r.names) for r in found.collect()) == want
        edges = G.weighted_edges(defs, refs)
        assert sorted((r.src, r.dst, r.name, r.weight) for r in edges.collect()) == [("a", x, "x", 1.0) for x in "abc"] + [("d", "a", "x", 2 / 3), ("d", "a", "y", 0.5), ("d", "b", "x", 2 / 3), ("d", "b", "y", 0.5), ("d", "c", "x", 2 / 3)]
    # the last exchange moves references by file alone, no edges by their pairs
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(src" in plan and "hashpartitioning(src#0, dst" not in re.sub(r"#\d+", "#0", plan)


def test_weights_rounded_once_for_each_reference(spark):
    defs = spark.createDataFrame([(x, "x") for x in "abc"], "file string, name string")
    refs = spark.createDataFrame([("d", "x", 2)], "file string, name string, count int")
    edges = G.weighted_edges(defs, refs, digits=3)
    assert {r.weight for r in edges.collect()} == {0.667} and edges.count() == 3
    above, below = edges._jdf.queryExecution().optimizedPlan().toString().split("Generate explode", 1)
    assert "round(" in below and "round(" not in above


def test_parts_grow_with_rows(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("id", "id % 100 AS k")
    assert storage.spread(rows, 1000, "k") is rows  # few rows stay as the session deals them
    monkeypatch.setattr(storage, "PART_ROWS", 50)
    assert storage.spread(rows, 1000, "k").rdd.getNumPartitions() == 20
    refs = rows.selectExpr("concat('f', id) AS file", "k AS name", "1L AS count")
    top = R.referenced_by(rows.selectExpr("concat('d', id) AS file", "k AS name"), refs, rows=1000)
    assert top.count() == 1000 and "hashpartitioning(name" in (plan := top._jdf.queryExecution().executedPlan().toString()) and ", 20)" in plan


def test_windows_are_not_shuffled_by_word(spark):
    systems = spark.createDataFrame([("Ledger",), ("Red Widget",), ("ab",)], "system string")
    symbols = spark.createDataFrame([(1, "openLedger"), (2, "red widget bolt"), (3, "ledge r"), (4, "red"), (1, "openLedger")], "id int, name string")
    found = K.system_matches(systems, symbols)
    assert sorted((r.id, r.system) for r in found.collect()) == [(1, "Ledger"), (2, "Red Widget"), (3, "Ledger")]
    assert "BroadcastHashJoin" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(norm" not in plan
    assert "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()


def test_stems_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "KNOWN_WORDS", 2)
    monkeypatch.setattr(S, "PIECE_WORDS", 3)
    texts = ["Running dogs", None, "", "Été flies, dogs run", "one two three four", "last"]
    (found,) = S._stemmed(iter([pa.array(texts)]))
    assert found.to_pylist() == [["run", "dog"], [], [], ["et", "fli", "dog", "run"], ["on", "two", "three", "four"], ["last"]]
    assert not hasattr(S, "pd")  # Arrow arrays, no pandas objects


def test_nearest_in_blocks(spark, monkeypatch):
    rows = spark.range(60).selectExpr("id", "array(cast(id AS double), cast(60 - id AS double)) AS v")
    asked = rows.select(F.col("id").alias("query"), F.col("v").alias("vector"))
    want = sorted(map(tuple, V.knn_many(rows, "id", "v", asked, 3).collect()))
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, V.knn_many(rows, "id", "v", asked, 3).collect())) == want


# --- the index


def test_large_files_are_not_opened(spark, tree, monkeypatch):
    (tree / "big.md").write_text("x" * (1 << 20) + "y")
    (tree / "pic.png").write_text("z")
    opened = []
    real = builtins.open
    monkeypatch.setattr(builtins, "open", lambda p, *a, **k: opened.append(str(p)) or real(p, *a, **k))
    import pandas as pd

    listed = files.listing(spark, space(tree))
    rows = files.read(listed)
    assert {r.path: r.skipped_reason for r in rows.select("path", "skipped_reason").collect() if r.path in ("big.md", "pic.png", "package-lock.json", ".env")} == {"big.md": "too-large", "pic.png": "unsupported-language", "package-lock.json": "lockfile", ".env": "denylisted"}
    os.chmod(tree / "big.md", 0)
    assert rows.filter("path = 'big.md'").first().content is None
    frames = list(files._contents(iter([pd.DataFrame([(f"p{i}", str(tree / "src/log.ts"), 1, 1, None) for i in range(40)], columns=["path", "file", "size", "mtime_ms", "skipped_reason"])])))
    assert sum(len(f) for f in frames) == 40 and not any("big.md" in p for p in opened)


def test_listing_by_tasks_is_the_walk(spark, tmp_path):
    root = tmp_path / "deep"
    for path, text in {"a/b/c/d.md": "x", "a/b/c/e.log": "x", "a/b/keep.log": "x", "a/x.md": "x", ".gitignore": "*.log\n/a/skip/\n", "a/b/.gitignore": "!keep.log\nc/z*\n", "a/b/c/z1.md": "x", "a/skip/q.md": "x", "k/.git/config": "x", "k/l/m/n/o.ts": "x", "top.ts": "x"}.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (root / "a/b/c/out.md").symlink_to("/etc/hostname")
    want, outside = files.list_tree(str(root))
    assert want == [".gitignore", "a/b/.gitignore", "a/b/c/d.md", "a/b/keep.log", "a/x.md", "k/l/m/n/o.ts", "top.ts"] and outside == [("a/b/c/out.md", "outside-root")]
    got = {r.path: r.skipped_reason for r in files.listing(spark, space(root)).collect()}
    assert got == dict.fromkeys(want) | {"a/b/c/out.md": "outside-root"}
    two = files.listing(spark, files.Workspace((("one", str(root / "a")), ("two", str(root / "k"))))).collect()
    assert {r.path for r in two} >= {"one/x.md", "one/b/c/d.md", "two/l/m/n/o.ts"}


def test_languages_are_exact(spark):
    got = {r.p: r.l for r in spark.createDataFrame([("a.TS",), ("a.ts",), ("x/md",), ("md",), ("a.b/c",)], "p string").select("p", T.language(F.col("p")).alias("l")).collect()}
    assert got == {"a.TS": None, "a.ts": "typescript", "x/md": None, "md": "markdown", "a.b/c": None}


def test_refresh_tiers_and_passes(spark, tree, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "index"))
    first = counts(engine.refresh(space(tree), most=5))
    assert first["new"] == 5 and first["remaining"] > 5 and engine.meta()["remaining"] == str(first["remaining"])
    assert "remaining" not in counts(engine.refresh_within(space(tree), 300, pass_files=8))
    whole = Engine(spark, str(tmp_path / "other"))
    whole.refresh(space(tree))
    for name in ("symbols", "refs", "sections"):
        assert sorted(map(str, engine.table(name).collect())) == sorted(map(str, whole.table(name).collect()))
    assert engine.index_version() == whole.index_version()
    # touched: read, but its hash is as before, so it is not extracted
    os.utime(tree / "src/log.ts", (1, 1))
    seen = []
    real = files.extracted
    monkeypatch.setattr(files, "extracted", lambda df, *a: seen.extend(r.path for r in df.select("path").collect()) or real(df, *a))
    assert counts(engine.refresh(space(tree)))["changed"] == 1 and seen == []
    assert engine.table("files").filter("path = 'src/log.ts'").first().mtime_ms == 1000
    assert sorted(map(str, engine.table("symbols").collect())) == sorted(map(str, whole.table("symbols").collect()))


def test_git_head(spark, tree, tmp_path):
    assert git.head(str(tree)) is None
    run = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q", "-b", "main")
    assert git.head(str(tree)) is None
    run("add", ".")
    run("commit", "-qm", "x")
    want = run("rev-parse", "HEAD")
    assert git.head(str(tree)) == want
    engine = Engine(spark, str(tmp_path / "index"))
    engine.refresh(space(tree))
    assert engine.meta()["git_head"] == want and f"HEAD {want[:7]}" in engine.freshness()
    run("pack-refs", "--all")
    assert not os.path.exists(tree / ".git/refs/heads/main") and git.head(str(tree)) == want
    run("checkout", "-q", "--detach")
    assert git.head(str(tree)) == want
    run("worktree", "add", "-q", "-b", "side", str(tmp_path / "side"))
    assert git.head(str(tmp_path / "side")) == want
    assert git.heads((("a", str(tree)), ("b", str(tmp_path)))) == f"a:{want[:7]}"


def test_one_writer_and_compare_and_swap(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "store")
    with locks.Writer(spark, place):
        with pytest.raises(locks.Conflict):
            locks.Writer(spark, place).__enter__()
    with locks.Writer(spark, place):
        pass
    locks.create(spark, f"{place}/LOCK", f"dead {time.time() - 60}")
    with locks.Writer(spark, place):  # a stale lock is taken over
        pass
    assert [locks.take_next(spark, f"{place}/ids") for _ in range(3)] == [1, 2, 3]
    assert locks.take_next(spark, f"{place}/ids", "x", after=3) == 4 and locks.text_of(spark, f"{place}/ids/4") == "x"
    with pytest.raises(locks.Conflict):
        locks.take_next(spark, f"{place}/ids", after=3)


# --- queue and claims


def test_sections_are_queued_and_claimed_once(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    engine.refresh(space(tree))
    n = engine.table("sections").count()
    assert engine.queue().count() == n > 2
    now = int(time.time() * 1000)
    one, mine = engine.claim(2, now)
    two, other = engine.claim(n, now + 1)
    ids = {r.symbol_id for r in mine.collect()}
    assert len(ids) == 2 and not ids & {r.symbol_id for r in other.collect()} and other.count() == n - 2
    assert engine.claim(n, now + 2)[1].count() == 0
    time.sleep(0.05)
    engine.report(mine, "failed", "no answer", one)
    left = {r.symbol_id: r for r in engine.queue().collect()}
    assert all(left[i].attempts == 1 and left[i].last_error == "no answer" and left[i].stamp is None for i in ids)
    assert "pending: " in engine.doctor_text()
    engine.report(other, "extracted", stamp=two)
    assert {r.symbol_id for r in engine.queue().collect()} == ids
    # a claim that is stale is free again
    late = int(time.time() * 1000) + 1
    assert engine.claim(1, late)[1].count() == 1 and engine.claim(2, late + 1)[1].count() == 1 and engine.claim(2, late + 2)[1].count() == 0
    assert engine.claim(2, late + I.STALE_CLAIM_MS + 10)[1].count() == 2
    (tree / "notes/guide.md").write_text("# Opening sessions\n\nanew\n")
    engine.refresh(space(tree))
    assert engine.queue().count() >= 2


def test_claims_at_the_same_time(spark):
    log = [(1, 9, "h", "queued", None, None, 0), (2, 9, "h", "claimed", None, "b", 10), (3, 9, "h", "claimed", None, "a", 10), (4, 9, "h", "claimed", None, "c", 11), (5, 8, "h", "claimed", None, "x", 5), (6, 8, "h", "released", None, "x", 6), (7, 7, "h", "claimed", None, "x", 5), (8, 7, "h", "claimed", None, "y", 5 + I.STALE_CLAIM_MS + 1)]
    got = {r.symbol_id: r.stamp for r in I.claims(spark.createDataFrame(log, I.QUEUE_LOG)).collect()}
    assert got == {9: "a", 7: "y"}


# --- search and answers


def test_stemmed_search_in_map_and_find(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    engine.refresh(space(tree))
    rows = {(r.path, r.name): r for r in engine.ranked("sessions").collect()}
    hit = rows["src/session.ts", "openSession"]
    assert hit.fts_hit and hit.query_ident_match and hit.share > 0
    assert {r.name for r in engine.ranked("texting").collect() if r.body} == {"Details"}
    store = engine.find_symbol("Store").first()
    assert (store.n_files, store.n_own) == (0, 1)
    assert "   referenced from 0 files, 1 in this file\n" in engine.find_text("Store", limit=1)
    assert engine.find_text("openSession", limit=1).startswith("src/session.ts:3  function  export function openSession(user: string)\n   referenced from 3 files: src/mid.ts (2), ")
    assert engine.find_text("nothing at all like it") == "no symbols matched\n"


def test_rendered_traces_blasts_and_changes(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    engine.refresh(space(tree))
    text = engine.trace_text("src/mid.ts::guard", "src/session.ts::openSession")
    assert text == "src/mid.ts::guard → src/session.ts::openSession (references openSession)\n# 1 hop\n"
    assert engine.trace_text("src/log.ts::log", "src/log.ts::log") == "src/log.ts::log → src/log.ts::log (same file)\n# 0 hops\n"
    assert spark.read.parquet(str(tmp_path / "index/log/retrievals")).filter("tool = 'trace_path'").count() == 2
    hops = [("a", "f", "b", True), ("b", "g", "c", False), ("c", "h", "d", False)]
    assert render.trace_text(("a", "s"), ("d", "t"), hops) == "a::s → b::f (references f)\nb::f → c::h (referenced through g)\nc::h → d::t (referenced through h)\n# 3 hops\n"
    assert render.trace_symbols(("a", "s"), ("d", "t"), hops) == [("a", "s"), ("b", "f"), ("b", "g"), ("c", "h"), ("d", "t")]
    assert render.trace_anchors("s", "t", [("a", "f", "b", False), ("b", "g", "c", True)]) == ["s", None, "t"]
    blast = engine.blast_text("src/log.ts", "log")
    assert "src/session.ts  (depth 1, via log)\n" in blast and blast.splitlines()[-1].startswith("# ")
    ranges = spark.createDataFrame([("src/session.ts", 3, 3), ("ci.yml", 90, 91)], "path string, first int, last int")
    changed = engine.changed_text(ranges, "abc")
    assert [(r.tool, r.query) for r in spark.read.parquet(str(tmp_path / "index/log/retrievals")).filter("tool = 'changed'").collect()] == [("changed", "abc")]
    assert changed.startswith("src/session.ts::openSession (lines 3-5)  ← ") and "ci.yml (no symbol touched)\n# 1 symbol in 2 files changed since abc · " in changed


def test_reports(spark):
    rows = [Row(id="q1", category="a", recall=1.0, precision=0.5, miss=[]), Row(id="q2", category="a", recall=0.5, precision=1.0, miss=["x::y"]), Row(id="q3", category="", recall=1.0, precision=1.0, miss=[])]
    assert render.report_text(rows).splitlines() == ["q1  a  recall 1.00  precision 0.50", "q2  a  recall 0.50  precision 1.00  missed x::y", "q3    recall 1.00  precision 1.00", "# mean recall 0.83 over 3 questions", "#   a: 1 of 2 cited", "#   none: 1 of 1 cited"]
    got = spark.createDataFrame([(None,), (10,), (99_999,), (500,)], "b int").select(E.walk_budget(F.col("b"), None, 300).alias("x")).collect()
    assert [r.x for r in got] == [300, 64, 8192, 500]
    records = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.0), ("r", "a", 0.0)], "question string, condition string, recall double")
    assert {r.question: (r.a, r.b) for r in E.run_summary(records, ["a", "b"]).collect()} == {"q": (1.0, 0.0), "r": (0.0, None), None: (0.5, 0.0)}


def test_reasons_and_answers_of_models(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.json_answer(F.lit('Sure:\n{"a": {"b": 1}} done'))) == '{"a": {"b": 1}}' and one(T.json_answer(F.lit("none"))) is None
    assert [one(T.is_per_request_failure(F.lit(x))) for x in ("x: HTTP 503", "timed out after 9 s", "connection refused", "answer is not JSON")] == [True, True, False, True]
    r = spark.sql("SELECT named_struct('score', 0.5D, 'referenced_by', array(named_struct('path', 'a/b.ts', 'count', 2L), named_struct('path', 'c.ts', 'count', 1L)), 'seeds', array('focus', 'query:open it'), 'query_ident_match', true, 'fts_hit', true, 'note_hit', false, 'body_hit', true, 'semantic', 0.25D, 'entities', array('Ledger'), 'themes', cast(null AS array<string>), 'implements', array('P', 'Q'), 'pinned', false) AS r")
    said = r.select(T.reason_sentences(F.col("r"), F.lit(2)).alias("x")).first().x
    assert said == ["Ranked 2nd, score 0.50.", "Referenced from b.ts (2) and c.ts (1).", "Matched the query on open it.", "Matches the text of the section.", "Semantically close to the query (0.25).", "Mentions Ledger.", "Implements P, Q.", "You focused this file."]


def test_labels_and_reports_of_walks(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(T.client_slug(F.lit(x))) for x in (" My: Client\u00a0App ", "", ":")] == ["my-client-app", "unknown", "unknown"]
    assert one(T.tool_label(F.lit("repo_map"))) == "Map" and one(T.tool_label(F.lit("x"))) == "x"
    assert one(T.language_group(F.lit("toml"))) == "config" and one(T.language_group(F.lit(None).cast("string"))) == "code"
    assert one(T.rfc3339(F.lit(1_700_000_000_123))) == "2023-11-14T22:13:20Z"
    rows = [Row(id="w1", kind="locate", passed=True, reached=["a::b"], reason=None), Row(id="w2", kind="change", passed=False, reached=[], reason="nothing reached")]
    assert render.walks_text(rows) == "id    kind        pass  reached / reason\nw1    locate      yes   a::b\nw2    change      no    nothing reached\nwalks 1/1 locate\nwalks 0/1 change\nwalks 1/2\n"
    assert render.doctor_text(3, [Row(last_error="e")], None, None) == "embedding model: none\nembedding dimension: unknown\npending: 3 sections · failed: 1 · last error: e\n"


def test_workspace_file(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    assert files.open_workspace(str(tmp_path)).roots == (("", str(tmp_path)),)
    (tmp_path / "workspace.toml").write_text('deny = ["*.tmp"]\n[[root]]\nname = "one"\npath = "a"\n[[root]]\nname = "two"\npath = "b"\n')
    found = files.open_workspace(str(tmp_path))
    assert found.roots == (("one", str(tmp_path / "a")), ("two", str(tmp_path / "b"))) and found.deny == ("*.tmp",)
    for bad in ('[[root]]\nname = "a b"\npath = "a"\n', '[[root]]\nname = "x"\npath = "gone"\n'):
        (tmp_path / "workspace.toml").write_text(bad)
        with pytest.raises(ValueError):
            files.open_workspace(str(tmp_path))


# --- authored configuration


def test_map_file_keeps_comments_and_refuses_lost_updates(tmp_path):
    path = str(tmp_path / "map.toml")
    (tmp_path / "map.toml").write_text('# ours\ntitle = "x"\n\npins = ["a.ts", # first\n  "b].ts"]\n\n# why\n[[note]]\npath = "a.ts"\ntext = "one"\n\n[[note]]\npath = "b.ts"\nsymbol = "f"\ntext = "two"\n\n[other]\nk = 1 # stays\n')
    held = config.load(path)
    assert held.pins == ("a.ts", "b].ts") and held.notes == (("a.ts", None, "one"), ("b.ts", "f", "two"))
    new = config.save(path, config.MapFile(("a.ts", "c.ts"), ("dist/",), (("b.ts", "f", "two"), ("c.ts", None, "three")), held.stamp))
    text = (tmp_path / "map.toml").read_text()
    assert "# ours" in text and "# why" in text and "k = 1 # stays" in text and 'title = "x"' in text
    assert (new.pins, new.excludes, new.notes) == (("a.ts", "c.ts"), ("dist/",), (("b.ts", "f", "two"), ("c.ts", None, "three")))
    with pytest.raises(locks.Conflict):
        config.save(path, held)
    fresh = str(tmp_path / "none.toml")
    assert config.save(fresh, config.MapFile(pins=("x",))).pins == ("x",)
    for bad in ("", "/x", "../x", "a/../b", "./a", "a//b", "a\\b", "C:x"):
        with pytest.raises(ValueError):
            config.check_path(bad)
    assert config.check_path("dist/") == "dist/"


# --- knowledge


def knowledge(spark):
    entities = [(7, "a.md", 1, 0, "Pay", "process", "how we pay"), (7, "a.md", 1, 1, "Clerk", "role", ""), (7, "a.md", 1, 2, "Open Session", "system", "opens"), (8, "b.md", 1, 0, "clerk", "person", "works"), (8, "b.md", 1, 1, "Store", "system", "")]
    relations = [(7, "a.md", 1, 0, "Clerk", "Open Session", "uses"), (8, "b.md", 1, 0, "Store", "clerk", "serves"), (8, "b.md", 1, 1, "Store", "store", "itself")]
    steps = [(7, "a.md", 1, "Pay", 1, "open it", "Clerk", ["Open Session", " "]), (7, "a.md", 1, "Pay", 2, " ", "", []), (7, "a.md", 1, "Pay", 3, "close it", "", [])]
    where = "section long, path string, line int, "
    return {
        "entities": spark.createDataFrame(entities, where + "ordinal int, name string, type string, description string"), "relations": spark.createDataFrame(relations, where + "ordinal int, source string, target string, description string"),
        "steps": spark.createDataFrame(steps, where + "process string, ordinal int, text string, role string, systems array<string>"),
    }


def test_apply_steps_resolves_inside_the_section(spark):
    said = knowledge(spark)
    entities, mentions, _ = K.apply_extraction(said["entities"], said["relations"], "path", "line", "ordinal")
    steps = K.normalise_steps(said["steps"])
    assert [(r.ordinal, r.text, r.systems) for r in steps.orderBy("ordinal").collect()] == [(1, "open it", ["Open Session"]), (2, "close it", [])]
    out, placed, systems = K.apply_steps(steps, entities, mentions)
    ids = {r.norm_name: r.entity_id for r in out.collect()}
    assert {r.norm_name: r.type for r in out.collect()} == {"pay": "process", "clerk": "role", "open session": "system", "store": "system"}
    assert [(r.process_id, r.role_id) for r in placed.orderBy("ordinal").collect()] == [(ids["pay"], ids["clerk"]), (ids["pay"], None)]
    assert [(r.system, r.entity_id) for r in systems.collect()] == [("Open Session", ids["open session"])]
    made, _, _ = K.apply_steps(steps.withColumn("process", F.lit("Refund")), entities, mentions)
    assert {r.name: r.type for r in made.collect()}["Refund"] == "process"


def test_tick_seeds_and_answers(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    engine.refresh(space(tree))
    n = engine.queue().count()

    def extract(rows):
        guide = rows.filter("name = 'Opening sessions'").select(F.col("symbol_id").alias("section"), "path", F.col("line_start").alias("line"))
        said = knowledge(spark)
        parts = {name: guide.crossJoin(F.broadcast(t.filter("section = 7").drop("section", "path", "line"))) for name, t in said.items()}
        return parts, rows.filter("name = 'Details'").select("symbol_id", F.lit("no answer").alias("error"))

    assert engine.tick(extract, extracts=n) == n
    assert [r.last_error for r in engine.queue().collect()] == ["no answer"]
    held = engine.knowledge()
    assert {r.name: r.type for r in held["entities"].collect()} == {"Pay": "process", "Clerk": "role", "Open Session": "system"}
    guide = engine.table("symbols").filter("name = 'Opening sessions'").first().symbol_id
    open_ = engine.table("symbols").filter("name = 'openSession'").first().symbol_id
    seeds = engine.seeds("how does the clerk work", ("pay",))
    assert {(r.symbol_id, r.name) for r in seeds.entities.collect()} == {(guide, "Pay"), (guide, "Clerk")}
    assert {(r.symbol_id, r.name) for r in seeds.implements.collect()} == {(open_, "Open Session")}
    assert seeds.semantic is None and seeds.themes is None
    ranked = {(r.path, r.name): r for r in engine.ranked("how does the clerk work", seeds=seeds).collect()}
    assert "entity:Pay" in ranked["notes/guide.md", "Opening sessions"].seeds and "implements:Open Session" in ranked["src/session.ts", "openSession"].seeds
    own, said, told = engine.entity(" CLERK. ")
    assert own.first().type == "role" and [(r.src_name, r.dst_name) for r in said.collect()] == [("Clerk", "Open Session")] and [r.section for r in told.collect()] == [guide] and engine.entity("nobody") is None
    text = engine.entities_text("the clerk")
    assert text.startswith("Clerk (role)\n  ← notes/guide.md::Opening sessions (lines 3-") and "  Clerk → Open Session: uses (notes/guide.md::Opening sessions, lines 3-" in text
    assert "Pay (process, via step): how we pay\n" in text and "  1. open it — role: Clerk — systems: Open Session — notes/guide.md::Opening sessions — code: src/session.ts::openSession" in text
    assert text.splitlines()[-1] == "# 2 entities · 1 relation · 2 steps · 1 section"
    # vectors
    relation = held["relations"].first().relation_id
    v = "vector array<double>"
    engine.put_knowledge("m", 2, section_vectors=spark.createDataFrame([(guide, [1.0, 0.0]), (open_, [-1.0, 0.0])], f"symbol_id long, {v}"), relation_vectors=spark.createDataFrame([(relation, [0.0, 1.0])], f"relation_id long, {v}"), entity_vectors=spark.createDataFrame([(r.entity_id, [1.0, 0.1] if r.name == "Pay" else [-1.0, 0.0]) for r in held["entities"].collect()], f"entity_id long, {v}"))
    near = engine.seeds("anything", (), [1.0, 0.0], spark.createDataFrame([("t", [0.1, 1.0])], f"query string, {v}"))
    assert [r.symbol_id for r in near.semantic.collect()] == [guide] == [r.symbol_id for r in near.themes.collect()] and {r.name for r in near.entities.collect()} == {"Pay"}
    # another model drops the vectors and queues all sections; sections that go take their knowledge along
    engine.put_knowledge("other", 2, section_vectors=spark.createDataFrame([(guide, [1.0, 0.0])], f"symbol_id long, {v}"))
    held = engine.knowledge()
    assert "entity_vectors" not in held and held["section_vectors"].count() == 1 and engine.queue().count() == n
    (tree / "notes/guide.md").unlink()
    engine.refresh(space(tree))
    assert engine.knowledge()["entities"].count() == 0 == engine.knowledge()["steps"].count()


def test_embedding_with_a_cache(spark):
    texts = spark.createDataFrame([(f"h{i}", f"t{i}") for i in range(5)], "hash string, text string")
    cache = spark.createDataFrame([("h0", "m", [1.0, 2.0]), ("h1", "other", [1.0, 2.0]), ("h2", "m", [1.0])], "hash string, model string, vector array<double>")
    asked = []

    def embed(rows):
        asked.extend(r.hash for r in rows.collect())
        return rows.select("hash", F.array(F.lit(0.5), F.lit(0.5)).alias("vector"))

    every, gained = K.embedded(texts, cache, "m", 2, embed, most=3)
    assert sorted(asked) == ["h1", "h2", "h3"] and {r.hash for r in every.collect()} == {"h0", "h1", "h2", "h3"} and {(r.hash, r.model) for r in gained.collect()} == {(h, "m") for h in ("h1", "h2", "h3")}
    have, lack = K.lacking(texts, every, "hash")
    assert have.count() == 4 and [r.hash for r in lack.collect()] == ["h4"]
