"""The pipeline's stages, each held on its own input against plain versions, and on edge cases."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from test_against_brute_force import DOCS, LONG, WORD, base_measures, brute_groups, brute_leaks, check_mix

from lodeline.llm import quality_model


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    place, docs, found = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(place / str(k)))
        out = spark.read.parquet(str(place / str(k)))
        found.append((docs, out))
        docs = out
    return found


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "minhash near-dedup", "benchmark decontamination", "mixing to target weights"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() <= before.count()


def test_classifier_stage(spark, sf_dir, stages):
    before, after = stages[0]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id for r in quality_model.judge(before, labels).collect() if r.kept}
    assert {r.doc_id for r in after.collect()} == kept
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    assert len(good & kept) >= 0.98 * len(good) and len(bad & kept) <= 0.2 * len(bad)


def test_rules_stage(stages):
    before, after = stages[1]
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        n, _, _, _, repeated = base_measures(r.text)
        if n < 20 or 100 * repeated > 30 * n:
            assert r.doc_id not in kept


def test_near_dedup_stage(stages):
    before, after = stages[2]
    want = sorted(i for i, _, _, kept in brute_groups([(r.doc_id, r.text) for r in before.collect()]) if kept)
    assert sorted(r.doc_id for r in after.collect()) == want


def test_decontamination_stage(spark, sf_dir, stages):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {i for i, _ in brute_leaks([(r.doc_id, r.text) for r in before.collect()], items)}
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if r.doc_id not in hit)


def test_mixing_stage_and_run(spark, sf_dir, stages):
    before, after = stages[4]
    near, rows = check_mix(before)
    assert sorted((r.doc_id, r.taken) for r in after.collect()) == rows
    assert sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, sf_dir).collect()) == rows
    # sources are down to a few documents here: none of their sums comes nearer
    sizes: dict = {}
    for r in before.collect():
        sizes.setdefault(r.source, []).append(len(WORD.findall(r.text)))
    for source, (taken, target) in near.items():
        sums, whole = {0}, sum(sizes[source])
        for n in sizes[source]:
            sums |= {x + n for x in sums}
        best = min(abs(x + whole * int(target // whole + 1e-9) - target) for x in sums)
        assert abs(taken - target) <= max(best + 1, 0.02 * target)


def test_stages_on_odd_rows(spark, sf_dir):
    good = " ".join(f"word{i % 40} text{i}" for i in range(60)) + "."
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, good, "en", "a", len(good)), (3, good, "en", "a", len(good)), (4, good + " more", None, None, 5), (None, good, "en", "a", 3),
        (None, "other " + LONG[:4000], "en", "a", 3), (5, LONG, "en", "b", len(LONG)), (3, "entirely " + LONG[4000:8000], "en", "b", 7), (None, f"{LONG[9000:9500]} {item} {LONG[9500:9900]}", "en", "b", 7),
    ]
    table = spark.createDataFrame(rows, DOCS)
    for name in ("_gone", "rid", "row", "id", "first", "component_id", "item_id", "n_words", "kept", "taken", "n"):
        table = table.withColumn(name, table.n_chars)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, table.limit(0), sf_dir).count() == 0, name
        out = stage(spark, table, sf_dir)
        if k < 4:
            assert out.columns == table.columns
            assert not Counter(map(repr, out.collect())) - Counter(map(repr, table.collect()))
    ids = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, table, sf_dir).collect())
    assert ids == Counter({(1, None): 1, (2, ""): 1, (3, good): 1, rows[6][:2]: 1, rows[7][:2]: 1, rows[8][:2]: 1, rows[9][:2]: 1})
    ids = Counter((r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, table, sf_dir).collect())
    assert ids == Counter(r[:2] for r in rows[:-1])
