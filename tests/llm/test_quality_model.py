"""Quality model: held-out labels, posteriors against a plain version, hosts that shrink, labels and columns out of order."""

from __future__ import annotations

import math

import numpy as np
import pytest
from test_against_brute_force import DOCS, ODD

from lodeline.llm import quality_model as Q


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def wide(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_labels(wide):
    table, labels = wide
    got = Q.judge(table, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_edges(odd, wide):
    _, labels = wide
    rows = Q.judge(odd, labels.limit(0)).collect()
    assert len(rows) == len(ODD) and [r.kept for r in rows if r.doc_id in (1, 2, 3)] == [False] * 3 and all(r.kept for r in rows if r.doc_id in (4, 6, None))
    one = labels.filter("quality = 1")
    assert all(r.evidence == 0 for r in Q.judge(odd, one).collect() if r.doc_id not in (1, 2, 3))
    assert Q.judge(odd.limit(0), labels).count() == 0 == Q.keep(odd.limit(0), labels).count()


def test_columns_of_any_name_pass(odd, wide):
    _, labels = wide
    clash = odd
    for name in ("_host", "_path", "_share", "_kept", "_evidence", "_probability", "host", "path", "evidence", "probability", "row", "micro", "n", "a.b", "y", "x"):
        clash = clash.withColumn(name, odd.doc_id)
    kept = Q.keep(clash, labels)
    assert kept.columns == clash.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in clash.collect() if r.doc_id not in (1, 2, 3))
    assert Q.judge(clash, labels).columns == ["doc_id", "evidence", "probability", "kept"]


def test_repeated_ids_and_labels(spark):
    """Every label and document three times, one label contradicted once: the same fit as from single ones."""
    rng = np.random.default_rng(0)
    texts = [(k, " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) + ("!!" if k % 3 == 0 else "") for _ in range(40))) for k in range(60)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 3 > 0)) for k, _ in texts], "doc_id long, quality int")
    once, p = Q.train(docs, labels)
    thrice, q = Q.train(docs.union(docs).union(docs), labels.union(labels).union(labels).union(spark.createDataFrame([(0, 1)], "doc_id long, quality int")))
    assert p == q and np.array_equal(once.weights, thrice.weights) and once.intercept == thrice.intercept
    assert once.of(texts[0][1]) < 0 < once.of(texts[1][1])
    few, _ = Q.train(docs, labels.filter("doc_id < 4"))
    assert 0 < abs(few.of(texts[1][1])) < abs(once.of(texts[1][1]))


def test_features_of_long_texts_come_in_chunks(monkeypatch):
    text = "Ein längerer Text, mit é und | Zeichen! " * 500
    whole = Q.features(text)
    monkeypatch.setattr(Q, "_CHUNK", 97)
    assert np.array_equal(Q.features(text), whole)


def brute_posteriors(rows, evidence, prior):
    """(host, path, evidence) rows: probability of each, by plain loops."""
    logit = math.log(prior / (1 - prior))
    soft = [1 / (1 + math.exp(-(e + logit))) for e in evidence]
    micro = [round(s * 1e6) / 1e6 for s in soft]

    def total(pick):
        found = {}
        for row, m in zip(rows, micro, strict=True):
            g, n = found.get(pick(row), (0.0, 0))
            found[pick(row)] = (g + m, n + 1)
        return found

    def weight(groups, mean):
        use = [(g / n, n, mean(k)) for k, (g, n) in groups.items() if n >= 2]
        if len(use) < 2:
            return 1e6
        between, within = sum(n * (s - m) ** 2 for s, n, m in use), sum(m * (1 - m) for _, _, m in use)
        spread = sum(m * (1 - m) for _, _, m in use) / len(use)
        return min(max(spread / max(max(0.0, between - within) / sum(n for _, n, _ in use), 1e-9) - 1, 5.0), 1e6)

    hosts, paths = total(lambda r: r[0]), total(lambda r: r)
    mean = (sum(micro) + prior) / (len(micro) + 1)
    w = weight(hosts, lambda k: mean)
    share = {h: (g + w * mean) / (n + w) for h, (g, n) in hosts.items()}
    v = weight(paths, lambda k: share[k[0]])
    out = []
    for row, e, s in zip(rows, evidence, soft, strict=True):
        g, n = paths[row]
        p = min(max((g - s + v * share[row[0]]) / (n - 1 + v), 0.02), 0.98)
        out.append(1 / (1 + math.exp(-(e + math.log(p / (1 - p))))))
    return out


def test_posteriors_against_plain_loops(spark):
    rng = np.random.default_rng(9)
    rows = [(f"h{int(h)}" if h < 8 else None, f"p{int(p)}") for h, p in zip(rng.zipf(1.4, 400) % 9, rng.integers(0, 3, 400), strict=True)]
    bias = {h: rng.normal(0, 2) for h, _ in rows}
    evidence = [float(np.clip(rng.normal(bias[h], 2), -29, 29)) for h, _ in rows]
    table = spark.createDataFrame([(k, *r, e) for k, (r, e) in enumerate(zip(rows, evidence, strict=True))], "doc_id long, host string, path string, evidence double")
    known = Q.sites(table.select("host", "path", Q._micro(table.evidence, 0.7)), "host", "path", 0.7)
    got = {r.doc_id: r.probability for r in Q._posterior(table, known, 0.7).collect()}
    for k, p in enumerate(brute_posteriors(rows, evidence, 0.7)):
        assert got[k] == pytest.approx(p, abs=1e-6)


def test_sites_shrink_towards_their_host(spark):
    rows = [("big", "p", 900_000)] * 500 + [("bad", "p", 100_000)] * 500 + [("new", "p", 100_000)] + [("big", "q", 100_000)]
    table = {(r._host, r._path): r for r in Q.sites(spark.createDataFrame(rows, "source string, lang string, micro long"), "source", "lang", 0.5).collect()}
    assert table[("big", "p")]._share > 0.8 > table[("new", "p")]._share > table[("bad", "p")]._share
    assert table[("big", "q")]._share == table[("big", "p")]._share


def test_driver_gets_weights_alone(spark, monkeypatch):
    """Fitted in a task: the driver's Python held some 190 MB of features and copies of them before."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    monkeypatch.setattr(Q, "fit", lambda x, y: pytest.fail(f"{len(y)} rows on the driver"))
    evidence, _ = Q.train(docs, labels)
    assert evidence.informed and evidence.weights.shape == (Q.BUCKETS + Q.SHAPES,)


def test_labels_of_other_documents(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "en")], "doc_id long, text string, source string, lang string")
    evidence, _ = Q.train(docs, spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, quality int"))
    assert not evidence.informed and [r.kept for r in Q.judge(docs, spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, quality int")).collect()] == [True]
