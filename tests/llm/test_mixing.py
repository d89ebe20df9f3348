"""Mixing: targets against a plain version, and which documents a budget takes."""

from __future__ import annotations

import numpy as np
import pytest
from test_against_brute_force import brute_targets

from lodeline.llm import mixing


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(4)
    sizes = {f"s{k:04d}é{k % 3}": int(x) for k, x in enumerate(rng.pareto(0.7, 700) * 10)} | {None: 17, "": 0}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5), mixing.WEIGHTS).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    assert got == {s: pytest.approx(t) for s, t in want.items()}
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long"), mixing.WEIGHTS).count() == 0


def test_every_length_has_the_same_share():
    """Distinct lengths: the shorter and the longer half, and every tenth, are taken alike."""
    lengths, counts = list(range(100, 2100)), [1] * 2000
    budget = sum(lengths) // 2
    tenths = np.zeros(10)
    for seed in range(20):
        take = np.array(mixing.fit(lengths, counts, budget, seed))
        assert (take * np.array(lengths)).sum() == budget
        assert abs(take[:1000].mean() - take[1000:].mean()) < 0.03
        tenths += take.reshape(10, 200).mean(axis=1) / 20
    assert abs(tenths - 0.5).max() < 0.03
    assert mixing.fit(lengths, counts, budget, 1) == mixing.fit(lengths, counts, budget, 1) != mixing.fit(lengths, counts, budget, 2)


def test_fit_is_exact_where_any_sum_is():
    rng = np.random.default_rng(6)
    for _ in range(60):
        lengths = sorted(set(rng.integers(0, 30_000, int(rng.integers(1, 300))).tolist()))
        counts = rng.integers(1, 50, len(lengths)).tolist()
        total = sum(n * c for n, c in zip(lengths, counts, strict=True))
        budget = int(rng.integers(0, total + 1))
        take = mixing.fit(lengths, counts, budget, 3)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        assert abs(sum(n * t for n, t in zip(lengths, take, strict=True)) - budget) <= (1 if len(lengths) > 60 else max(lengths))
    assert mixing.fit([7], [9], 30) == [4] and mixing.fit([0, 7], [5, 1], 3) == [0, 0] and mixing.fit([0], [5], 0) == [5]


def test_extra_columns_and_hot_source(spark):
    table = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, repeat('w ', cast(id % 211 AS int)), repeat('v ', 50)) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 90)) AS source", "1 AS size", "2 AS take", "3 AS target", "4 AS n")
    rows = mixing.mix(table).collect()
    assert len(rows) == 3000 and {r.doc_id: r.size for r in rows}[6] == 6
    taken = sum(r.taken for r in rows)
    assert abs(taken - 1.5 * sum(r.size for r in rows)) < 40 * 50
