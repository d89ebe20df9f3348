"""License scan: containment against a plain version, band collisions against their formula, recall on edited passages."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import licenses

SCHEMA = "doc_id long, text string"
FILLER = " ".join(f"f{i}" for i in range(300))


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(r"[^\w]|_", text) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_licenses(spark, sf_dir):
    rows = [
        (1, "x y z Released under the MIT License. and more"), (2, f"{FILLER} This work is licensed under the GNU General Public License, version 3. {FILLER}"), (3, FILLER), (4, None), (5, ""), (6, "the MIT License"),
        (7, "Released under\nthe  'mit' LICENSE"), (9, "licensed under CC BY-NC 4.0"), (9, "licensed under CC BY-NC 4.0"), (None, "Licensed under cc by 4.0"),
    ]
    mit = next(t for name, t in licenses.TEMPLATES if t.startswith("Permission is hereby"))
    edited = mit.split()
    edited[20] = "changed"
    rows.append((8, f"{FILLER} {' '.join(edited)} {FILLER}"))
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS h", "2 AS at", "3 AS template", "4 AS license")
    got = {(r.doc_id, r.license): r for r in licenses.scan(table).collect()}
    assert set(got) == {(1, "MIT"), (2, "GPL-3.0"), (7, "MIT"), (8, "MIT"), (9, "CC-BY-NC-4.0"), (None, "CC-BY-4.0")}
    assert got[(1, "MIT")].first_word == 3 and got[(2, "GPL-3.0")].first_word == 300 and got[(8, "MIT")].first_word == 300
    assert got[(8, "MIT")].containment < 1 == got[(1, "MIT")].containment
    assert licenses.scan(table.limit(0)).count() == 0 == licenses.scan(table, ()).count()


def test_over_all_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = set()
    for r in table.collect():
        own = shingles(r.text)
        want |= {(r.doc_id, name) for name, template in licenses.TEMPLATES if len(own & shingles(template)) >= 0.75 * len(shingles(template))}
    got = {(r.doc_id, r.license) for r in licenses.scan(table).collect()}
    assert want and got == want


def test_templates_from_a_table_in_blocks(spark, monkeypatch):
    rows = [(f"L{k}", " ".join(f"t{k}w{i}" for i in range(5 + k))) for k in range(12)] + [("short", "one two"), ("none", None), (None, " ".join(f"n{i}" for i in range(9)))]
    docs = spark.createDataFrame([(k, f"{FILLER} {t} {FILLER}") for k, (_, t) in enumerate(rows)], SCHEMA)
    table = spark.createDataFrame(rows, "license string, text string")
    want = {(k, f"L{k}") for k in range(12)} | {(14, "")}
    for most in (20_000, 30, 1):
        monkeypatch.setattr(licenses, "TEMPLATE_WORDS", most)
        assert {(r.doc_id, r.license) for r in licenses.scan(docs, table).collect()} == want


@pytest.mark.parametrize("shared", [2, 3, 4, 6, 7])
def test_bands_meet_as_their_formula_says(spark, shared):
    """4000 pairs of windows of eight shingles, ``shared`` of them common."""
    rng = np.random.default_rng(shared)
    pairs = rng.integers(-(2**63), 2**63, (4000, 16 - shared), dtype=np.int64)
    table = spark.createDataFrame([(r[:8].tolist(), [*r[:shared].tolist(), *r[8:].tolist()]) for r in pairs], "a array<long>, b array<long>")
    meets = [(licenses.band_key(F.col("a"), b) == licenses.band_key(F.col("b"), b)).cast("int") for b in range(licenses.BANDS)]
    row = table.agg(F.avg(F.greatest(*meets)).alias("any"), *[F.avg(m).alias(f"b{i}") for i, m in enumerate(meets)], F.corr(meets[0], meets[1]).alias("corr")).first()
    s = shared / (16 - shared)
    for b in range(licenses.BANDS):
        assert row[f"b{b}"] == pytest.approx(s, abs=0.04)
    assert row["any"] == pytest.approx(1 - (1 - s) ** licenses.BANDS, abs=0.03) and abs(row["corr"]) < 0.06


def test_recall_on_edited_passages(spark):
    """Words of whole licenses replaced, dropped and put in; all passages that still hold 0.75 of the shingles are wanted."""
    rng = np.random.default_rng(11)
    rows, want = [], set()
    for k in range(900):
        name, template = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        text = template.split()
        for _ in range(int(rng.integers(0, max(2, len(text) // 14)))):
            at, kind = int(rng.integers(0, len(text))), int(rng.integers(0, 3))
            text[at : at + (kind < 2)] = [f"e{k}"] * (kind != 1)
        rows.append((k, f"{FILLER} {' '.join(text)} {FILLER}"))
        if len(shingles(rows[-1][1]) & shingles(template)) >= 0.75 * len(shingles(template)):
            want.add((k, name))
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(want) > 500 and len(want & got) >= 0.98 * len(want)
