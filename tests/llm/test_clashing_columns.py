"""Every operator gives the same rows whatever other columns its input holds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodeline.llm import chat, decontaminate, html_extract, licenses, mixing, near_dup, quality_model, quality_rules, token_counts, url_filter

NAMES = (
    "n", "h", "at", "low", "size", "band", "key", "label", "id", "rid", "row", "host", "path", "score", "verdict", "rule", "grams", "features", "words", "kept", "taken", "target", "take", "draw", "cells", "cell", "budget", "whole",
    "n_shingles", "bands", "component_id", "shingles", "evidence", "probability", "micro", "item_id", "similarity", "n_tokens", "n_bytes", "part", "times", "later", "turns", "perspective", "masks", "range", "_host", "_path", "_conv", "_gone", "a.b", "first",
)


def odd(table, *but):
    for name in NAMES:
        if name not in but:
            table = table.withColumn(name, F.lit("x"))
    return table


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars < 3000").cache()


@pytest.mark.parametrize("name", ["rules", "near", "quality", "tokens", "mix", "licenses", "leaks"])
def test_documents(spark, sf_dir, docs, name):
    labels, items = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    run = {
        "rules": quality_rules.judge, "near": near_dup.near_duplicates, "quality": lambda d: quality_model.judge(d, odd(labels)), "tokens": token_counts.count_tokens, "mix": mixing.mix,
        "licenses": licenses.scan, "leaks": lambda d: decontaminate.leaks(d, odd(items, "item_id")),
    }[name]
    plain = {"quality": lambda d: quality_model.judge(d, labels), "leaks": lambda d: decontaminate.leaks(d, items)}.get(name, run)
    assert rows(run(odd(docs))) == rows(plain(docs))


def test_pages_and_conversations(spark, sf_dir):
    pages, turns = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert rows(html_extract.extract(odd(pages))) == rows(html_extract.extract(pages))
    model = url_filter.train(url_filter.labelled_table(spark))
    assert rows(url_filter.judge(odd(pages), model=model)) == rows(url_filter.judge(pages, model=model))
    assert rows(chat.rotate(odd(turns))) == rows(chat.rotate(turns))
