"""Full-text search over postings: BM25, prefix terms, hit sets and symbol lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.text import split_identifier
from lodeline.storage import settle

K1, B = 1.2, 0.75
#: Inverse document frequency of a term that most rows hold.
IDF_FLOOR = 1e-6


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n_tokens, token, tf``: one explode that carries the length, map-side counted before the shuffle."""
    words = rows.select(key, tokens(F.col(text)).alias("_t"))
    return words.select(key, F.size("_t").cast("long").alias("n_tokens"), F.explode("_t").alias("token")).groupBy(key, "n_tokens", "token").agg(F.count("*").alias("tf"))


def _asked(terms: list[str]) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in terms))


def _meets(term: str, prefix: bool):
    return lambda x: x.startswith(term) if prefix else x == term


def bm25(rows: DataFrame, key: str, words: Column, terms: list[str], prefix: bool = True) -> DataFrame:
    """``key, score``: sum over terms of the positive BM25 weights; rows that no term meets are absent.

    ``words`` is a row's array of tokens. A question has a handful of terms, so they are counted inside the array: no
    token leaves its row, and what the frequencies need of all rows is one aggregate. The rows' counts are written once,
    since both read them. A prefix term sums the frequencies of every token it starts, before rows are counted.
    """
    asked = _asked(terms)
    counted = rows.select(key, words.alias("_t")).select(key, F.size("_t").cast("long").alias("_n"), F.array(*[F.size(F.filter("_t", _meets(t, prefix))).cast("long") for t in asked]).cast("array<bigint>").alias("_tf"))
    counted = settle(counted, "counted")
    tf = [F.get("_tf", i) for i in range(len(asked))]
    stats = counted.agg(F.count("*").alias("_rows"), F.avg("_n").alias("_mean"), *[F.count_if(x > 0).alias(f"_df{i}") for i, x in enumerate(tf)])

    def weight(i: int) -> Column:
        df = F.col(f"_df{i}")
        idf = F.log((F.col("_rows") - df + 0.5) / (df + 0.5))
        part = F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)) * tf[i] * (K1 + 1) / (tf[i] + K1 * (1 - B + B * F.col("_n") / F.col("_mean")))
        return F.when(tf[i] > 0, part).otherwise(0.0)

    met = counted.filter(F.exists("_tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))
    return met.select(key, sum((weight(i) for i in range(len(asked))), F.lit(0.0)).alias("score"))


def hit_ids(rows: DataFrame, key: str, words: Column, terms: list[str]) -> DataFrame:
    """Rows that hold a token starting with any of the terms, each once."""
    found = [F.exists(words, _meets(t, True)) for t in _asked(terms)]
    return rows.filter(reduce(Column.__or__, found, F.lit(False))).select(key).distinct()


def find(symbols: DataFrame, asked: str, limit: int) -> DataFrame:
    """Symbols whose name is ``asked``, starts with it in some part, or holds all of its parts; exact names first.

    Filters come before the limit. ``symbols``: path, name, line_start and more.
    """
    name, want = F.lower("name"), asked.lower()
    parts = split_identifier(F.col("name"))
    own = split_identifier(F.lit(asked))
    match = (name == want) | F.exists(parts, lambda p: p.startswith(want)) | ((F.size(own) > 0) & F.forall(own, lambda p: F.array_contains(parts, p)))
    exact = (name == want).cast("int")
    return symbols.filter(match).withColumn("exact", exact).orderBy(F.desc("exact"), F.length("name"), "path", "line_start").limit(limit)


def referrers(refs: DataFrame, most: int = 5) -> DataFrame:
    """Per name: files that refer to it, references, and the ``most`` strongest files by count, then path."""
    counts = refs.groupBy("name", "path").agg(F.count("*").alias("count"))
    w = Window.partitionBy("name").orderBy(F.desc("count"), "path")
    top = counts.withColumn("rank", F.row_number().over(w))
    listed = F.sort_array(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "path", "count"))))
    return top.groupBy("name").agg(F.count("*").alias("n_files"), F.sum("count").alias("n_refs"), F.transform(listed, lambda x: F.struct(x["path"].alias("path"), x["count"].alias("count"))).alias("top"))


def referrers_of(found: DataFrame, refs: DataFrame, most: int = 5) -> DataFrame:
    """``found`` (path, name, ...) with the other files that refer to each symbol's name, how many, their references, the
    ``most`` strongest, and the references in the symbol's own file."""
    counts = refs.join(F.broadcast(found.select("name").distinct()), "name", "left_semi").groupBy("name", F.col("path").alias("by")).agg(F.count("*").alias("count"))
    met = found.select("path", "name").distinct().join(counts, "name")
    own = F.col("by") == F.col("path")
    place = F.row_number().over(Window.partitionBy("path", "name").orderBy(own, F.desc("count"), "by"))
    listed = F.sort_array(F.collect_list(F.when(~own & (F.col("place") <= most), F.struct("place", F.col("by").alias("path"), "count"))))
    by = met.withColumn("place", place).groupBy("path", "name").agg(
        F.count_if(~own).alias("n_files"), F.sum(F.when(own, 0).otherwise(F.col("count"))).alias("n_refs"), F.sum(F.when(own, F.col("count")).otherwise(0)).alias("n_own"),
        F.transform(listed, lambda x: F.struct(x["path"].alias("path"), x["count"].alias("count"))).alias("top"),
    )
    return found.join(by, ["path", "name"], "left").fillna(0, ["n_files", "n_refs", "n_own"])
