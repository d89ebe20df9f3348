"""Hierarchical empirical Bayes over document evidence, hosts and paths.

1. A logistic regression over hashed n-grams gives every document a log likelihood ratio of good against bad. Features
   are the square roots of the shares of BUCKETS hashed runs of three bytes, and five of its shape: words that repeat the
   one before them, distinct words, length, word length, distinct n-grams. It is fitted on about FIT_ROWS labelled
   documents drawn by a hash of their id (FIT_ROWS is the bound on what the one task that fits holds: 8 KB a row, 16 KB
   while it fits). The driver gets the weights alone.
2. Soft counts of good documents are summed per host and path by grouped partial aggregation, then per host.
3. A host's share of good documents is shrunk towards the global share, a path's towards its host's. How strongly is
   estimated from the data: the prior's weight in documents follows from the variance between groups that sampling does
   not explain (method of moments). A host or path with few documents stays near its prior.
4. A document's posterior log odds are its likelihood ratio plus the log odds of its path's share, its own soft count
   left out. Shares are held in [0.02, 0.98], so no site outweighs clear evidence.

Scale: whole texts are read by narrow Arrow passes. The table of sites has one row per host and path; it is broadcast
only up to BROADCAST_SITES rows and BROADCAST_BYTES, beyond that rows are joined to it by a shuffle, in which Spark splits
a hot site's partition. ``judge`` shuffles ids only; ``keep`` would shuffle its rows then. Counts are whole millionths,
so sums do not depend on order.

Edge cases: a text without words (null, blank) has probability 0 and is rejected; null hosts and paths are groups of
their own; labels that repeat a doc_id count once, by their majority; documents that repeat a labelled doc_id give one
row to the fit; few labels are held back by the ridge alone, and where labels are missing or of one class there is nothing
to tell apart: the evidence is 0, the probability 0.5 and everything with words is kept; repeated rows count each and are judged each; columns
pass through ``keep`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from lodeline.llm.words import SPACES, lean_batches
from lodeline.storage import settle, small

FIT_ROWS = 4000
BROADCAST_SITES = 200_000
LEAST, MOST = 0.02, 0.98
BUCKETS, SHAPES = 1 << 12, 5
RIDGE, STEPS = 0.03, 400
BOUND = 30.0
_MICRO = 1_000_000
_CHUNK = 1 << 20


def features(text: str) -> np.ndarray:
    """BUCKETS + SHAPES numbers of a text, each of bounded size; the text is hashed in chunks of bounded memory."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(b" " + raw + b" ", np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for low in range(0, len(raw), _CHUNK):
        b = data[low : low + _CHUNK + 2].astype(np.uint32)
        mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        counts += np.bincount(mixed * np.uint32(2654435761) >> np.uint32(20), minlength=BUCKETS)
    n, words = max(len(raw), 1), raw.lower().split()
    k = max(len(words), 1)
    echo = sum(map(bytes.__eq__, words, words[1:]))
    shape = (np.sqrt(echo / k), len(set(words)) / k, 1 / np.sqrt(k), min(sum(map(len, words)) / k / 8, 3.0), np.count_nonzero(counts) / np.sqrt(n) / 4)
    return np.concatenate([np.sqrt(counts / n), shape]).astype(np.float32)


@F.arrow_udf(BinaryType())
def _packed(texts: pa.Array) -> pa.Array:
    return pa.array([features(t.as_py()).astype(np.float16).tobytes() for t in texts], pa.binary())


@dataclass(frozen=True)
class Evidence:
    """Weights of a fitted log likelihood ratio over ``features``."""

    weights: np.ndarray
    intercept: float
    informed: bool = True

    def of(self, text: str) -> float:
        return float(np.clip(features(text) @ self.weights + self.intercept, -BOUND, BOUND))

    def ratio(self, text: Column) -> Column:
        """The ratio of a non-null text, as a column."""

        @F.arrow_udf(DoubleType())
        def ratios(texts: pa.Array) -> pa.Array:
            return pa.array([self.of(t.as_py()) for t in texts], pa.float64())

        return ratios(text)


def fit(x: np.ndarray, y: np.ndarray) -> Evidence:
    """Ridge logistic regression by accelerated gradients on centred columns; the classes' own odds are taken out."""
    none = Evidence(np.zeros(BUCKETS + SHAPES, np.float32), 0.0, False)
    if not len(y) or y.min() == y.max():
        return none
    z, y = np.array(x, np.float32), np.asarray(y, np.float32)
    mean = z.mean(axis=0)
    z -= mean
    direction = np.ones(z.shape[1], np.float32)
    for _ in range(30):
        direction = z.T @ (z @ direction)
        top = float(np.linalg.norm(direction))
        direction /= max(top, 1e-12)
    step, flat = np.float32(1 / (0.2625 * top + RIDGE)), np.float32(4 / len(y))
    prior = np.float32(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    w, b = np.zeros(z.shape[1], np.float32), prior
    ahead, ahead_b = w, b
    for k in range(STEPS):
        off = 1 / (1 + np.exp(-np.clip(z @ ahead + ahead_b, -BOUND, BOUND))) - y
        w_new, b_new = ahead - step * (z.T @ off + np.float32(RIDGE) * ahead), ahead_b - flat * off.sum()
        speed = np.float32(k / (k + 3))
        ahead, ahead_b, w, b = w_new + speed * (w_new - w), b_new + speed * (b_new - b), w_new, b_new
    return Evidence(w, float(b - mean @ w - prior))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``fit`` in a task: rows of features and label in, one row of weights out."""
    x, y = [], []
    for batch in batches:
        x += [np.frombuffer(v.as_buffer(), np.float16).copy() for v in batch.column("x")]
        y += batch.column("y").to_pylist()
    rows = np.empty((len(x), BUCKETS + SHAPES), np.float16)
    for k, row in enumerate(x):
        rows[k], x[k] = row, None
    found = fit(rows, np.array(y))
    yield pa.RecordBatch.from_arrays([pa.array([found.weights.tobytes()], pa.binary()), pa.array([found.intercept]), pa.array([found.informed])], names=["weights", "intercept", "informed"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> tuple[Evidence, float]:
    """Evidence fitted on about ``rows`` labelled documents, and the share of good ones among all labels."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("double").alias("y"))
    known = settle(known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y")), "labels")
    seen = known.agg(F.count("*").alias("n"), F.sum("y").alias("good")).first()
    if not seen.n:
        return fit(np.empty((0, BUCKETS + SHAPES)), np.empty(0)), 0.5
    share = 1 << 30 if seen.n <= rows else int((1 << 30) * rows / seen.n)
    drawn = small(known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share), 2 * rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text(docs).alias("text")).join(drawn, "doc_id").filter(~_blank(F.col("text")))
    rows = texts.select("doc_id", "y", _packed("text").alias("x")).groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    got = rows.coalesce(1).sortWithinPartitions("doc_id").mapInArrow(_fitted, "weights binary, intercept double, informed boolean").first()
    evidence = Evidence(np.frombuffer(got.weights, np.float32), got.intercept, got.informed) if got else fit(np.empty((0, BUCKETS + SHAPES)), np.empty(0))
    return evidence, min(max(seen.good / seen.n, LEAST), MOST)


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _blank(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES)) == ""


def _logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(LEAST)), F.lit(MOST))
    return F.log(p / (1.0 - p))


def prior_weight(groups: DataFrame, good: str, n: str, mean: Column) -> float:
    """Documents that a prior counts for: from the variance of shares between groups beyond sampling."""
    share = F.col(good) / F.col(n)
    row = groups.filter(F.col(n) >= 2).agg(
        F.sum(F.col(n)).alias("n"), F.count("*").alias("g"), F.sum(F.col(n) * (share - mean) * (share - mean)).alias("between"), F.sum(mean * (1 - mean)).alias("within"), F.avg(mean * (1 - mean)).alias("spread"),
    ).first()
    if not row.n or row.g < 2 or not row.spread:
        return 1e6
    variance = max(0.0, row.between - row.within) / row.n
    return float(min(max(row.spread / max(variance, 1e-9) - 1, 5.0), 1e6))


def sites(scored: DataFrame, host: str, path: str, prior: float) -> DataFrame:
    """One row per host and path: soft counts, documents, and the host's shrunken share with the path's prior weight."""
    paths = settle(scored.groupBy(host, path).agg(F.sum("micro").alias("micro"), F.count("*").alias("n")), "sites")
    hosts = paths.groupBy(host).agg(F.sum("micro").alias("micro"), F.sum("n").alias("n"))
    all_ = paths.agg(F.sum("micro").alias("micro"), F.sum("n").alias("n")).first()
    mean = (all_.micro / _MICRO + prior) / (all_.n + 1) if all_.n else prior
    shares = hosts.select(host, "n", (F.col("micro") / _MICRO).alias("good"))
    weight = prior_weight(shares, "good", "n", F.lit(mean))
    shares = shares.select(F.col(host).alias("_host"), ((F.col("good") + weight * mean) / (F.col("n") + weight)).alias("host_share"))
    joined = paths.join(shares, F.col(host).eqNullSafe(F.col("_host"))).drop("_host").withColumn("good", F.col("micro") / _MICRO)
    below = prior_weight(joined, "good", "n", F.col("host_share"))
    return settle(joined.select(F.col(host).alias("_host"), F.col(path).alias("_path"), F.col("good").alias("_good"), F.col("n").alias("_n"), F.col("host_share").alias("_share"), F.lit(below).alias("_weight")), "sites")


def _evidence(evidence: Evidence, text: Column) -> Column:
    return F.when(_blank(text), F.lit(-BOUND)).otherwise(evidence.ratio(text))


def _soft(ratio: Column, prior: float) -> Column:
    return _logistic(ratio + F.lit(float(np.log(prior / (1 - prior)))))


def _micro(ratio: Column, prior: float) -> Column:
    return F.round(_soft(ratio, prior) * _MICRO).cast("long").alias("micro")


def _posterior(rows: DataFrame, table: DataFrame, prior: float) -> DataFrame:
    """``rows`` (host, path, evidence and more) with the posterior probability, from the table of sites."""
    named = F.octet_length(F.coalesce(F.col("_host"), F.lit(""))) + F.octet_length(F.coalesce(F.col("_path"), F.lit("")))
    met = rows.join(small(table, BROADCAST_SITES, named), F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    share = (F.col("_good") - _soft(F.col("evidence"), prior) + F.col("_weight") * F.col("_share")) / (F.col("_n") - 1 + F.col("_weight"))
    return met.withColumn("probability", F.when(F.col("evidence") <= -BOUND, 0.0).otherwise(_logistic(F.col("evidence") + _odds(share))))


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", label: str = "quality") -> DataFrame:
    """One row per document: doc_id, evidence (log likelihood ratio), probability of good, kept."""
    lean_batches(docs.sparkSession)
    evidence, prior = train(docs, labels, label)
    rows = docs.select("doc_id", docs[host].cast("string").alias("host"), docs[path].cast("string").alias("path"), _evidence(evidence, _text(docs)).alias("evidence"))
    if not evidence.informed:
        kept = F.col("evidence") > -BOUND
        return rows.select("doc_id", "evidence", F.when(kept, 0.5).otherwise(0.0).alias("probability"), kept.alias("kept"))
    rows = settle(rows, "evidence")
    table = sites(rows.select("host", "path", _micro(F.col("evidence"), prior)), "host", "path", prior)
    return _posterior(rows, table, prior).select("doc_id", F.round("evidence", 6).alias("evidence"), F.round("probability", 6).alias("probability"), (F.col("probability") >= 0.5).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` judged good, with all their columns."""
    lean_batches(docs.sparkSession)
    evidence, prior = train(docs, labels, label)
    if not evidence.informed:
        return docs.filter(~_blank(_text(docs)))
    ratio, host_, path_ = _evidence(evidence, _text(docs)), docs[host].cast("string").alias("host"), docs[path].cast("string").alias("path")
    table = sites(docs.select(host_, path_, ratio.alias("evidence")).select("host", "path", _micro(F.col("evidence"), prior)), "host", "path", prior)
    rows = docs.select(F.struct("*").alias("row"), host_, path_, ratio.alias("evidence"))
    return _posterior(rows, table, prior).filter("probability >= 0.5").select("row.*")
