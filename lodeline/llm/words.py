"""Words and word shingles, as Spark expressions and as numpy arrays.

A word is a maximal run of characters other than U+0020 and U+0009 to U+000D. Null text has no words.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"
WORD = "[^ \\t\\n\\x0B\\f\\r]+"
SHINGLE_WORDS = 5


def word_array(text: Column) -> Column:
    """The words of ``text`` in order; an empty array for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null. Counts without building an array of them."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), "[^x]+", "")).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pairs(left: Column, right: Column, shift: int) -> Column:
    """Hashes of (left[i], right[i + shift]) wherever both exist. One slice per array: elements are not read by index."""
    n = F.greatest(F.least(F.size(left), F.size(right) - shift), F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), lambda a, b: F.xxhash64(a, b))


def window_hashes(words: Column, width: int) -> Column:
    """Hash of every run of 5 or 8 words in order, by doubling; empty for fewer words."""
    if width not in (5, 8):
        raise ValueError("windows of 5 or 8 words")
    four = lambda w: let(_pairs(w, w, 1), lambda two: _pairs(two, two, 2))
    if width == 8:
        return let(words, lambda w: let(four(w), lambda x: _pairs(x, x, 4)))
    return let(words, lambda w: _pairs(four(w), w, 4))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of one Arrow batch between the JVM and a worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES, unless they are smaller already: whole texts, their copies in a
    worker and what is made of them take a multiple of a batch. A longer text is a batch of its own."""
    held = re.fullmatch(r"(\d+)b?", spark.conf.get(_BATCH))
    if not held or int(held[1]) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


class WordHashes(dict):
    """Hash of each word seen, kept while it is small; ``LIMIT`` bounds a worker's memory, not the result."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: Bytes of a text whose words are held as objects at once.
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, as UTF-8; bytes.split and bytes.lower know exactly these spaces and letters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_row(text: str | None, hashes: WordHashes) -> np.ndarray:
    """64-bit hashes of the lower-cased words in order; a long text is cut at spaces into pieces of about PIECE_BYTES."""
    raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
    rows, at = [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > PIECE_BYTES:
            space = _SPACE.search(raw, at + PIECE_BYTES)
            end = space.start() if space else end
        words = raw[at:end].split()
        rows.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
        at = end
    return rows[0] if len(rows) == 1 else np.concatenate([np.empty(0, np.uint64), *rows])


def shingles_of(w: np.ndarray) -> np.ndarray:
    """64-bit hash of every five-word window of hashed words; fewer words give one hash of the whole sequence, none give none."""
    n = len(w)
    if not n:
        return np.empty(0, np.uint64)
    if n < SHINGLE_WORDS:
        return mix((w * _ODD[:n]).sum(keepdims=True) ^ np.uint64(0x2545F4914F6CDD1D * n % 2**64))
    k = n - SHINGLE_WORDS + 1
    total = w[:k] * _ODD[0]
    for j in range(1, SHINGLE_WORDS):
        total += w[j : j + k] * _ODD[j]
    return mix(total)


def shingle_row(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """``shingles_of`` these words."""
    return shingles_of(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
