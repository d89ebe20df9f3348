"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted verification.

A benchmark item of L words is compared with every window of L words of every document (a shorter document is one
window). Fingerprints have 64 bits: the signs of the sum over a window's five-word shingles, each weighing as often as
it occurs. Items lie in eight indexes, one for each block of eight bits, under every block value within two bits of
their own. A fingerprint within RADIUS = 23 bits has some block within two bits (8 * 3 = 24 > 23), so the indexes hand
over all items within the radius, without exception. At similarity 0.75 the angle of two windows gives 11 differing
bits with deviation 3; 23 is four deviations away. Candidates are confirmed by the exact weighted similarity, the sum of
smaller over the sum of larger multiplicities, at 0.75 or more.

A window with that similarity shares at least 0.75 * (L - 4) of its shingles with the item. Running sums over the
shingles that any item holds leave out windows that cannot; that bound loses nothing, and only the windows left are
fingerprinted, in pieces of CHUNK shingles. Documents are a single pass without a shuffle for each block of at most
ITEM_BLOCK items and ITEM_BLOCK_CHARS characters; so what is sent to the workers has a fixed bound whatever the size of
the benchmark. Items are read in order of their ids, and all texts of one id stay in one block.

Edge cases: null or blank texts and items match nothing; a text or item of fewer than five words is one shingle of its
whole sequence; rows of the benchmark that share an item_id are one item with several texts, of which the best match
counts, so a document and item give one row; an item_id that is no whole number is null and matches nothing; repeated
documents are matched each; a null doc_id is carried as null. Other columns pass by, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.words import WordHashes, lean_batches, shingles_of, word_row

RADIUS = 23
BLOCKS, NEAR = 8, 2
THRESHOLD = 0.75
ITEM_BLOCK = 20_000
ITEM_BLOCK_CHARS = 20_000_000
FOUND = "doc_id long, item_id long, start_word long, n_words long, similarity double"
#: Shingles whose bits are summed at once: about 8 MB.
CHUNK = 8192
_FILTER_BITS = 22
_BITS = np.arange(64, dtype=np.uint64)
#: Of every byte, the bytes within two bits.
_NEAR_BYTES = [[v for v in range(256) if (v ^ b).bit_count() <= NEAR] for b in range(256)]


Shape = tuple[np.ndarray, np.ndarray]


def fingerprints(shingles: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the windows of ``width`` shingles that begin at ``starts``, which ascend."""
    found, first = [np.empty(0, np.uint64)], 0
    while first < len(starts):
        low = int(starts[first])
        last = int(np.searchsorted(starts, low + CHUNK))
        at = starts[first:last] - low
        piece = shingles[low : low + int(at[-1]) + width]
        sign = ((piece[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1
        total = np.zeros((len(sign) + 1, 64), np.int32)
        np.cumsum(sign, axis=0, out=total[1:])
        found.append((((total[at + width] - total[at]) > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64))
        first = last
    return np.concatenate(found)


def shape(row: np.ndarray) -> Shape:
    """Distinct shingles of a window and how often each occurs."""
    return np.unique(row, return_counts=True)


def weighted_similarity(a: Shape, b: Shape) -> float:
    """Sum of the smaller over the sum of the larger multiplicities."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum()) + int(b[1].sum()) - shared
    return shared / whole if whole else 0.0


@dataclass
class ItemIndex:
    """Items by width in shingles, with the block tables of their fingerprints."""

    ids: list[int] = field(default_factory=list)
    shapes: list[Shape] = field(default_factory=list)
    prints: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    tables: dict[int, list[dict[int, list[int]]]] = field(default_factory=dict)
    shingles: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    hint: np.ndarray = field(default_factory=lambda: np.zeros(1 << _FILTER_BITS, bool))

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> ItemIndex:
        index, hashes, all_ = cls(), WordHashes(), []
        for item_id, text in rows:
            words = word_row(text, hashes)
            row = shingles_of(words)
            if not len(row):
                continue
            k = len(index.ids)
            index.ids.append(item_id)
            index.shapes.append(shape(row))
            index.words.append(len(words))
            index.prints.append(int(fingerprints(row, np.zeros(1, np.int64), len(row))[0]))
            tables = index.tables.setdefault(len(row), [defaultdict(list) for _ in range(BLOCKS)])
            for b in range(BLOCKS):
                for value in _NEAR_BYTES[index.prints[k] >> 8 * b & 255]:
                    tables[b][value].append(k)
            all_.append(row)
        if all_:
            index.shingles = np.unique(np.concatenate(all_))
            index.hint[(index.shingles & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        return index

    def candidates(self, width: int, print_: int) -> list[int]:
        """Items of this width within RADIUS bits of the fingerprint."""
        tables = self.tables[width]
        met = {k for b in range(BLOCKS) for k in tables[b].get(print_ >> 8 * b & 255, ())}
        return [k for k in met if (self.prints[k] ^ print_).bit_count() <= RADIUS]

    def windows(self, row: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each width of items, the starts of the windows of ``row`` that share enough shingles with the items."""
        maybe = np.flatnonzero(self.hint[(row & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.shingles):
            return
        place = np.searchsorted(self.shingles, row[maybe])
        maybe = maybe[self.shingles[np.minimum(place, len(self.shingles) - 1)] == row[maybe]]
        if not len(maybe):
            return
        held = np.zeros(len(row) + 1, np.int64)
        held[maybe + 1] = 1
        np.cumsum(held, out=held)
        for width in self.tables:
            span = min(width, len(row))
            starts = np.flatnonzero(held[span:] - held[:-span] >= THRESHOLD * width)
            if len(starts):
                yield width, starts

    def search(self, text: str | None, hashes: WordHashes) -> dict[int, tuple[float, int, int]]:
        """Best window for each item that the text holds, by item id: similarity, first word, words."""
        words = word_row(text, hashes)
        row = shingles_of(words)
        best: dict[int, tuple[float, int, int]] = {}
        for width, starts in self.windows(row):
            span = min(width, len(row))
            for start, print_ in zip(starts.tolist(), fingerprints(row, starts, span).tolist(), strict=True):
                near = self.candidates(width, print_)
                if not near:
                    continue
                window = shape(row[start : start + span])
                for k in near:
                    similarity = weighted_similarity(window, self.shapes[k])
                    if similarity >= THRESHOLD and similarity > best.get(self.ids[k], (0.0,))[0]:
                        best[self.ids[k]] = (similarity, start, min(self.words[k], len(words) - start))
        return best


def _searcher(index: ItemIndex):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                for item_id, (similarity, start, n) in index.search(text.as_py(), hashes).items():
                    found.append((doc_id.as_py(), item_id, start, n, similarity))
            columns = list(zip(*found, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

    return search


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Blocks of items in order of their ids, read one partition after the other."""
    rows = items.select(F.expr("try_cast(item_id AS long)").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    block, chars = [], 0
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        if block and item_id != block[-1][0] and (len(block) >= ITEM_BLOCK or chars >= ITEM_BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((item_id, text))
        chars += len(text)
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item it holds: best window's first word, its words and similarity."""
    lean_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [docs.mapInArrow(_searcher(ItemIndex.of(block)), FOUND) for block in _blocks(items)]
    if not found:
        return docs.sparkSession.createDataFrame([], FOUND)
    return reduce(DataFrame.unionByName, found)


def verdicts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id`` of contaminated documents with the items they hold; for filtering."""
    return leaks(docs, items).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
