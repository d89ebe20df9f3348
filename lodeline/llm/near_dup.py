"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification and union of linked documents.

Every element of a document's shingle set draws one random order of the signature's slots and puts value
``rank + uniform`` into each slot; a slot keeps its minimum. Orders come from the affine maps ``a + b * rank`` modulo
the prime number of slots. That group moves every pair of slots to every other pair equally often, so two slots of a
signature are correlated exactly as under free permutations and the variance is SuperMinHash's. Ranks are drawn level
by level for all elements of a document at once: after level ``j`` no later value is below ``j + 1``, so a document is
finished as soon as all its slots are (early stopping, after two or three levels for common lengths).

Candidates come from equal bands. A pair at similarity 0.75 shares no band with probability (1 - 0.75^4)^31 = 8e-6.
Groups of copies are never spelled out as pairs:

1. documents with equal sets form a class, of which the smallest id goes on; sets are held equal if their sizes and the
   128-bit BLAKE2 digests of the whole sorted sets are, so every member is confirmed on its full set;
2. in each bucket every class is compared with the smallest one only; verified links are united;
3. buckets that still hold several components give their cross-component pairs, if they are small;
4. the classes of larger ones meet through rare shingles: two sets with similarity t share one of the rarest
   ``n - ceil(t * n) + 1`` shingles of either (prefix filter, exact at any size).

Shingles are compared by 64-bit hashes. A pair of documents with n and m shingles meets a false common one with
probability n * m / 2^64, 2e-14 for 600 words each.

Edge cases: null or blank text has an empty set, links with nothing and keeps its own id. Rows that repeat a doc_id are
one node. A null doc_id has a null component and is kept. Only ``doc_id`` and ``text`` are read; other columns pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.words import WordHashes, lean_batches, mix, shingles_of, word_row
from lodeline.storage import settle, small

SLOTS = 127
BANDS, ROWS = 31, 4
THRESHOLD_NUM, THRESHOLD_DEN = 75, 100
#: Buckets of up to so many classes give their cross-component pairs; larger ones take the prefix filter.
SMALL_BUCKET = 48
#: Ids of eight bytes that may be broadcast: 16 MB. More are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Most frequent shingles, of the classes in large buckets, whose numbers order the prefix filter: 3 MB for each worker.
RANKED = 200_000
#: Sets that one task counts at least, so that what many hold is seen there before anything is shuffled.
TALLY_SETS = 256
_CHUNK = 200_000
_SKETCH = ("s0", "s1", "s2", "s3")
SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, s0 long, s1 long, s2 long, s3 long"


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash of each set of distinct 64-bit hashes: a row of SLOTS values ``rank * 2^24 + uniform``."""
    sig = np.full((len(sets), SLOTS), np.iinfo(np.uint32).max, np.uint32)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return sig
    item = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    seed = mix(item ^ np.uint64(0x5851F42D4C957F2D))
    place = (seed % np.uint64(SLOTS)).astype(np.int64)
    step = (1 + (seed >> np.uint64(32)) % np.uint64(SLOTS - 1)).astype(np.int64)
    for level in range(SLOTS):
        draw = mix(item + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(40)
        np.minimum.at(sig.reshape(-1), owner * SLOTS + place, (draw + np.uint64(level << 24)).astype(np.uint32))
        open_ = (sig >= np.uint32((level + 1) << 24)).any(axis=1)
        if not (open_ & (sizes > 0)).any():
            break
        go = open_[owner]
        if not go.all():
            item, owner, place, step = item[go], owner[go], place[go], step[go]
        place = place + step
        place[place >= SLOTS] -= SLOTS
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is mixed in."""
    used = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)) * np.uint64(0x632BE59BD9B4E019)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + used[:, :, j])
    return key.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each of 124 slots, 31 slots to a long."""
    two = (mix(sig[:, :124].astype(np.uint64)) & np.uint64(3)).reshape(len(sig), 4, 31)
    return (two << (2 * np.arange(31, dtype=np.uint64))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _chunks(texts: Iterator[str | None], hashes: WordHashes) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for text in texts:
        held.append(np.unique(shingles_of(word_row(text, hashes))))
        size += len(held[-1])
        if size >= _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        ids, at = batch.column("doc_id"), 0
        for sets in _chunks((t.as_py() for t in batch.column("text")), hashes):
            n = np.array([len(s) for s in sets], np.int64)
            sig = signatures(sets)
            digest = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            keys, sk = band_keys(sig), sketches(sig)
            live = n > 0
            ends = np.concatenate([[0], np.cumsum(np.where(live, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, len(sets)), pa.array(n), *(pa.array(digest[:, j].copy()) for j in range(2)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[live].reshape(-1))), *(pa.array(sk[:, j].copy()) for j in range(4))],
                names=["doc_id", "n_shingles", "h1", "h2", "bands", *_SKETCH],
            )
            at += len(sets)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        ids, at = batch.column("doc_id"), 0
        for sets in _chunks((t.as_py() for t in batch.column("text")), hashes):
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "shingles"])
            at += len(sets)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of a batch hold each shingle that more than one holds."""
    for batch in batches:
        sh, n = np.unique(batch.column("shingles").flatten().to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(sh[n > 1]), pa.array(n[n > 1])], names=["sh", "n"])


def _prefixes(known: np.ndarray, often: np.ndarray):
    """For each set its first shingles in order of (number of classes, hash), with rank and the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[np.empty(0, np.int64)] for _ in range(4)]
            for doc_id, row in zip(batch.column("doc_id").to_pylist(), batch.column("shingles"), strict=True):
                sh = np.asarray(row.values.to_numpy(zero_copy_only=False), np.int64)
                place = np.minimum(np.searchsorted(known, sh), max(len(known) - 1, 0))
                df = np.where(known[place] == sh, often[place], 0) if len(known) else np.zeros(len(sh), np.int64)
                sh = sh[np.lexsort((sh, df))]
                first = len(sh) - -(-len(sh) * THRESHOLD_NUM // THRESHOLD_DEN) + 1
                parts[0].append(np.full(first, doc_id, np.int64))
                parts[1].append(np.arange(first))
                parts[2].append(sh[:first])
                parts[3].append(np.concatenate([[0], sh[: first - 1]]))
            doc, at, sh, prior = (np.concatenate(p) for p in parts)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at.astype(np.int32)), pa.array(sh), pa.array(prior, mask=at == 0)], names=["doc_id", "at", "sh", "prior"])

    return run


def sign(docs: DataFrame) -> DataFrame:
    """One row per document: size and digest of its set, band keys, sketch."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sign, SIGNED)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, shingles``: the full set of each document, sorted."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sets, "doc_id long, shingles array<long>")


def _may_match(a: str, b: str) -> Column:
    """Sizes allow the threshold, and the sketches agree in at least 0.6 of the slots.

    Slots of two sketches agree with probability J + (1 - J) / 4, 0.8125 at the threshold; 0.6 is six deviations below.
    """
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    low = F.lit(0x1555555555555555).cast("long")
    off = sum((F.bit_count((x := F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))).bitwiseOR(F.shiftright(x, 1)).bitwiseAND(low)) for s in _SKETCH), F.lit(0))
    return (n * THRESHOLD_DEN >= m * THRESHOLD_NUM) & (m * THRESHOLD_DEN >= n * THRESHOLD_NUM) & (off <= int(0.4 * 124))


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Full sets of the documents with these ids. Their texts stay where they are while the ids fit in a broadcast."""
    ids = small(settle(ids, "ids"), BROADCAST_IDS)
    return settle(shingle_sets(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")), "sets")


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of distinct pairs ``a, b`` those whose full sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = _sets_of(ids, docs)
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared * THRESHOLD_DEN >= (F.size("x") + F.size("y") - shared) * THRESHOLD_NUM).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, label``: smallest id reachable, for every id on an edge ``a, b``.

    Union by alternating stars: every node's larger neighbours are linked to its smallest neighbour, then its smaller
    ones, until nothing changes; rounds grow with the logarithm of a component's diameter. Each round's edges are
    written, so a lost executor costs tasks of one round. Minima are partly aggregated, so hubs are no hot keys.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = settle(small.filter("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).union(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def _rare_pairs(held: DataFrame, docs: DataFrame) -> DataFrame:
    """Cross-component candidates among ``held`` (one row per class) through their rarest shingles.

    Shingles are ordered by their number of classes here, then by hash. That order is a matter of speed alone, so the
    numbers of the RANKED most frequent ones do, counted by batch first; the others count as rarest. If a linked pair's first shared shingle in that
    order has ranks i and j, both sets must have enough shingles from there on; so edited copies, whose own rare
    shingles fill their first ranks, meet few others, whatever the size of the group. The first shared shingle also
    starts a run: the shingles before it differ. Later ones of a run would only repeat the pair.
    """
    sets = _sets_of(held.select("doc_id").distinct(), docs)
    tally = sets.coalesce(max(1, sets.count() // TALLY_SETS)).mapInArrow(_tally, "sh long, n long")
    often = tally.groupBy("sh").agg(F.sum("n").alias("df")).orderBy(F.desc("df"), "sh").limit(RANKED).collect()
    order = sorted((r.sh, r.df) for r in often)
    rare = sets.mapInArrow(_prefixes(np.array([x for x, _ in order], np.int64), np.array([x for _, x in order], np.int64)), "doc_id long, at int, sh long, prior long")
    rare = rare.join(held, "doc_id")
    a, b = rare.alias("a"), rare.alias("b")
    left = F.least(F.col("a.n_shingles") - F.col("a.at"), F.col("b.n_shingles") - F.col("b.at"))
    enough = left * (THRESHOLD_NUM + THRESHOLD_DEN) >= (F.col("a.n_shingles") + F.col("b.n_shingles")) * THRESHOLD_NUM
    starts = F.coalesce(F.col("a.prior") != F.col("b.prior"), F.lit(True))
    meet = a.join(b, (F.col("a.sh") == F.col("b.sh")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.label") != F.col("b.label")) & enough & starts & _may_match("a", "b"))
    return meet.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (it is its own)."""
    lean_batches(docs.sparkSession)
    signed = settle(sign(docs), "signed")
    live = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = live.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = settle(live.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "reps")
    light = reps.select("doc_id", "n_shingles", *_SKETCH)
    member = reps.select("doc_id", F.explode("bands").alias("key"))
    hubs = settle(member.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("c")).filter("c > 1"), "hubs")
    star = member.join(hubs, "key").filter("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = star.join(light.select(F.col("doc_id").alias("a"), F.struct("n_shingles", *_SKETCH).alias("p")), "a").join(light.select(F.col("doc_id").alias("b"), F.struct("n_shingles", *_SKETCH).alias("q")), "b")
    star = settle(star.filter(_may_match("p", "q")).select("a", "b"), "pairs")
    linked = settle(verify(star, docs), "links")
    label = components(linked)

    wide = member.join(hubs.filter("c > 2").select("key", "c"), "key").join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "c", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    wide = settle(wide, "wide")
    unsettled = wide.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    wide = settle(wide.join(unsettled, "key", "left_semi").join(light, "doc_id"), "wide")
    small = wide.filter(F.col("c") <= SMALL_BUCKET)
    a, b = small.alias("a"), small.alias("b")
    cross = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.label") != F.col("b.label")) & _may_match("a", "b"))
    cross = cross.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()
    held = wide.filter(F.col("c") > SMALL_BUCKET).select("doc_id", "label", "n_shingles", *_SKETCH).distinct()
    if held.limit(1).count():
        cross = cross.union(_rare_pairs(held, docs)).distinct()
    cross = settle(cross.join(star, ["a", "b"], "left_anti"), "pairs")
    if cross.limit(1).count():
        label = components(linked.union(verify(cross, docs)))

    root = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("label", "rep").alias("root"))
    # empty sets and rows without an id stay out of the join, where they would be one key
    alone = F.col("n_shingles").eqNullSafe(0) | F.col("doc_id").isNull()
    own = signed.filter(~alone).select("doc_id", "n_shingles", "h1", "h2").join(root, ["h1", "h2", "n_shingles"]).select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    every = own.unionByName(signed.filter(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return every.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
