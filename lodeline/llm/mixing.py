"""Mixing sources to target weights by subset-sum fitting of exact document lengths.

A source whose target is T words and whose documents hold S words takes every document ``floor(T / S)`` times. The rest
of its budget is fitted: documents are counted by exact length, and two steps say how many of each length are taken.

1. All but a reserve of the budget is drawn in proportion: with the documents of a source in order of length, every
   document has the same share f of being taken, and the counts are those of a systematic draw with a seeded start. A
   length with one document is thus taken as often as its share says, and the words drawn are off by one document.
2. The reserve, KNAPSACK_WORDS or two of the longest documents, is fitted by a bounded knapsack over the documents of all
   lengths that are left, in seeded order: the sum nearest to the budget that they can reach.

The counts of each length are then met by documents in seeded order. A source that is smaller than the reserve is fitted
by the knapsack alone, so its words are the nearest to its target that its documents allow.

Scale: lengths are counted with partial aggregation. The fit sees one row per source and distinct length, never a
document; one source's rows are at most as many as its longest document has words. Choosing t of n documents of one
length never sorts the group: its documents fall into about sqrt(n) seeded cells, cells are taken whole in order, and
only the cell where the count ends ranks its few documents. A length that holds a third of all rows is thus dealt over
many tasks. Sources stay distributed, whatever their number: they are numbered by ranges of their names, targets are
found by a few aggregates, and their table is broadcast only after its rows and bytes were checked.

Edge cases: null text has size 0 and is never taken; a null source is a source of its own, last in order; a source of
empty texts has target 0; rows that repeat a doc_id are told apart by their content and repeated rows may be taken
differently; an empty table gives no rows. Columns other than doc_id, text and source pass by, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.words import word_count
from lodeline.storage import settle, small

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = 20_24
#: Words of a budget that the knapsack fits at least.
KNAPSACK_WORDS = 4096
#: Rows of the tables of sources, and of sources and lengths (about 80 bytes each, and the source's name), that may be
#: broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = BROADCAST_LENGTHS = 200_000


def targets(sources: DataFrame, weights: tuple[float, ...], share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sources`` (source, source_size) with target: a share of all sizes by weight, none above ``cap`` times its size.

    Sources are numbered in order of their names, nulls last. What capped sources leave is dealt again by weight until no
    source is above: every open source gets ``level`` times its weight, which only rises.
    """
    spark = sources.sparkSession
    name = F.col("source").asc_nulls_last()
    dealt = settle(sources.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), name).withColumn("part", F.spark_partition_id()), "sources")
    counts, offsets, before = sorted(dealt.groupBy("part").count().collect()), [], 0
    for part, n in counts:
        offsets.append((part, before))
        before += n
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(name)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    # a row for each partition of the shuffle
    numbered = dealt.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part").withColumn("place", place).withColumn("weight", weight)
    numbered = settle(numbered.select("source", "source_size", "weight"), "sources")
    size, level = F.col("source_size").cast("double"), 0.0
    while True:
        capped = size * cap <= F.col("weight") * level
        row = numbered.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, size * cap)).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        if not row.open:
            break
        new = (share * row.all - (row.full or 0.0)) / row.open
        if new <= level:
            break
        level = new
    return numbered.select("source", "source_size", F.least(size * cap, F.col("weight") * level).alias("target"))


def knapsack(lengths: list[int], counts: list[int], budget: int, over: int = 0) -> list[int]:
    """How many of each length to take, of at most ``counts``, for the sum nearest to ``budget``: from below, or at most
    ``over`` above it if that is nearer.

    Bit s of ``reach`` says that some counts sum to s. Multiplicities are split into powers of two. ``by`` keeps for every
    sum the part that reached it first; without that part the rest was reached by earlier ones, so the way back follows
    ``by`` alone. Stops as soon as the budget itself is reached.
    """
    most = budget + over
    mask, reach, parts = (1 << most + 1) - 1, 1, []
    by = np.full(most + 1, -1, np.int32)
    for k, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        if length <= 0 or length > most:
            continue
        count, size = min(count, most // length), 1
        while count > 0 and not reach >> budget & 1:
            step = min(size, count)
            new = reach << length * step & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(most // 8 + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits)] = len(parts)
                parts.append((k, step))
                reach |= new
            count -= step
            size *= 2
        if reach >> budget & 1:
            break
    at, take = (reach & (1 << budget + 1) - 1).bit_length() - 1, [0] * len(lengths)
    above = reach >> budget
    if above and (more := (above & -above).bit_length() - 1) < budget - at:
        at = budget + more
    while at:
        k, step = parts[by[at]]
        take[k] += step
        at -= lengths[k] * step
    return take


def fit(lengths: list[int], counts: list[int], budget: int, seed: int = SEED) -> list[int]:
    """Documents to take of each length (in ascending order), so that their words come nearest to ``budget``."""
    n, c = np.array(lengths, np.int64), np.array(counts, np.int64)
    total, random = int((n * c).sum()), np.random.default_rng(seed)
    if budget >= total:
        return list(counts)
    reserve = max(KNAPSACK_WORDS, 2 * int(n.max()))
    share, start = max(0, budget - reserve) / total, random.random()
    ends = np.floor(np.cumsum(c) * share + start)
    take = np.diff(ends, prepend=0.0).astype(np.int64)
    take[n == 0] = 0
    left = budget - int((n * take).sum())
    order = random.permutation(np.flatnonzero((n > 0) & (c > take) & (n < 2 * left)))
    take[order] += np.array(knapsack(n[order].tolist(), (c - take)[order].tolist(), left, left), np.int64)
    return take.tolist()


def _fit_group(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("size")
    take = fit(rows["size"].to_pylist(), rows["n"].to_pylist(), rows["budget"][0].as_py(), rows["draw"][0].as_py())
    return rows.append_column("take", pa.array(take, pa.int64()))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    text = F.col("text").cast("string")
    source = F.col("source").cast("string")
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), "doc_id", text).alias("draw"),
    )
    light = settle(light, "sizes")
    lengths = settle(light.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    goal = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("budget", F.greatest(F.lit(0).cast("long"), F.round("target").cast("long") - F.col("whole") * F.col("source_size")))
    goal = settle(goal.withColumn("draw", F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 31))), "goal")
    named = F.octet_length(F.coalesce("source", F.lit("")))

    same = F.col("l.source").eqNullSafe(F.col("g.source"))
    asked = lengths.alias("l").join(small(goal, BROADCAST_SOURCES, named).alias("g"), same).select("l.source", "size", "n", "budget", "draw", "source_size", "target", "whole")
    asked = asked.groupBy("source").applyInArrow(_fit_group, "source string, size long, n long, budget long, draw long, source_size long, target double, whole long, take long")
    asked = settle(asked.drop("budget", "draw").withColumn("cells", F.ceil(F.sqrt(F.col("n") / 4.0)).cast("long")), "asked")

    cell = F.pmod(F.col("draw"), F.col("cells"))
    open_ = F.when((F.col("take") > 0) & (F.col("take") < F.col("n")), F.col("take"))
    dealt = (
        light.alias("d").join(small(asked, BROADCAST_LENGTHS, named).alias("a"), F.col("d.source").eqNullSafe(F.col("a.source")) & (F.col("d.size") == F.col("a.size")))
        .select("doc_id", F.col("d.source").alias("source"), F.col("d.size").alias("size"), "draw", "source_size", "target", "whole", "n", "take", open_.alias("open"), cell.alias("cell"))
    )
    # dealt by cell: a partitioning by source and length alone would satisfy the windows and gather a hot length
    part = dealt.filter("open is not null").repartition("source", "size", "cell")
    cells = part.groupBy("source", "size", "cell").agg(F.count("*").alias("c"), F.first("open").alias("open"))
    before = F.sum("c").over(Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("quota", F.greatest(F.lit(0), F.least(F.col("c"), F.col("open") - F.coalesce(before, F.lit(0))))).select("source", "size", "cell", "quota")
    rank = F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("draw", "doc_id"))
    ranked = part.withColumn("rank", rank).alias("p").join(
        cells.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")) & (F.col("p.size") == F.col("c.size")) & (F.col("p.cell") == F.col("c.cell"))
    )
    chosen = ranked.select("doc_id", F.col("p.size").alias("size"), "source_size", "target", (F.col("whole") + (F.col("rank") <= F.col("quota")).cast("long")).alias("times"))
    rest = dealt.filter("open is null").select("doc_id", "size", "source_size", "target", (F.col("whole") + (F.col("take") > 0).cast("long")).alias("times"))
    return chosen.unionByName(rest).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
