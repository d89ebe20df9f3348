"""Multi-party perspective rotation: every dialogue once for each participant, who then speaks as the assistant.

For participant p of a dialogue, p's turns are the assistant's and carry the training mask; the other speakers are users
named by their role; system turns come first in the speaker's own role and belong to no perspective. A turn is rendered::

    <|assistant|>\\nTEXT<|end|>\\n      <|user:NAME|>\\nTEXT<|end|>\\n      <|system|>\\nTEXT<|end|>\\n

The mask is a list of [start, end) code point offsets of the assistant's texts with their end mark. Texts and names cannot
forge marks: between ``<`` and ``|`` of a text, and between ``|`` and ``>`` of a name too, one backslash is put in, before
those that may stand there; taking one out gives the text back.

A dialogue and participant give one row with the whole dialogue. Only a dialogue of over ``part_turns`` rows, such as the
null conv_id of a broken feed, is cut: the running number of its rows in the order system first, turn, role, text, gives
its ``part``, so that one row's size has a bound whatever a dialogue holds. The dialogue is then the texts of its parts in
order, and masks count from the start of their part's text. The SQL of the query cuts in the same way.

Scale: turns meet by dialogue once. Dialogues of more than a part are numbered by ranges of that order with each range's
offset; rows that are alike in all columns are counted first, so no range is crowded by them. The participants of a
dialogue are a distinct set of roles, found by partial aggregation; their number is the number of rows a part gives,
which is what the rotation asks for. All operators are built in.

Edge cases: a null conv_id is a dialogue of its own; null turns come first, ties follow role, then text; a null role is
the participant "unknown"; a null text is empty; a dialogue of system turns alone has no perspective and gives no row; repeated
rows are rendered each; columns other than conv_id, turn, role and text pass by, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.storage import settle, small

#: Rows of a dialogue that one row of the result renders at most.
PART_TURNS = 16_384
#: Rows of long dialogues that one range holds at most, about, and long dialogues that are broadcast.
RANGE_ROWS, LONG_BROADCAST = 16_384, 10_000
ORDER = ("later", "turn", "role", "text")
SYSTEM = "system"
END = "<|end|>"


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, "<(\\\\*)\\|", "<\\\\$1|")


def _render(turns: Column, speaker: Column) -> Column:
    """Array of (head, body) of each turn as seen with ``speaker`` as assistant."""

    def one(t: Column) -> Column:
        mine = t["role"] == speaker
        name = F.regexp_replace(_escaped(t["role"]), "\\|(\\\\*)>", "|\\\\$1>")
        head = F.when(mine, "<|assistant|>\n").when(t["role"] == SYSTEM, "<|system|>\n").otherwise(F.concat(F.lit("<|user:"), name, F.lit("|>\n")))
        return F.struct(mine.alias("mine"), head.alias("head"), F.concat(_escaped(t["text"]), F.lit(END)).alias("body"))

    return F.transform(turns, one)


def _numbered(rows: DataFrame, total: int, part_turns: int) -> DataFrame:
    """``rows`` of long dialogues with ``part`` and ``times``, how often a row stands in that part."""
    alike = rows.groupBy("conv_id", *ORDER).agg(F.count("*").alias("times"))
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE_ROWS + 1)
    dealt = settle(alike.repartitionByRange(ranges, "conv_id", *ORDER).withColumn("range", F.spark_partition_id()), "ranges")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = dealt.groupBy("conv_id", "range").agg(F.sum("times").alias("n"))
    offsets = sizes.select(F.col("conv_id").alias("_conv"), F.col("range").alias("_range"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("times").over(Window.partitionBy("conv_id", "range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = dealt.withColumn("inside", inside).join(offsets, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("range") == F.col("_range")))
    end = F.col("before") + F.col("inside")
    placed = placed.withColumn("end", end).withColumn("start", end - F.col("times"))
    placed = placed.withColumn("part", F.explode(F.sequence(F.floor(F.col("start") / part_turns), F.floor((F.col("end") - 1) / part_turns))))
    times = F.least(F.col("end"), (F.col("part") + 1) * part_turns) - F.greatest(F.col("start"), F.col("part") * part_turns)
    return placed.select("conv_id", *ORDER, F.col("part").cast("long").alias("part"), times.cast("int").alias("times"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conv_id, perspective and part: n_turns, text, masks, n_masked (code points under a mask)."""
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("later", F.col("role") != SYSTEM)
    cut = clean.withColumn("part", F.lit(0).cast("long")).withColumn("times", F.lit(1))
    long = settle(clean.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > part_turns), "long")
    total = long.agg(F.sum("n")).first()[0]
    if total:
        marked = clean.join(small(long.select(F.col("conv_id").alias("_conv"), "n"), LONG_BROADCAST), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
        cut = marked.filter("n is null").select("conv_id", *ORDER, F.lit(0).cast("long").alias("part"), F.lit(1).alias("times"))
        cut = cut.unionByName(_numbered(marked.filter("n is not null").drop("n"), total, part_turns))
    parties = clean.filter(F.col("role") != SYSTEM).groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("speakers"))
    grouped = cut.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "times"))).alias("turns"))
    grouped = grouped.withColumn("turns", F.flatten(F.transform("turns", lambda t: F.array_repeat(t, t["times"]))))
    rows = grouped.alias("g").join(parties.alias("p"), F.col("g.conv_id").eqNullSafe(F.col("p.conv_id")))
    rows = rows.select("g.conv_id", "part", "turns", F.explode("speakers").alias("perspective"))
    rows = rows.select("conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), _render(F.col("turns"), F.col("perspective")).alias("r"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("masks"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + 1).cast("long").alias("at"), F.when(x["mine"], F.concat(a["masks"], F.array(span))).otherwise(a["masks"]).alias("masks"))

    rows = rows.withColumn("masks", F.aggregate("r", start, step, lambda a: a["masks"]))
    text = F.array_join(F.transform("r", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "")
    masked = F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["start"])
    return rows.select("conv_id", "perspective", "part", "n_turns", text.alias("text"), "masks", masked.alias("n_masked"))
