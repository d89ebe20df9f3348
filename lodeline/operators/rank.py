"""Ranking: personalisation, distribution of file ranks to symbols, hit shares, reasons, budgets and rendering."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.operators.graph import QUERY_FACTOR
from lodeline.storage import spread

FOCUS, PIN, TEXT_HIT, NOTE, IMPLEMENTS = 10.0, 10.0, 5.0, 5.0, 2.5
UNREFERENCED = 0.001
REFERRERS = 5
BUDGET, MIN_BUDGET, MAX_BUDGET = 1024, 64, 8192
CUT_RECORDED = 25
REFS_SHOWN = 2


def personalisation(facts: DataFrame) -> DataFrame:
    """``node, p, seeds`` from per-file facts: focus, pinned, text_hit, note (booleans), semantic, theme (similarity or
    null), entities, implements (arrays or null), query (the joined terms)."""
    none = F.array().cast("array<string>")
    entities, implements = F.coalesce("entities", none), F.coalesce("implements", none)
    p = (
        F.lit(1.0) + F.when(F.col("focus"), FOCUS).otherwise(0.0) + F.when(F.col("pinned"), PIN).otherwise(0.0) + F.when(F.col("text_hit"), TEXT_HIT).otherwise(0.0) + F.when(F.col("note"), NOTE).otherwise(0.0)
        + TEXT_HIT * F.coalesce("semantic", F.lit(0.0)) + F.when(F.size(entities) > 0, NOTE).otherwise(0.0) + F.when(F.size(implements) > 0, IMPLEMENTS).otherwise(0.0) + TEXT_HIT * F.coalesce("theme", F.lit(0.0))
    )
    seeds = F.concat(
        F.array_compact(F.array(F.when(F.col("focus"), "focus"), F.when(F.col("pinned"), "pinned"), F.when(F.col("text_hit"), F.concat(F.lit("query:"), F.col("query"))), F.when(F.col("note"), "note"), F.when(F.col("semantic").isNotNull(), "semantic"))),
        F.transform(entities, lambda e: F.concat(F.lit("entity:"), e)), F.transform(implements, lambda e: F.concat(F.lit("implements:"), e)), F.array_compact(F.array(F.when(F.col("theme").isNotNull(), "theme"))),
    )
    return facts.select("node", p.alias("p"), seeds.alias("seeds"))


def distribute(defs: DataFrame, refs: DataFrame, ranks: DataFrame, named: Column | None = None) -> DataFrame:
    """``dst, name, score``: every file deals its rank along its edges, self edges included.

    ``defs``: file, name; ``refs``: file, name, count. All definers of a name have the same incoming edges, so what a
    name receives is summed once from the references and handed to its definers; the fan-out of edges is never built.
    """
    definers = defs.select(F.col("file").alias("dst"), "name").distinct()
    often = definers.groupBy("name").agg(F.count("*").alias("definers"))
    weight = F.col("count").cast("double") if named is None else F.col("count") * F.when(named, QUERY_FACTOR).otherwise(1.0)
    used = refs.select(F.col("file").alias("src"), "name", weight.alias("w")).join(often, "name")
    out = used.groupBy("src").agg(F.sum("w").alias("out"))
    rate = out.join(ranks.withColumnRenamed("node", "src"), "src").select("src", (F.col("rank") / F.col("out")).alias("rate"))
    flow = used.join(rate, "src").groupBy("name").agg(F.sum(F.col("rate") * F.col("w") / F.col("definers")).alias("score"))
    return definers.join(flow, "name").select("dst", "name", "score")


def referenced_by(defs: DataFrame, refs: DataFrame, most: int = REFERRERS, rows: int = 0) -> DataFrame:
    """``dst, name, referrers, total, referenced_by``: strongest ``most`` files by count, then key.

    Found once for each name, as above; for answers restrict both sides to the names that are shown. ``rows``, of the
    larger side, makes parts as many as it needs.
    """
    counts = refs.groupBy("name", F.col("file").alias("src")).agg(F.sum("count").alias("count"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("count"), "src"))
    listed = F.sort_array(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "src", "count"))))
    top = spread(counts, rows, "name").withColumn("place", place).groupBy("name").agg(
        F.count("*").alias("referrers"), F.sum("count").alias("total"), F.transform(listed, lambda x: F.struct(x["src"].alias("path"), x["count"].alias("count"))).alias("referenced_by")
    )
    return defs.select(F.col("file").alias("dst"), "name").distinct().join(top, "name")


def hit_shares(hits: DataFrame, group: str) -> DataFrame:
    """``hits`` (name_hit, body, semantic) with ``share``: weights within the group that sum to one.

    A name counts 1; a body hit its weight by the group's strongest (1 if that is 0), or the similarity if larger.
    """
    w = Window.partitionBy(group)
    top = F.max("body").over(w)
    body = F.when(F.col("body").isNull(), 0.0).when(top > 0, F.col("body") / top).otherwise(1.0)
    weight = F.when(F.col("name_hit"), 1.0).otherwise(0.0) + F.greatest(body, F.coalesce("semantic", F.lit(0.0)))
    rows = hits.withColumn("_weight", weight)
    total = F.sum("_weight").over(w)
    return rows.withColumn("share", F.when(total > 0, F.col("_weight") / total).otherwise(0.0)).drop("_weight")


def symbol_scores(symbols: DataFrame, flow: DataFrame, ranks: DataFrame) -> DataFrame:
    """``symbols`` (file, name, …, optional share, noted) with file_rank and score.

    Symbols of one name in a file split its flow; one without any incoming edge gets a thousandth of its file's rank.
    """
    same = F.count("*").over(Window.partitionBy("file", "name"))
    rows = symbols.withColumn("siblings", same).join(ranks.select(F.col("node").alias("file"), F.col("rank").alias("file_rank")), "file")
    rows = rows.join(flow.select(F.col("dst").alias("file"), "name", F.col("score").alias("flow")), ["file", "name"], "left")
    score = F.coalesce(F.col("flow") / F.col("siblings"), F.col("file_rank") * UNREFERENCED)
    if "share" in symbols.columns:
        score = score + F.col("file_rank") * F.coalesce("share", F.lit(0.0))
    if "noted" in symbols.columns:
        score = score + F.when(F.col("noted"), F.col("file_rank")).otherwise(0.0)
    return rows.withColumn("score", score).drop("flow")


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """The ``rank`` of each row in a total order; for answers, whose rows are bounded by a limit before."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def reciprocal(rank: Column) -> Column:
    return 1.0 / rank


def fit_bisect(n: int, size: Callable[[int], int], budget: int) -> int:
    """Largest found prefix whose rendered size fits, by bisection; sizes need not be monotone."""
    low, high = 0, n
    while low < high:
        middle = (low + high + 1) // 2
        if size(middle) <= budget:
            low = middle
        else:
            high = middle - 1
    return low


def clamp_budget(budget: int | None) -> int:
    return min(max(BUDGET if budget is None else budget, MIN_BUDGET), MAX_BUDGET)


def within_budget(ranked: DataFrame, tokens: str, budget: int, *order: Column | str) -> DataFrame:
    """``served`` for the longest prefix in order whose tokens sum to at most the budget, and ``running``."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("running", F.sum(tokens).over(w)).withColumn("served", F.col("running") <= budget)


def file_groups(served: DataFrame) -> DataFrame:
    """Rows (path, line_start, rank) with the order of their file by its best row, and their place in it by line."""
    best = F.min("rank").over(Window.partitionBy("path"))
    rows = served.withColumn("best", best)
    return rows.withColumn("file_order", F.dense_rank().over(Window.orderBy("best", "path"))).withColumn("row_order", F.row_number().over(Window.partitionBy("path").orderBy("line_start", "rank")))


def render_map(rows: list, notes: list[tuple[str, str | None, str]] = ()) -> str:
    """The text of ranked rows (path, name, line_start, signature, referenced_by): files by best row, rows by line.

    ``notes`` are (path, symbol or None, text); a symbol's go below the first row of that name.
    """
    out = []
    for path in dict.fromkeys(r.path for r in rows):
        own = sorted((r for r in rows if r.path == path), key=lambda r: r.line_start)
        count: dict[str, int] = {}
        for r in own:
            for by in r.referenced_by or ():
                if by.path != path:
                    count[by.path] = count.get(by.path, 0) + by["count"]
        order = sorted(count, key=lambda p: (-count[p], p))
        more = f" +{len(order) - REFS_SHOWN}" if len(order) > REFS_SHOWN else ""
        out.append(f"{path}:" + (f"  ← {', '.join(order[:REFS_SHOWN])}{more}" if order else ""))
        out += [f"       note: {text}" for p, symbol, text in notes if p == path and symbol is None]
        done: set[str] = set()
        for r in own:
            out.append(f"{r.line_start:>5}  {r.signature}")
            if r.name not in done:
                done.add(r.name)
                out += [f"       note: {text}" for p, symbol, text in notes if p == path and symbol == r.name]
    return "".join(f"{line}\n" for line in out)


def fit_map(rows: list, budget: int, notes: list[tuple[str, str | None, str]] = ()) -> int:
    """How many of the ranked rows a budget of approximate tokens holds; one at least if there are any."""
    found = fit_bisect(len(rows), lambda n: math.ceil(len(render_map(rows[:n], notes)) / 4), budget)
    return max(found, 1) if rows else 0
