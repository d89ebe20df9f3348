"""Interval, point and nearest joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int | None = None) -> DataFrame:
    """Rows of equal ``keys`` whose closed spans overlap.

    With ``width`` spans are dealt into bins of that width as well, so a key with many spans is not one group; a pair is
    returned from the bin where its overlap starts, hence once.
    """
    (a, b), (c, d) = left_span, right_span
    if width is None:
        return left.join(right, keys).filter((F.col(a) <= F.col(d)) & (F.col(b) >= F.col(c)))

    def binned(df: DataFrame, first: str, last: str) -> DataFrame:
        return df.filter(F.col(first) <= F.col(last)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))

    met = binned(left, a, b).join(binned(right, c, d), [*keys, "_bin"]).filter((F.col(a) <= F.col(d)) & (F.col(b) >= F.col(c)))
    return met.filter(F.col("_bin") == F.floor(F.greatest(a, c) / width)).drop("_bin")


def point_join(points: DataFrame, spans: DataFrame, keys: list[str], point: str, span: tuple[str, str], width: int | None = None) -> DataFrame:
    """Points inside closed spans of equal ``keys``; binned as above with ``width``."""
    inside = (F.col(point) >= F.col(span[0])) & (F.col(point) <= F.col(span[1]))
    if width is None:
        return points.join(spans, keys).filter(inside)
    p = points.withColumn("_bin", F.floor(F.col(point) / width))
    s = spans.filter(F.col(span[0]) <= F.col(span[1])).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(span[0]) / width), F.floor(F.col(span[1]) / width))))
    return p.join(s, [*keys, "_bin"]).filter(inside).drop("_bin")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, then: str, value: str) -> DataFrame:
    """``left`` with the right ``value`` and ``then`` latest at or before ``at``: one sort of both sides, no pairs."""
    side = [F.col(k) for k in keys]
    rows = left.select(*side, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[then].dataType).alias("_w"))
    rows = rows.unionByName(right.select(*side, F.col(then).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.col(then).alias("_w")))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_last", F.last(F.when(F.col("_side") == 0, F.struct("_v", "_w")), ignorenulls=True).over(w)).filter("_side = 1")
    return found.select("_row.*", F.col("_last._v").alias(value), F.col("_last._w").alias(then))


def match_items(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """Recorded rows (retrieval_id, rank, symbol_id, path, name, line_start) matched to present symbols (symbol_id, path,
    name, line_start): by id if path and name agree, else by exact place, else by the nearest line of that name.

    A symbol is used once, rows choose in rank order: a sequential step, run per path and name in arrays.
    """
    left = items.select("retrieval_id", "rank", "path", "name", F.col("symbol_id").alias("old"), F.col("line_start").alias("line"))
    right = symbols.select("path", "name", F.col("symbol_id").alias("new"), F.col("line_start").alias("there"))

    def choose(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for retrieval, own in a.groupby("retrieval_id", sort=True):
            free = {int(i): int(t) for i, t in zip(b["new"], b["there"], strict=True)}
            left_over = []
            for r in own.sort_values("rank").itertuples():
                if r.old in free:
                    free.pop(r.old)
                    rows.append((retrieval, r.rank, r.old, "id"))
                else:
                    left_over.append(r)
            still = []
            for r in left_over:
                exact = min((i for i, t in free.items() if t == r.line), default=None)
                if exact is None:
                    still.append(r)
                else:
                    free.pop(exact)
                    rows.append((retrieval, r.rank, exact, "place"))
            for r in still:
                near = min(free, key=lambda i: (abs(free[i] - r.line), free[i], i), default=None)
                if near is not None:
                    free.pop(near)
                rows.append((retrieval, r.rank, near, "nearest" if near is not None else None))
        return pd.DataFrame(rows, columns=["retrieval_id", "rank", "symbol_id", "matched"]).astype({"symbol_id": "Int64"})

    return left.groupBy("path", "name").cogroup(right.groupBy("path", "name")).applyInPandas(choose, "retrieval_id long, rank int, symbol_id long, matched string")
