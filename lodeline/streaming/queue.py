"""The work queue as a keyed state machine over a stream of log rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3
OUT = "symbol_id long, seq long, stage int, attempts int, last_error string, live boolean"
STATE = "hash string, stage int, attempts int, last_error string, live boolean, seq long"


def step(state: tuple | None, seq: int, hash_: str, event: str, error: str | None) -> tuple | None:
    """State (hash, stage, attempts, last_error, live, seq) after one row.

    A requeue with a newer hash starts anew; what arrives for another hash, or late, changes nothing.
    """
    if event in ("queued", "requeued"):
        if state and state[5] > seq:
            return state
        return (hash_, 0, 0, None, True, seq)
    if not state or not state[4] or state[0] != hash_ or seq < state[5]:
        return state
    _, stage, attempts, last, live, _ = state
    if event == "failed":
        attempts, last = attempts + 1, error
    elif event == "outage":
        last = error
    elif event == "has_process":
        stage = 1
    elif event == "stepped" or (event == "extracted" and stage == 0):
        live = False
    return (hash_, stage, attempts, last, live, seq)


class Queue(StatefulProcessor):
    """Emits a symbol's state whenever a micro-batch changed it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("queue", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = tuple(self.state.get()) if self.state.exists() else None
        now = before
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            now = step(now, int(r.seq), r.hash, r.event, None if pd.isna(r.error) else r.error)
        if now is not None and now != before:
            self.state.update(now)
            yield pd.DataFrame([(key[0], now[5], now[1], now[2], now[3], now[4])], columns=["symbol_id", "seq", "stage", "attempts", "last_error", "live"])

    def close(self) -> None:
        pass


def queue_states(log: DataFrame) -> DataFrame:
    """Changes of state from a stream (seq, symbol_id, hash, event, error). Needs the RocksDB state store."""
    return log.groupBy("symbol_id").transformWithStateInPandas(Queue(), OUT, "Update", "None")


def due(states: DataFrame, limit: int) -> DataFrame:
    """Work of one tick from the latest states: live rows with attempts left, oldest first."""
    return states.filter(F.col("live") & (F.col("attempts") < MAX_ATTEMPTS)).orderBy("seq", "symbol_id").limit(limit)
