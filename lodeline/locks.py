"""One writer at a time, and steps that only one of several writers can take, by files of the shared store.

Both rest on creating a file that must not exist yet, which stores that Hadoop's interface covers do in one step.
"""

from __future__ import annotations

import os
import threading
import time
import uuid

from pyspark.sql import SparkSession

STALE_S, WAIT_S, BEAT_S = 10.0, 0.5, 2.0


class Conflict(RuntimeError):
    """Another writer was first."""


def _store(spark: SparkSession, path: str):
    spot = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spot.getFileSystem(spark._jsc.hadoopConfiguration()), spot


def create(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Write a small file; False if it exists and is not to be replaced."""
    fs, spot = _store(spark, path)
    if not replace and fs.exists(spot):
        return False
    try:
        out = fs.create(spot, replace)
    except Exception:  # noqa: BLE001  the store's own error class says that the file came into being meanwhile
        if fs.exists(spot):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def text_of(spark: SparkSession, path: str) -> str | None:
    fs, spot = _store(spark, path)
    if not fs.exists(spot):
        return None
    source = fs.open(spot)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The whole numbers that name files of a folder, ascending."""
    fs, spot = _store(spark, folder)
    if not fs.exists(spot):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(spot)]
    return sorted(int(n) for n in names if n.isdigit())


def take_next(spark: SparkSession, folder: str, text: str = "", after: int | None = None) -> int:
    """The next number of a folder, which nobody else gets. With ``after`` it must be the one behind it, else Conflict."""
    while True:
        held = numbers(spark, folder)
        number = (held[-1] if held else 0) + 1
        if after is not None and number != after + 1:
            raise Conflict(f"{folder}: {number - 1} came after {after}")
        if create(spark, f"{folder}/{number}", text):
            return number


class Writer:
    """``with Writer(spark, folder):`` holds the folder's lock, kept fresh by a beat.

    A lock whose beat is older than STALE_S belonged to a process that ended, and is taken over. Another that stays fresh
    for WAIT_S raises Conflict.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.path, self.owner, self._done = spark, f"{folder}/LOCK", f"{os.getpid()}-{uuid.uuid4().hex}", threading.Event()

    def _said(self) -> str:
        return f"{self.owner} {time.time()}"

    def _try(self) -> bool:
        if create(self.spark, self.path, self._said()):
            return True
        held = text_of(self.spark, self.path)
        parts = (held or "").split()
        if len(parts) == 2 and time.time() - float(parts[1]) <= STALE_S:
            return False
        fs, spot = _store(self.spark, self.path)
        if text_of(self.spark, self.path) == held:
            fs.delete(spot, False)
        return create(self.spark, self.path, self._said())

    def __enter__(self) -> Writer:
        until = time.time() + WAIT_S
        while not self._try():
            if time.time() >= until:
                raise Conflict("another writer holds the lock")
            time.sleep(0.05)
        self._beat = threading.Thread(target=self._keep, daemon=True)
        self._beat.start()
        return self

    def _keep(self) -> None:
        while not self._done.wait(BEAT_S):
            create(self.spark, self.path, self._said(), replace=True)

    def __exit__(self, *_: object) -> None:
        self._done.set()
        self._beat.join()
        if (text_of(self.spark, self.path) or "").startswith(self.owner):
            fs, spot = _store(self.spark, self.path)
            fs.delete(spot, False)
