"""Remote graph, vector and key-value stores behind one small client interface, and a local client on files."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StoreClient(Protocol):
    """What a store must offer; writing the same record again must change nothing, since tasks may run twice."""

    def upsert(self, collection: str, records: list[dict]) -> None:
        """Put records by their ``id``."""

    def delete(self, collection: str, ids: list[str]) -> None:
        """Remove records; unknown ids are no error."""

    def segments(self, collection: str) -> list[str]:
        """Names of parts that can be read independently."""

    def scan(self, collection: str, segment: str) -> Iterator[dict]:
        """Records of a part."""


class Throttle:
    """Keeps the calls of one task at a rate, and repeats failing ones with growing pauses."""

    def __init__(self, per_second: float | None = None, retries: int = 3, pause: float = 0.2, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        if per_second is not None and per_second <= 0 or retries < 0:
            raise ValueError("a rate is positive and retries are not negative")
        self.gap, self.retries, self.pause = (0.0 if per_second is None else 1.0 / per_second), retries, pause
        self.clock, self.sleep, self.free_at = clock, sleep, 0.0

    def call(self, fn: Callable, *args):
        for left in range(self.retries, -1, -1):
            wait = self.free_at - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.free_at = max(self.clock(), self.free_at) + self.gap
            try:
                return fn(*args)
            except Exception:  # a client is foreign code
                if left == 0:
                    raise
                self.sleep(self.pause * 2 ** (self.retries - left))


def write_records(rows: DataFrame, collection: str, client: Callable[[], StoreClient], batch: int = 256, per_second: float | None = None, retries: int = 3) -> dict[str, int]:
    """Upsert ``rows(id, ...)`` from all tasks in batches; ``client()`` is made once a task. Returns ``{"written": n}``.

    ``per_second`` bounds the calls of each task. A batch that still fails fails the job; running it again is safe.
    """
    payload = rows.select("id", F.to_json(F.struct(*rows.columns)).alias("record"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, throttle, n = client(), Throttle(per_second, retries), 0
        for f in frames:
            records = [json.loads(r) for r in f["record"]]
            for i in range(0, len(records), batch):
                throttle.call(store.upsert, collection, records[i : i + batch])
            n += len(records)
        yield pd.DataFrame({"n": [n]})

    return {"written": int(payload.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])}


def delete_records(ids: DataFrame, collection: str, client: Callable[[], StoreClient], batch: int = 256, retries: int = 3) -> dict[str, int]:
    """Delete the records of ``ids(id)`` from all tasks in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, throttle, n = client(), Throttle(None, retries), 0
        for f in frames:
            for i in range(0, len(f), batch):
                throttle.call(store.delete, collection, f["id"].iloc[i : i + batch].tolist())
            n += len(f)
        yield pd.DataFrame({"n": [n]})

    return {"deleted": int(ids.select("id").distinct().mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])}


def read_records(spark: SparkSession, collection: str, client: Callable[[], StoreClient], schema: str, batch: int = 1_000, most_segments: int = 100_000) -> DataFrame:
    """A collection as a DataFrame of ``schema``, one task a segment; fields a record lacks are null."""
    parts = client().segments(collection)
    if len(parts) > most_segments:
        raise ValueError(f"{collection} has more than {most_segments} segments")
    if not parts:
        return spark.createDataFrame([], schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = client()
        for f in frames:
            for segment in f["segment"]:
                held: list[str] = []
                for record in store.scan(collection, segment):
                    held.append(json.dumps(record, ensure_ascii=False))
                    if len(held) == batch:
                        yield pd.DataFrame({"record": held})
                        held = []
                if held:
                    yield pd.DataFrame({"record": held})

    names = spark.createDataFrame([(p,) for p in parts], "segment string").repartition(len(parts), "segment")
    return names.mapInPandas(run, "record string").select(F.from_json("record", schema).alias("r")).select("r.*")


class FileStore:
    """A client on a folder: one JSON file a record, in folders by the first two digits of its id's hash. For tests and offline work."""

    def __init__(self, root: str) -> None:
        self.root = root

    def _path(self, collection: str, key: str) -> str:
        import hashlib

        h = hashlib.md5(key.encode()).hexdigest()
        return os.path.join(self.root, collection, h[:2], f"{h}.json")

    def upsert(self, collection: str, records: list[dict]) -> None:
        for r in records:
            path = self._path(collection, r["id"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}.{os.getpid()}", "w", encoding="utf-8") as f:
                json.dump(r, f, ensure_ascii=False)
            os.replace(f"{path}.{os.getpid()}", path)

    def delete(self, collection: str, ids: list[str]) -> None:
        for i in ids:
            try:
                os.remove(self._path(collection, i))
            except FileNotFoundError:
                pass

    def segments(self, collection: str) -> list[str]:
        folder = os.path.join(self.root, collection)
        return sorted(os.listdir(folder)) if os.path.isdir(folder) else []

    def scan(self, collection: str, segment: str) -> Iterator[dict]:
        folder = os.path.join(self.root, collection, segment)
        for name in sorted(os.listdir(folder)):
            if name.endswith(".json"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    yield json.load(f)


def save_graph(tables: dict[str, DataFrame], client: Callable[[], StoreClient], **options) -> dict[str, int]:
    """Every table of a graph as a collection of its name: ``{name: records written}``."""
    return {name: write_records(df, name, client, **options)["written"] for name, df in tables.items()}
