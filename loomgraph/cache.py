"""Results kept as tables under a fingerprint of their plan and the version of what they were made from, with an age at which they expire."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators.paths import _place


class ResultCache:
    """Under one shared folder: a folder a result, ``<key>/<milliseconds>-<name>``, written whole before it has that name."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = 3600, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.seconds, self.clock = spark, path.rstrip("/"), seconds, clock
        self.hits = self.misses = 0

    def key(self, df: DataFrame, version: str = "") -> str:
        """Plans that Spark holds to be the same, over the same files and version, have one key."""
        text = "\n".join([str(df.semanticHash()), df.schema.json(), version, *sorted(df.inputFiles())])
        return hashlib.sha256(text.encode()).hexdigest()

    def _entries(self, key: str) -> list[tuple[int, str]]:
        at, store = _place(self.spark, f"{self.path}/{key}")
        names = [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []
        return sorted(((int(n.split("-")[0]), n) for n in names if n[0].isdigit()), reverse=True)

    def get(self, df: DataFrame, version: str = "") -> DataFrame:
        """The rows of *df*: from the cache where a result is there that has not expired, else computed and kept."""
        key = self.key(df, version)
        now = int(self.clock() * 1000)
        for made, name in self._entries(key):
            if now - made < self.seconds * 1000:
                self.hits += 1
                return self.spark.read.schema(df.schema).parquet(f"{self.path}/{key}/{name}")
        self.misses += 1
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{key}/_{name}")
        source, store = _place(self.spark, f"{self.path}/{key}/_{name}")
        target, _ = _place(self.spark, f"{self.path}/{key}/{now}-{name}")
        if not store.rename(source, target):
            raise RuntimeError(f"could not keep a result under {target}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{key}/{now}-{name}")

    def invalidate(self, df: DataFrame | None = None, version: str = "") -> None:
        """Forget one result, or all."""
        at, store = _place(self.spark, f"{self.path}/{self.key(df, version)}" if df is not None else self.path)
        store.delete(at, True)

    def purge(self) -> int:
        """Remove expired results; the number of them."""
        at, store = _place(self.spark, self.path)
        now, gone = int(self.clock() * 1000), 0
        for status in store.listStatus(at) if store.exists(at) else []:
            key = status.getPath().getName()
            for made, name in self._entries(key):
                if now - made >= self.seconds * 1000:
                    store.delete(_place(self.spark, f"{self.path}/{key}/{name}")[0], True)
                    gone += 1
        return gone
