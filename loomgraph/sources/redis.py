"""A Redis stream as a PySpark streaming source: bounded batches, a stream split into ranges of ids, and a consumer group that is told what is done.

The checkpoint holds the offsets, so nothing is lost or taken twice over a restart. The group's position follows the committed offsets and shows others
how far the reader is; a reader without a checkpoint starts there.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class _Range(InputPartition):
    """Ids after *start* up to and with *end*."""

    def __init__(self, key: str, start: str, end: str):
        self.key, self.start, self.end = key, start, end


def _client(options: dict):
    """A client of the ``url``; ``client`` may name another factory as ``module:function``."""
    if "client" in options:
        module, name = options["client"].split(":")
        return getattr(import_module(module), name)(options["url"])
    import redis  # optional: only streams from Redis need it

    return redis.Redis.from_url(options["url"], decode_responses=True)


def number(seq: str) -> tuple[int, int]:
    ms, _, n = seq.partition("-")
    return int(ms), int(n or 0)


class RedisReader(DataSourceStreamReader):
    """Options: ``streams`` (keys by comma), ``group``, ``start`` (earliest, latest), ``rows`` most of a stream in a batch, ``parts`` tasks a stream, ``count`` messages a call."""

    def __init__(self, options: dict):
        self.options = options
        self.keys = options["streams"].split(",")
        self.at: dict | None = None

    def _group(self, client, key: str) -> str | None:
        """Where the group stands, or nothing."""
        for g in client.xinfo_groups(key) if self.options.get("group") and client.exists(key) else []:
            if g["name"] == self.options["group"]:
                return g["last-delivered-id"]
        return None

    def initialOffset(self) -> dict:
        client, start = _client(self.options), self.options.get("start", "latest")
        last = {k: client.xrevrange(k, count=1) for k in self.keys}
        fresh = {k: v[0][0] if v and start == "latest" else "0-0" for k, v in last.items()}
        self.at = {k: self._group(client, k) or fresh[k] for k in self.keys}
        return dict(self.at)

    def latestOffset(self) -> dict:
        """At most ``rows`` messages of each stream beyond what was planned last."""
        client, rows = _client(self.options), int(self.options.get("rows", 10_000))
        if self.at is None:  # after a restart, before Spark has told where the checkpoint stands
            self.at = {k: self._group(client, k) or "0-0" for k in self.keys}
        out = {}
        for key in self.keys:
            at, left = self.at[key], rows
            while left > 0 and (found := client.xrange(key, min=f"({at}", max="+", count=min(left, 1000))):
                at, left = found[-1][0], left - len(found)
            out[key] = at
        self.at = out
        return dict(out)

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        """Each stream's ids in up to ``parts`` ranges of equal time."""
        parts, out = int(self.options.get("parts", 4)), []
        self.at = {k: max(self.at[k], end[k], key=number) if self.at else end[k] for k in self.keys}
        for key in self.keys:
            (lo, _), (hi, _) = number(start[key]), number(end[key])
            if number(start[key]) >= number(end[key]):
                continue
            first, _ = number((_client(self.options).xrange(key, min=f"({start[key]}", max=end[key], count=1) or [(start[key], None)])[0][0])
            lo = max(lo, first)
            cuts = sorted({lo + (hi - lo) * i // parts for i in range(1, parts)} - {hi})
            bounds = [start[key], *[f"{c}-{2**64 - 1}" for c in cuts if number(start[key]) < (c, 2**64 - 1)], end[key]]
            out += [_Range(key, a, b) for a, b in zip(bounds, bounds[1:])]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        client, at, count = _client(self.options), f"({partition.start}", int(self.options.get("count", 100))
        while batch := client.xrange(partition.key, min=at, max=partition.end, count=count):
            for seq, fields in batch:
                yield seq, partition.key, fields.get("payload"), fields.get("value")
            at = f"({batch[-1][0]}"

    def commit(self, end: dict) -> None:
        """Acknowledge: move the group to what is done."""
        group = self.options.get("group")
        client = _client(self.options) if group else None
        for key in self.keys if group else ():
            if self._group(client, key) is None:
                client.xgroup_create(key, group, id=end[key], mkstream=True)
            else:
                client.xgroup_setid(key, group, end[key])


class RedisStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "redis_stream"

    def schema(self) -> str:
        return "seq string, stream string, payload string, value string"

    def streamReader(self, schema) -> RedisReader:
        return RedisReader(dict(self.options))


def stream_key(prefix: str, database: str, table: str) -> str:
    return f"{prefix}.{database}.{table}"
