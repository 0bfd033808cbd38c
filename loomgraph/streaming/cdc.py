"""Change data capture: envelopes to a graph that follows its source tables.

Batch functions do the work; the stream runs them in ``foreachBatch``. Within a batch only the newest event of a row
counts. Merging is idempotent, so overlap with a bulk import and replays after a restart change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import model
from ..operators.dedup import last_per
from ..operators.paths import _cut
from ..operators.store import GraphStore, detach_delete, merge
from ..operators.textindex import TextIndex

SOURCE = "cdc_fk"
_ROW = "map<string,string>"
ENVELOPE = f"op string, before {_ROW}, after {_ROW}, source struct<table: string>, ts_ms bigint"
CHANGES = f"seq string, op string, table string, row {_ROW}, ts_ms long"


@dataclass
class Schema:
    """What the stream needs of one table."""

    name: str
    columns: list[str]
    keys: list[str]
    foreign: list[tuple[str, str]]
    type: str = model.ROW_TYPE


def _read(messages: DataFrame) -> DataFrame:
    """The messages with their envelope ``__e`` and the row that it puts or deletes, null for a message that makes no change."""
    have = set(messages.columns)
    raw = F.coalesce(*[F.col(c).cast("string") for c in ("payload", "value") if c in have])
    inner = F.coalesce(F.get_json_object(raw, "$.payload"), raw)
    # The condition holds for every row; as the optimizer takes it for non-deterministic, it copies the parse neither into filters nor once a field.
    once = F.monotonically_increasing_id() >= 0
    rows = messages.withColumn("__e", F.when(once, F.from_json(inner, ENVELOPE, {"mode": "PERMISSIVE"})))
    row = F.when(F.col("__e.op").isin("c", "r", "u"), F.col("__e.after")).when(F.col("__e.op") == "d", F.col("__e.before"))
    return rows.withColumn("__row", F.when(F.col("__e.source.table").isNotNull(), row))


def parse(messages: DataFrame) -> DataFrame:
    """(seq, payload | value) messages to changes: c, r, u carry the row after, d the row before; anything else is left out.

    The envelope may be wrapped in ``{schema, payload}``; text that is no JSON is left out.
    """
    seq = F.col("seq").cast("string") if "seq" in messages.columns else F.lit("0-0")
    rows = _read(messages).where("__row IS NOT NULL")
    return rows.select(seq.alias("seq"), F.col("__e.op").alias("op"), F.col("__e.source.table").alias("table"), F.col("__row").alias("row"), F.col("__e.ts_ms").alias("ts_ms"))


def rejected(messages: DataFrame) -> DataFrame:
    """Messages that make no change, each as it came, for a dead-letter table; ids may repeat over streams or be missing."""
    return _read(messages).where("__row IS NULL").select(*messages.columns)


def order_of(seq: Column) -> Column:
    """Stream ids ``ms-n`` compare as numbers, not as text."""
    part = F.split(seq, "-")
    return F.struct(F.get(part, F.lit(0)).try_cast("long").alias("ms"), F.coalesce(F.get(part, F.lit(1)).try_cast("long"), F.lit(0)).alias("n"))


def _name(schemas: list[Schema]) -> Column:
    out = F.lit(None).cast("string")
    for s in schemas:
        keys = s.keys or s.columns[:1]
        out = F.when(F.col("table") == s.name, model.entity_name(s.name, *[F.col("row")[k] for k in keys], strict=True)).otherwise(out)
    return out


def latest(changes: DataFrame, schemas: list[Schema]) -> DataFrame:
    """One change a row of the source: the last in the stream."""
    named = changes.withColumn("name", _name(schemas)).where("name IS NOT NULL").withColumn("__o", order_of(F.col("seq")))
    return last_per(named, ["name"], "__o").drop("__o")


def newer(changes: DataFrame, seen: DataFrame) -> DataFrame:
    """Changes that are not older than what was seen of their rows; the same event again counts, as a batch may be run again."""
    known = seen.select("name", F.struct("ms", "n").alias("__seen"))
    return changes.join(known, "name", "left").where(F.col("__seen").isNull() | (order_of(F.col("seq")) >= F.col("__seen")) | order_of(F.col("seq"))["ms"].isNull()).drop("__seen")


def nodes_of(changes: DataFrame, schemas: list[Schema], datasource: str) -> DataFrame:
    """Nodes of the rows that were put; columns in catalog order, absent ones empty."""
    out = None
    for s in schemas:
        text = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col("row")[c], F.lit(""))) for c in s.columns])
        part = changes.where((F.col("table") == s.name) & (F.col("op") != "d")).select(
            model.entity_id("name").alias("id"), "name", F.lit(s.type).alias("type"), F.lit(1).alias("count"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("byname"),
            F.lit(f"{datasource}/{s.name}").alias("datasource"), text.alias("description"), F.timestamp_millis("ts_ms").alias("cdc_updated_at"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def wanted_edges(changes: DataFrame, schemas: list[Schema]) -> DataFrame:
    """Foreign-key edges that the put rows should have; a null key has none."""
    out = None
    for s in schemas:
        for column, to in s.foreign:
            obj = model.entity_name(to, F.col("row")[column], strict=True)
            part = changes.where((F.col("table") == s.name) & (F.col("op") != "d")).select("name", obj.alias("object")).where("object IS NOT NULL")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return changes.sparkSession.createDataFrame([], model.EDGE)
    ids = out.withColumns({"subject_id": model.entity_id("name"), "object_id": model.entity_id("object"), "predicate": F.lit(model.FK_PREDICATE)})
    return ids.select(
        model.relationship_id("subject_id", "predicate", "object_id").alias("relationship_id"), "subject_id", "object_id", "predicate", F.lit(1.0).alias("confidence"),
        F.lit(None).cast("string").alias("occurrence_time"), F.lit(None).cast("string").alias("description"), F.lit(SOURCE).alias("source"),
    ).dropDuplicates(["relationship_id"])


def fk_diff(changes: DataFrame, schemas: list[Schema], edges: DataFrame, cdc_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(stale, new) edges of the put rows. Edges of the bulk import count as present unless *cdc_only*."""
    want = wanted_edges(changes, schemas)
    subjects = changes.where("op <> 'd'").select(model.entity_id("name").alias("subject_id")).distinct()
    sources = [SOURCE] if cdc_only else [SOURCE, "fk"]
    have = edges.where(F.col("source").isin(sources)).join(subjects, "subject_id", "left_semi")
    return have.join(want.select("relationship_id"), "relationship_id", "left_anti"), want.join(have.select("relationship_id"), "relationship_id", "left_anti")


@dataclass
class Delta:
    """What a batch puts and takes away: whole rows, and ids."""

    nodes: DataFrame
    gone_nodes: DataFrame
    edges: DataFrame
    gone_edges: DataFrame


def delta(edges: DataFrame, changes: DataFrame, schemas: list[Schema], datasource: str, cdc_only: bool = False) -> Delta:
    """The difference that one batch of changes makes, for a store to write beside what it has; edges at a deleted row go with it."""
    now = _cut(latest(changes, schemas))  # four tables follow from it: the messages are parsed for one
    stale, new = fk_diff(now, schemas, edges, cdc_only)
    doomed = now.where("op = 'd'").select(model.entity_id("name").alias("id"))
    ends = edges.select("relationship_id", F.explode(F.array("subject_id", "object_id")).alias("id"))
    gone = stale.select("relationship_id").unionByName(ends.join(doomed, "id", "left_semi").select("relationship_id"))
    return Delta(nodes_of(now, schemas, datasource), doomed, detach_delete(doomed, new, doomed)[1], gone)


def apply(nodes: DataFrame, edges: DataFrame, changes: DataFrame, schemas: list[Schema], datasource: str, cdc_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after one batch of changes."""
    now = _cut(latest(changes, schemas))
    stale, new = fk_diff(now, schemas, edges, cdc_only)
    edges = merge(edges.join(stale.select("relationship_id"), "relationship_id", "left_anti"), new, "relationship_id")
    nodes = merge(nodes, nodes_of(now, schemas, datasource), "id")
    return detach_delete(nodes, edges, now.where("op = 'd'").select(model.entity_id("name").alias("id")))


def placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that edges refer to and no node has: a child that came before its parent."""
    ends = edges.select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


class Follower:
    """Keeps a store in step with a stream of messages."""

    def __init__(self, store: GraphStore, schemas: list[Schema], datasource: str, checkpoint: str, dead_letters: str | None = None, index: TextIndex | None = None):
        self.store, self.schemas, self.datasource = store, schemas, datasource
        self.checkpoint, self.dead_letters, self.index = checkpoint, dead_letters, index
        self.query: StreamingQuery | None = None

    def batch(self, messages: DataFrame, number: int) -> None:
        """Write what the batch changes, all tables together; a batch that is run again after a failure writes the same rows.

        The newest event of each row is kept, of deleted ones too: an older event that comes in a later batch, as streams may overtake each other, changes nothing.
        """
        messages.persist()
        try:
            now = _cut(newer(latest(parse(messages), self.schemas), self.store.read("seen")))
            d = delta(self.store.edges, now, self.schemas, self.datasource)
            o = order_of(F.col("seq"))
            seen = now.select("name", F.coalesce(o["ms"], F.lit(0)).alias("ms"), o["n"].alias("n"))
            self.store.change_all({"edges": (d.edges, d.gone_edges), "nodes": (d.nodes, d.gone_nodes), "seen": (seen, seen.limit(0))})
            if self.index is not None:
                self.index.update(d.nodes, d.gone_nodes)
            if self.dead_letters:
                rejected(messages).withColumn("batch", F.lit(number)).write.mode("append").parquet(self.dead_letters)
        finally:
            messages.unpersist()

    def start(self, messages: DataFrame, once: bool = False) -> StreamingQuery:
        writer = messages.writeStream.foreachBatch(self.batch).option("checkpointLocation", self.checkpoint)
        self.query = (writer.trigger(availableNow=True) if once else writer).start()
        return self.query

    def stop(self) -> None:
        if self.query:
            self.query.stop()

    def status(self) -> dict:
        q = self.query
        return {"running": bool(q and q.isActive), "batches": len(q.recentProgress) if q else 0, "rows": sum(p["numInputRows"] for p in q.recentProgress) if q else 0}


def read_folder(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """A stream of JSON message files (seq, payload)."""
    return spark.readStream.schema("seq string, payload string, value string").option("maxFilesPerTrigger", per_batch).json(path)


def gap(oldest: str | None, last: str | None) -> bool:
    """Whether messages were lost between the last one taken and the oldest one kept; an emptied stream lost some."""
    if not last:
        return False
    if not oldest:
        return True
    number = lambda s: tuple(int(x) for x in (s.split("-") + ["0"])[:2])
    return number(oldest) > number(last)


def progress(changes: DataFrame) -> DataFrame:
    """One row: newest stream id, newest event time, number of events."""
    return changes.agg(F.max_by("seq", order_of(F.col("seq"))).alias("last_message_id"), F.max("ts_ms").alias("last_event_ts"), F.count(F.lit(1)).alias("events_processed"))


def windowed(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by tumbling window with a watermark: events later than *late* are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def backoff(attempt: int, most: int = 30) -> int:
    """Seconds to wait before a restart."""
    return min(most, 2**attempt)


def handoff(follower: Follower, nodes: DataFrame, edges: DataFrame, messages: DataFrame, once: bool = False) -> StreamingQuery:
    """Write a bulk import, then follow the messages from where their checkpoint stands.

    The stream should start at the log position taken before the import was read: what it repeats changes nothing.
    """
    follower.store.upsert("nodes", nodes)
    follower.store.upsert("edges", edges.drop("subject", "object"))
    return follower.start(messages, once)
