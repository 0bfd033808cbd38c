"""The graph store: versioned Parquet tables of nodes and edges with merge, upsert and delete.

A write makes new version directories and then one pointer file of the next number, which names what every table consists of; the pointer of the largest
number counts. So readers see whole versions of all tables together, and a write that fails anywhere leaves the one before. All mutations are joins by key.
A table is a whole one and the changes since; a change holds only the rows that it puts and the keys that go, so a small batch is a small write.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from .dedup import last_per


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """*old* with the rows of *new* put over it. Columns that one side lacks are null."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """*old* and those rows of *new* whose key it lacks."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def unique_nodes(entities: DataFrame, order: str | None = None) -> DataFrame:
    """Storable nodes, one a name: the last in *order*, or any where there is none. A repeated name never loses a batch."""
    nodes = model.storable(entities).where("name IS NOT NULL").withColumn("id", model.entity_id("name"))
    return last_per(nodes, ["id"], order).drop(order) if order else nodes.dropDuplicates(["id"])


def rejected(entities: DataFrame) -> DataFrame:
    """How many rows of a batch are not stored, by reason."""
    kinds = F.when(F.col("name").isNull(), "no name").when(F.coalesce("type", F.lit("")) == model.UNSTORED_TYPE, "type is not stored")
    stored = entities.where(kinds.isNull())
    lost = entities.where(kinds.isNotNull()).groupBy(kinds.alias("reason")).count()
    repeats = stored.groupBy("name").count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("count"))
    return lost.unionByName(repeats.select(F.lit("repeated name").alias("reason"), "count").where("count > 0"))


def resolve(relations: DataFrame, nodes: DataFrame, fold_case: bool = True) -> DataFrame:
    """Relations (s, p, o) with ``subject_id`` and ``object_id``: by exact name, else by lower-cased name; null if unknown.

    All nodes stand on one side, so the joins merge: by the size of the files that they come from, millions of short rows would be broadcast.
    """
    exact = nodes.select("name", "id").dropDuplicates(["name"]).hint("merge")
    lower = nodes.groupBy(F.lower("name").alias("lname")).agg(F.min("id").alias("lid")).hint("merge")
    out = relations
    for end, to in (("s", "subject_id"), ("o", "object_id")):
        out = out.join(exact.select(F.col("name").alias(end), F.col("id").alias(f"__{end}")), end, "left")
        found = F.col(f"__{end}")
        if fold_case:
            out = out.join(lower.select(F.col("lname").alias(f"__k{end}"), F.col("lid").alias(f"__l{end}")), F.lower(end) == F.col(f"__k{end}"), "left")
            found = F.coalesce(found, F.col(f"__l{end}"))
        out = out.withColumn(to, found).drop(f"__{end}", f"__l{end}", f"__k{end}")
    return out


def edges_of(relations: DataFrame, confidence: float = 0.5, source: str | None = None) -> DataFrame:
    """Edge rows of resolved relations; those with an unknown end are left out."""
    have = set(relations.columns)
    text = lambda c: (F.col(c) if c in have else F.lit(None)).cast("string").alias(c)
    rows = relations.where("subject_id IS NOT NULL AND object_id IS NOT NULL")
    share = F.coalesce(F.col("confidence"), F.lit(confidence)) if "confidence" in have else F.lit(confidence)
    return rows.select(
        model.relationship_id("s", "p", "o").alias("relationship_id"), "subject_id", "object_id", F.col("p").alias("predicate"), share.cast("double").alias("confidence"),
        text("occurrence_time"), text("description"), F.lit(source).cast("string").alias("source"),
    )


def save_all(entities: DataFrame, relations: DataFrame, datasource: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one batch; relation ends are looked up within the batch."""
    nodes = unique_nodes(entities.withColumn("datasource", F.lit(datasource)))
    edges = edges_of(resolve(relations, nodes)).dropDuplicates(["relationship_id"])
    return model.with_defaults(nodes), edges


def save_entities_only(entities: DataFrame, datasource: str) -> DataFrame:
    """Nodes of one batch without relations."""
    return model.with_defaults(unique_nodes(entities.withColumn("datasource", F.lit(datasource))))


def save_edges_only(relations: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends exist, and the relations that wait for an end, with empty text for the missing ids."""
    found = resolve(relations, nodes)
    waiting = found.where("subject_id IS NULL OR object_id IS NULL").na.fill("", ["subject_id", "object_id"])
    return edges_of(found).dropDuplicates(["relationship_id"]), waiting


def upsert_edges_by_name(edges: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges with (s, p, o) relations put over them; names must match exactly, a relation with a missing end writes nothing."""
    return merge(edges, edges_of(resolve(relations, nodes, fold_case=False)).dropDuplicates(["relationship_id"]), "relationship_id")


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi")


def detach_delete(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the doomed ids, and edges that touch none of them."""
    ids = doomed.select("id").distinct()
    left = nodes.join(ids, "id", "left_anti")
    e = edges.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_anti")
    return left, e.join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_anti")


def delete_by_datasource(nodes: DataFrame, edges: DataFrame, prefix: str, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    doomed = nodes.where(F.coalesce(model.under("datasource", prefix, strict), F.lit(False)))
    return *detach_delete(nodes, edges, doomed), doomed


def update_entity(nodes: DataFrame, entity: str, changes: dict[str, str | None]) -> DataFrame:
    """Set properties of one node; None clears a property; renaming does not change the id."""
    hit = F.col("id") == entity
    kinds = dict(nodes.dtypes)
    for name, value in changes.items():
        old = F.col(name) if name in kinds else F.lit(None)
        nodes = nodes.withColumn(name, F.when(hit, F.lit(value).cast(kinds.get(name, "string"))).otherwise(old))
    return nodes


class GraphStore:
    """Nodes and edges under one folder; and, for a stream, the newest event of each row (``seen``)."""

    KEYS = {"nodes": "id", "edges": "relationship_id", "seen": "name"}
    SCHEMAS = {"nodes": model.NODE, "edges": model.EDGE, "seen": "name string, ms long, n long"}
    #: Changes kept beside a table before it is written whole again.
    CHANGES = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _pointers(self) -> list[tuple[int, str]]:
        """Numbers and file names of the pointers, newest first."""
        if not self.fs.exists(self._at()):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at())]
        return sorted(((int(m[1]), n) for n in names if (m := re.fullmatch(r"graph\.(\d+)\.json", n))), reverse=True)

    def _state(self) -> tuple[int, dict[str, list[str]]]:
        """Number of the newest version, and the folders of each table: the whole one and those of the changes since, in order."""
        found = self._pointers()
        for _, name in found:
            row = self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()
            if row is not None and row.value.endswith("}"):  # a writer that died while it wrote its pointer has made no version
                return found[0][0], json.loads(row.value)
        return (found[0][0] if found else 0), {}

    def _parts(self, table: str) -> list[str]:
        return self._state()[1].get(table, [])

    def version(self, table: str) -> str | None:
        return (self._parts(table) or [None])[-1]

    def read(self, table: str) -> DataFrame:
        parts = self._parts(table)
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMAS[table])
        whole, *changes = [self.spark.read.parquet(f"{self.path}/{table}/{p}") for p in parts]
        if not changes:
            return whole
        numbered = [c.withColumn("__n", F.lit(n)) for n, c in enumerate(changes)]
        together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
        now = last_per(together, [self.KEYS[table]], "__n").drop("__n")
        return merge(whole, now, self.KEYS[table]).where("__gone IS NOT TRUE").drop("__gone")

    def _written(self, table: str, df: DataFrame) -> str:
        """A folder of a whole table. Nodes are laid out by ranges of type and id, edges by subject, so that reads prune files and no type is one file."""
        name = uuid.uuid4().hex
        if table == "nodes":
            df = df.repartitionByRange("type", "id").sortWithinPartitions("type", "id")
        elif table == "edges":
            df = df.sortWithinPartitions("subject_id")
        df.write.parquet(f"{self.path}/{table}/{name}")
        return name

    def write(self, table: str, df: DataFrame) -> str:
        """A new version of one table."""
        return self.write_all({table: df})[table]

    def write_all(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        """New versions of several tables, which count together or not at all."""
        number, _ = self._state()
        names = {t: self._written(t, df) for t, df in tables.items()}
        self._point(number, {t: [n] for t, n in names.items()})
        return names

    def change(self, table: str, puts: DataFrame, gone: DataFrame) -> None:
        self.change_all({table: (puts, gone)})

    def change_all(self, changes: dict[str, tuple[DataFrame, DataFrame]]) -> None:
        """Put rows, one a key, over those of their keys, and take away the keys of *gone* that are not put; in all tables together.

        Writes only these rows. After ``CHANGES`` of them a table is written whole, so a read joins a bounded number of them.
        """
        number, state = self._state()
        parts = {}
        for table, (puts, gone) in changes.items():
            key, have = self.KEYS[table], state.get(table, [])
            if not have:
                parts[table] = [self._written(table, puts)]
                continue
            doomed = gone.select(key).distinct().join(puts.select(key), key, "left_anti").withColumn("__gone", F.lit(True))
            name = uuid.uuid4().hex
            puts.withColumn("__gone", F.lit(False)).unionByName(doomed, allowMissingColumns=True).write.parquet(f"{self.path}/{table}/{name}")
            parts[table] = [*have, name]
        self._point(number, parts)
        full = [t for t, p in parts.items() if len(p) > self.CHANGES + 1]
        if full:
            self.compact(*full)

    def compact(self, *tables: str, keep: int = 10) -> None:
        """Write tables whole again, without the changes beside them, and keep the *keep* newest folders of each for readers and for going back."""
        self.write_all({t: self.read(t) for t in tables})
        for t in tables:
            self.keep_newest(t, keep)

    def _point(self, number: int, parts: dict[str, list[str]]) -> None:
        """Make version *number* + 1, with the named tables' new parts and the others as they are; an error if another writer has made it."""
        state = self._state()[1] | parts
        try:
            out = self.fs.create(self._at(f"graph.{number + 1}.json"), False)
        except Py4JJavaError as e:
            raise RuntimeError(f"another writer has made version {number + 1}") from e
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        for _, old in self._pointers()[2:]:
            self.fs.delete(self._at(old), False)

    @property
    def nodes(self) -> DataFrame:
        return self.read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.read("edges")

    def upsert(self, table: str, new: DataFrame) -> None:
        """Put rows over those of their keys, as a change beside the table."""
        self.change(table, new.dropDuplicates([self.KEYS[table]]), new.limit(0))

    def delete(self, doomed: DataFrame) -> None:
        """Take nodes and the edges at them away, as one change of both tables."""
        nodes, edges = self.nodes, self.edges
        ends = edges.select("relationship_id", F.explode(F.array("subject_id", "object_id")).alias("id"))
        self.change_all({"edges": (edges.limit(0), ends.join(doomed.select("id"), "id", "left_semi")), "nodes": (nodes.limit(0), doomed.select("id"))})

    def versions(self, table: str) -> list[str]:
        """Version names, newest first."""
        if not self.fs.exists(self._at(table)):
            return []
        found = sorted(self.fs.listStatus(self._at(table)), key=lambda s: -s.getModificationTime())
        return [s.getPath().getName() for s in found]

    def keep_newest(self, table: str, n: int = 10) -> None:
        used = self._parts(table)
        for name in [v for v in self.versions(table)[n:] if v not in used]:
            self.fs.delete(self._at(table, name), True)

    def export(self, path: str, form: str = "json") -> None:
        if form not in ("json", "parquet"):
            raise ValueError(f"unknown export format: {form}")
        for table in ("nodes", "edges"):
            self.read(table).write.format(form).mode("overwrite").save(f"{path}/{table}")


def export_text(nodes: DataFrame, edges: DataFrame) -> str:
    """A small graph as one JSON text."""
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    return json.dumps({"nodes": rows(nodes), "edges": rows(edges)}, ensure_ascii=False)
