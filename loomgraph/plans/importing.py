"""Relational tables to nodes and edges: one lazy plan a table, no per-row loops."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..operators.graph import cross_if_small


@dataclass
class Table:
    """A source table: its rows, key, foreign keys as (column, referenced table, referenced column) and node type."""

    name: str
    rows: DataFrame
    keys: list[str]
    foreign: list[tuple[str, str, str]] = field(default_factory=list)
    type: str = model.ROW_TYPE


def row_nodes(table: Table, datasource: str, strict: bool = False) -> DataFrame:
    """A node for each row that has its key."""
    name = model.entity_name(table.name, *table.keys, strict=strict)
    rows = table.rows.select(name.alias("name"), model.describe(*table.rows.columns).alias("description")).where("name IS NOT NULL")
    return rows.select(
        model.entity_id("name").alias("id"), "name", F.lit(table.type).alias("type"), F.lit(1).alias("count"), F.lit(1.0).alias("confidence"),
        F.lit(None).cast("string").alias("byname"), F.lit(f"{datasource}/{table.name}").alias("datasource"), "description",
    )


def _edge(pairs: DataFrame, predicate: str, confidence: float, source: str) -> DataFrame:
    ids = pairs.withColumns({"subject_id": model.entity_id("subject"), "object_id": model.entity_id("object"), "predicate": F.lit(predicate)})
    return ids.select(
        model.relationship_id("subject_id", "predicate", "object_id").alias("relationship_id"), "subject_id", "object_id", "predicate",
        F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("occurrence_time"), F.lit(None).cast("string").alias("description"),
        F.lit(source).alias("source"), "subject", "object",
    )


def fk_edges(child: Table, column: str, parent: Table, referenced: str, mode: str = "all", confidence: float = 1.0) -> DataFrame:
    """Edges child row -> parent row where child.column = parent.referenced.

    ``all``: one for each child row, as the change stream makes them. ``last``: one for each value, from the last child
    row by key, compared with the parent's whole key text.
    """
    kids = child.rows.select(F.col(column).cast("string").alias("v"), model.entity_name(child.name, *child.keys).alias("subject"), F.struct(*child.keys).alias("k")).where("v IS NOT NULL AND subject IS NOT NULL")
    value = F.col(referenced).cast("string") if mode == "all" else model.pk_value(*parent.keys)
    parents = parent.rows.select(value.alias("v"), model.entity_name(parent.name, *parent.keys).alias("object")).where("v IS NOT NULL AND object IS NOT NULL")
    if mode == "last":
        kids = kids.groupBy("v").agg(F.max_by("subject", "k").alias("subject"))
    elif mode != "all":
        raise ValueError(f"unknown mode: {mode}")
    return _edge(kids.select("v", "subject").join(parents, "v").select("subject", "object"), model.FK_PREDICATE, confidence, "fk")


def inferred_edges(a: Table, b: Table, kind: str, columns: tuple[str, str] | None = None, mode: str = "all", confidence: float = 0.5) -> DataFrame:
    """Edges of an inferred relationship: rows of equal values, or all pairs of two tiny tables where no columns are named."""
    def side(t: Table, column: str | None, end: str) -> DataFrame:
        value = F.col(column).cast("string") if column else F.lit("")
        return t.rows.select(value.alias("v"), model.entity_name(t.name, *t.keys).alias(end), F.struct(*t.keys).alias(f"k_{end}")).where(f"v IS NOT NULL AND {end} IS NOT NULL")

    left, right = side(a, columns and columns[0], "subject"), side(b, columns and columns[1], "object")
    if columns is None:
        return _edge(cross_if_small(left.select("subject"), right.select("object")), kind, confidence, "inferred")
    if mode == "last":
        left, right = (d.groupBy("v").agg(F.max_by(e, f"k_{e}").alias(e)) for d, e in ((left, "subject"), (right, "object")))
    return _edge(left.select("v", "subject").join(right.select("v", "object"), "v").select("subject", "object"), kind, confidence, "inferred")


def import_graph(tables: list[Table], datasource: str, mode: str = "all") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all tables; an edge keeps the names of its ends in ``subject`` and ``object``."""
    by_name = {t.name: t for t in tables}
    nodes = edges = None
    for t in tables:
        n = row_nodes(t, datasource)
        nodes = n if nodes is None else nodes.unionByName(n)
        for column, to, referenced in t.foreign:
            e = fk_edges(t, column, by_name[to], referenced, mode)
            edges = e if edges is None else edges.unionByName(e)
    return nodes.dropDuplicates(["id"]), edges.dropDuplicates(["relationship_id"]) if edges is not None else None
