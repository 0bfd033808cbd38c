"""Descriptions for a catalog by a language model: prompt, compact answer, merge.

The compact answer is ``{"db": {ov, dom, ke}, "tables": [{t, d, et, cols: [{c, d}]}], "rels": [{s, sc, t, tc, r, d}]}``. Without a model
the catalog passes unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import INFERRED, Catalog, annotate
from ..functions import folds
from ..operators.paths import _cut

# Compact keys and the fields that they stand for.
DB_KEYS = {"ov": "db_description", "dom": "business_domain", "ke": "key_entities"}
TABLE_KEYS = {"t": "table_name", "d": "description", "et": "entity_type"}
RELATION_KEYS = {"s": "source_table", "sc": "source_column", "t": "target_table", "tc": "target_column", "r": "relationship_type", "d": "description"}


def schema_lines(catalog: Catalog) -> DataFrame:
    """(table_name, line): a table and its columns as one line of a prompt."""
    column = F.concat(F.col("column_name"), F.lit(" "), F.col("data_type"), F.when(F.coalesce("column_key", F.lit("")) != "", F.concat(F.lit(" "), F.col("column_key"))).otherwise(""))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", column.alias("c")))), lambda x: x.c)
    return catalog.columns.groupBy("table_name").agg(F.concat(F.first("table_name"), F.lit("("), F.array_join(listed, ", "), F.lit(")")).alias("line"))


def prompt(catalog: Catalog, instructions: str = "Describe these tables.") -> str:
    """One prompt for a whole schema; a schema has as many lines as tables."""
    keys = catalog.foreign.select(F.concat_ws(" ", F.concat_ws(".", "table_name", "column_name"), F.lit("->"), F.concat_ws(".", "referenced_table", "referenced_column")).alias("line"))
    rows = [r.line for r in schema_lines(catalog).orderBy("table_name").collect()] + [r.line for r in keys.orderBy("line").collect()]
    return "\n".join([instructions, *rows])


def _named(row: dict, keys: dict[str, str]) -> dict:
    """Long field names for short ones, whatever their case; long ones pass."""
    low = {str(k).lower(): v for k, v in row.items()}
    return {long: low.get(short, low.get(long)) for short, long in keys.items()}


def expand(answer: dict | str) -> dict:
    """The long form of a compact answer: database fields, tables, columns, relations."""
    if isinstance(answer, str):
        answer = folds.repair_json(answer) or {}
    tables, columns = [], []
    for t in answer.get("tables") or []:
        row = _named(t, TABLE_KEYS)
        if row["table_name"]:
            tables.append(row)
            columns += [(row["table_name"], c.get("c") or c.get("column_name"), c.get("d") or c.get("description")) for c in t.get("cols") or []]
    rels = [_named(r, RELATION_KEYS) for r in answer.get("rels") or []]
    return {"db": _named(answer.get("db") or {}, DB_KEYS), "tables": tables, "columns": [c for c in columns if c[1]], "relations": [r for r in rels if r["source_table"] and r["target_table"]]}


#: Answers whose items a worker makes at a time.
PIECE = 200
PARSED = "key string, seq int, kind string, table_name string, column_name string, description string, entity_type string, target_table string, target_column string, relationship_type string"


def _items(answer: str | None) -> list[tuple]:
    """What an answer says, as rows without key and number: the database, tables, columns, relations; an error where it is no object of the form."""
    found = folds.repair_json(answer or "")
    if not isinstance(found, dict):
        return [("error", None, None, "an answer that is no JSON object", None, None, None, None)]
    try:
        long = expand(found)
    except (AttributeError, TypeError):
        return [("error", None, None, "an answer of another form", None, None, None, None)]
    rows = [("db", None, None, long["db"]["db_description"], long["db"]["business_domain"], None, None, None)] if any(long["db"].values()) else []
    rows += [("table", t["table_name"], None, t["description"], t["entity_type"], None, None, None) for t in long["tables"]]
    rows += [("column", t, c, d, None, None, None, None) for t, c, d in long["columns"]]
    rows += [("relation", r["source_table"], r["source_column"], r["description"], None, r["target_table"], r["target_column"], r["relationship_type"]) for r in long["relations"]]
    return [tuple(None if x is None else x if isinstance(x, str) else str(x) for x in row) for row in rows]


def parse_answers(answers: DataFrame) -> DataFrame:
    """Recorded answers (key, answer), one a database, as one row an item of each: kind is db, table, column, relation or error.

    Written once, in small batches: a worker holds the items of ``PIECE`` answers, whatever the batch.
    """
    names = [f.split()[0] for f in PARSED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), PIECE):
                piece = f.iloc[i : i + PIECE]
                yield pd.DataFrame([(key, n, *item) for key, answer in zip(piece.key, piece.answer) for n, item in enumerate(_items(answer))], columns=names)

    return _cut(answers.select(F.col("key").cast("string").alias("key"), F.col("answer").cast("string").alias("answer")).mapInPandas(run, PARSED))


def merge_answers(tables: DataFrame, columns: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (key, table_name, ...) and columns (key, table_name, column_name, ...) of many databases with what the answers say of them.

    Names are compared exactly. Of a name that an answer gives twice the last counts; what an answer does not name keeps its description.
    """
    def said(kind: str, by: list[str]) -> DataFrame:
        last = lambda c: F.max_by(c, "seq").alias(f"__{c}")
        return parsed.where(F.col("kind") == kind).groupBy(*by).agg(last("description"), last("entity_type"))

    def over(rows: DataFrame, new: str, old: str) -> DataFrame:
        kept = F.coalesce(new, old) if old in rows.columns else F.col(new)
        return rows.withColumn(old, kept).drop(new)

    t = over(tables.join(said("table", ["key", "table_name"]), ["key", "table_name"], "left"), "__description", "business_description")
    c = columns.join(said("column", ["key", "table_name", "column_name"]), ["key", "table_name", "column_name"], "left").drop("__entity_type")
    return over(t, "__entity_type", "entity_type"), over(c, "__description", "business_description")


def run(catalog: Catalog, model: Callable[[str], dict | str] | None) -> tuple[Catalog, dict]:
    """The annotated catalog and the fields of the database."""
    if model is None:
        return catalog, {}
    spark = catalog.tables.sparkSession
    found = expand(model(prompt(catalog)))
    tables = spark.createDataFrame([(t["table_name"], t["description"], t["entity_type"]) for t in found["tables"]], "table_name string, description string, entity_type string")
    columns = spark.createDataFrame(found["columns"], "table_name string, column_name string, description string")
    fields = [x.split()[0] for x in INFERRED.split(", ")]
    inferred = spark.createDataFrame([tuple(r[f] for f in fields) for r in found["relations"]], INFERRED)
    t, c = annotate(catalog, tables, columns)
    return Catalog(t, c, catalog.foreign, catalog.inferred.unionByName(inferred)), found["db"]
