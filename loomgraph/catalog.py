"""Relational metadata: what a database says of its tables, columns and keys, as DataFrames.

A catalog is four frames: tables, columns, foreign keys, inferred relationships. They come from a JDBC
source by the dialect's own metadata queries, or from DataFrames at hand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.paths import _cut

TABLES = "table_name string, table_rows long, business_description string, entity_type string"
COLUMNS = "table_name string, column_name string, ordinal int, data_type string, is_nullable string, column_key string"
FOREIGN = "table_name string, column_name string, referenced_table string, referenced_column string, constraint_name string"
INFERRED = "source_table string, source_column string, target_table string, target_column string, relationship_type string, description string"

# Key markers, and schemas that belong to the database itself.
KEY_MARKS = ("PRI", "PRIMARY KEY", "PK")
SYSTEM = {
    "mysql": ("information_schema", "mysql", "performance_schema", "sys"),
    "postgresql": ("postgres", "template0", "template1"),
    "mssql": ("master", "model", "msdb", "tempdb"),
    "oracle": ("SYS", "SYSTEM"),
    "sqlite": (),
}


@dataclass
class Catalog:
    tables: DataFrame
    columns: DataFrame
    foreign: DataFrame
    inferred: DataFrame


def metadata_queries(dialect: str, database: str) -> dict[str, str]:
    """SQL for tables, columns and foreign keys, with result columns named as the frames are."""
    name = database.replace("'", "''")
    if dialect in ("mysql", "mssql", "postgresql"):
        where = {"mysql": f"= '{name}'", "postgresql": "= 'public'", "mssql": "= 'dbo'"}[dialect]
        key = "c.column_key" if dialect == "mysql" else (
            "CASE WHEN EXISTS (SELECT 1 FROM information_schema.key_column_usage u JOIN information_schema.table_constraints k "
            "ON k.constraint_name = u.constraint_name AND k.table_schema = u.table_schema WHERE k.constraint_type = 'PRIMARY KEY' "
            "AND u.table_name = c.table_name AND u.column_name = c.column_name AND u.table_schema = c.table_schema) THEN 'PRI' ELSE '' END"
        )
        if dialect == "mysql":
            fks = f"SELECT table_name, column_name, referenced_table_name AS referenced_table, referenced_column_name AS referenced_column, constraint_name FROM information_schema.key_column_usage WHERE table_schema {where} AND referenced_table_name IS NOT NULL"
        elif dialect == "postgresql":  # names of constraints repeat within a schema, so keys are told apart by their tables
            fks = (
                "SELECT t.relname AS table_name, x.attname AS column_name, r.relname AS referenced_table, y.attname AS referenced_column, c.conname AS constraint_name "
                "FROM pg_constraint c JOIN pg_class t ON t.oid = c.conrelid JOIN pg_namespace s ON s.oid = t.relnamespace JOIN pg_class r ON r.oid = c.confrelid "
                "CROSS JOIN LATERAL unnest(c.conkey, c.confkey) AS k(own, other) JOIN pg_attribute x ON x.attrelid = c.conrelid AND x.attnum = k.own "
                f"JOIN pg_attribute y ON y.attrelid = c.confrelid AND y.attnum = k.other WHERE c.contype = 'f' AND s.nspname {where}"
            )
        else:  # names are unique in a schema
            fks = (
                "SELECT a.table_name, a.column_name, b.table_name AS referenced_table, b.column_name AS referenced_column, r.constraint_name "
                "FROM information_schema.referential_constraints r JOIN information_schema.key_column_usage a ON a.constraint_schema = r.constraint_schema AND a.constraint_name = r.constraint_name "
                "JOIN information_schema.key_column_usage b ON b.constraint_schema = r.unique_constraint_schema AND b.constraint_name = r.unique_constraint_name AND b.ordinal_position = a.ordinal_position "
                f"WHERE a.table_schema {where}"
            )
        return {
            "tables": f"SELECT table_name FROM information_schema.tables WHERE table_schema {where} AND table_type = 'BASE TABLE'",
            "columns": f"SELECT c.table_name, c.column_name, c.ordinal_position AS ordinal, c.data_type, c.is_nullable, {key} AS column_key FROM information_schema.columns c WHERE c.table_schema {where}",
            "foreign": fks,
        }
    if dialect == "sqlite":
        names = "SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'"
        return {
            "tables": f"SELECT name AS table_name FROM ({names})",
            "columns": f"SELECT m.name AS table_name, p.name AS column_name, p.cid + 1 AS ordinal, p.type AS data_type, CASE p.\"notnull\" WHEN 1 THEN 'NO' ELSE 'YES' END AS is_nullable, CASE WHEN p.pk > 0 THEN 'PRI' ELSE '' END AS column_key FROM ({names}) m, pragma_table_info(m.name) p",
            "foreign": f"SELECT m.name AS table_name, p.\"from\" AS column_name, p.\"table\" AS referenced_table, p.\"to\" AS referenced_column, m.name || '_fk_' || p.id AS constraint_name FROM ({names}) m, pragma_foreign_key_list(m.name) p",
        }
    if dialect == "oracle":
        keys = "SELECT u.table_name, u.column_name FROM all_constraints k JOIN all_cons_columns u ON u.owner = k.owner AND u.constraint_name = k.constraint_name WHERE k.constraint_type = 'P'"
        return {
            "tables": f"SELECT table_name, num_rows AS table_rows FROM all_tables WHERE owner = '{name}'",
            "columns": f"SELECT c.table_name, c.column_name, c.column_id AS ordinal, c.data_type, c.nullable AS is_nullable, CASE WHEN p.column_name IS NULL THEN '' ELSE 'PRI' END AS column_key FROM all_tab_columns c LEFT JOIN ({keys}) p ON p.table_name = c.table_name AND p.column_name = c.column_name WHERE c.owner = '{name}'",
            "foreign": f"SELECT a.table_name, a.column_name, b.table_name AS referenced_table, b.column_name AS referenced_column, k.constraint_name FROM all_constraints k JOIN all_cons_columns a ON a.owner = k.owner AND a.constraint_name = k.constraint_name JOIN all_cons_columns b ON b.owner = k.r_owner AND b.constraint_name = k.r_constraint_name AND b.position = a.position WHERE k.constraint_type = 'R' AND k.owner = '{name}'",
        }
    raise ValueError(f"unknown dialect: {dialect}")


def log_position_query(dialect: str) -> str | None:
    """The query that tells where the change log stands; None where there is no log to follow."""
    return {"mysql": "SHOW MASTER STATUS", "postgresql": "SELECT pg_current_wal_lsn()"}.get(dialect)


def _shaped(df: DataFrame, ddl: str) -> DataFrame:
    have = {c.lower(): c for c in df.columns}
    fields = [x.split() for x in ddl.split(", ")]
    return df.select(*[(F.col(f"`{have[n]}`") if n in have else F.lit(None)).cast(k).alias(n) for n, k in fields])


def read_jdbc(spark: SparkSession, dialect: str, url: str, database: str, **options: str) -> Catalog:
    """Field names of the source may have any case."""
    found = {k: spark.read.format("jdbc").option("url", url).options(**options).option("query", q).load() for k, q in metadata_queries(dialect, database).items()}
    return Catalog(_shaped(found["tables"], TABLES), _shaped(found["columns"], COLUMNS), _shaped(found["foreign"], FOREIGN), spark.createDataFrame([], INFERRED))


def read_sqlite(spark: SparkSession, path: str) -> Catalog:
    """The catalog of a SQLite file by its own metadata queries."""
    from .sources import sqlite

    found = {k: sqlite.run(spark, path, q) for k, q in metadata_queries("sqlite", "").items()}
    return Catalog(_shaped(found["tables"], TABLES), _shaped(found["columns"], COLUMNS), _shaped(found["foreign"], FOREIGN), spark.createDataFrame([], INFERRED))


def from_frames(spark: SparkSession, frames: dict[str, DataFrame], keys: dict[str, list[str]] | None = None, foreign: list[tuple[str, str, str, str]] = ()) -> Catalog:
    """The catalog of DataFrames; *foreign* has (table, column, referenced table, referenced column)."""
    keys = keys or {}
    columns = [(t, f.name, i, f.dataType.simpleString(), "YES" if f.nullable else "NO", "PRI" if f.name in keys.get(t, []) else "") for t, df in frames.items() for i, f in enumerate(df.schema, 1)]
    fks = [(*f, f"{f[0]}_{f[1]}") for f in foreign if all(f)]
    return Catalog(spark.createDataFrame([(t, None, None, None) for t in frames], TABLES), spark.createDataFrame(columns, COLUMNS), spark.createDataFrame(fks, FOREIGN), spark.createDataFrame([], INFERRED))


def select_tables(catalog: Catalog, include: list[str] | None = None, ignore: list[str] | None = None) -> Catalog:
    """Named tables only. A foreign key stays if either end is included, and goes if either end is ignored."""
    t, c, f = catalog.tables, catalog.columns, catalog.foreign
    if include:
        t, c = t.where(F.col("table_name").isin(include)), c.where(F.col("table_name").isin(include))
        f = f.where(F.col("table_name").isin(include) | F.col("referenced_table").isin(include))
    if ignore:
        t, c = t.where(~F.col("table_name").isin(ignore)), c.where(~F.col("table_name").isin(ignore))
        f = f.where(~F.col("table_name").isin(ignore) & ~F.col("referenced_table").isin(ignore))
    return Catalog(t, c, f, catalog.inferred)


def primary_keys(columns: DataFrame) -> DataFrame:
    """(table_name, keys): the marked columns in order, else the first column."""
    marked = F.upper(F.coalesce("column_key", F.lit(""))).isin(*KEY_MARKS)
    listed = F.sort_array(F.collect_list(F.struct("ordinal", "column_name", marked.alias("marked"))))
    by = columns.groupBy("table_name").agg(listed.alias("all"))
    keys = F.filter("all", lambda x: x.marked)
    chosen = F.when(F.size(keys) > 0, keys).otherwise(F.slice("all", 1, 1))
    return by.select("table_name", F.transform(chosen, lambda x: x.column_name).alias("keys"))


def refine_keys(keys: DataFrame, inspected: DataFrame) -> DataFrame:
    """Where one key column was found, what an inspection of the source says instead, if it says anything."""
    seen = inspected.select("table_name", F.col("keys").alias("__seen"))
    better = (F.size("keys") == 1) & (F.size(F.coalesce("__seen", F.array())) > 0)
    return keys.join(seen, "table_name", "left").select("table_name", F.when(better, F.col("__seen")).otherwise(F.col("keys")).alias("keys"))


def user_databases(names: DataFrame, dialect: str) -> DataFrame:
    system = SYSTEM.get(dialect, ())
    return names.where(~F.col("name").isin(*system)) if system else names


def merge_status(live: DataFrame, analyzed: DataFrame) -> DataFrame:
    """(name, status): extracted if live and analyzed, deleted if analyzed only, null if live only."""
    both = live.select("name", F.lit(True).alias("live")).join(analyzed.select("name", F.lit(True).alias("done")), "name", "full_outer")
    return both.select("name", F.when(F.col("live") & F.col("done"), "extracted").when(F.col("done"), "deleted").alias("status"))


def with_schema_flag(connections: DataFrame, tables: DataFrame) -> DataFrame:
    owners = tables.select(F.col("connection_id").alias("id")).distinct().withColumn("__has", F.lit(True))
    return connections.join(owners, "id", "left").withColumn("has_schema", F.coalesce("__has", F.lit(False))).drop("__has")


def annotate(catalog: Catalog, tables: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put descriptions over tables (table_name, description, entity_type) and columns (table_name, column_name, description)."""
    t = catalog.tables.join(tables.select("table_name", F.col("description").alias("__d"), F.col("entity_type").alias("__e")), "table_name", "left")
    t = t.withColumns({"business_description": F.coalesce("__d", "business_description"), "entity_type": F.coalesce("__e", "entity_type")}).drop("__d", "__e")
    return t, catalog.columns.join(columns.select("table_name", "column_name", F.col("description").alias("business_description")), ["table_name", "column_name"], "left")


def cards(catalog: Catalog) -> DataFrame:
    """Per table: columns, foreign keys out and in, inferred relationships."""
    def count(df: DataFrame, key: str, to: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("table_name")).agg(F.count(F.lit(1)).alias(to))

    out = catalog.tables.select("table_name")
    sides = [(catalog.columns, "table_name", "n_columns"), (catalog.foreign, "table_name", "fk_out"), (catalog.foreign, "referenced_table", "fk_in"), (catalog.inferred, "source_table", "n_inferred")]
    for df, key, to in sides:
        out = out.join(count(df, key, to), "table_name", "left")
    return out.na.fill(0)


def levels(tables: DataFrame, foreign: DataFrame, most: int = 50) -> DataFrame:
    """(table_name, level): longest foreign-key path from tables that refer to none; cycles stop at *most*."""
    links = foreign.select("table_name", "referenced_table").where("table_name <> referenced_table").distinct()
    links = _cut(links)
    now = tables.select("table_name", F.lit(0).alias("level"))
    for _ in range(most):
        up = links.join(now.select(F.col("table_name").alias("referenced_table"), F.col("level").alias("__l")), "referenced_table").groupBy("table_name").agg((F.max("__l") + 1).alias("__up"))
        after = now.join(up, "table_name", "left").select("table_name", F.greatest("level", F.coalesce("__up", F.lit(0))).alias("level"))
        after = _cut(after)
        if after.join(now, ["table_name", "level"], "left_anti").isEmpty():
            return now
        now = after
    return now


def lanes(pairs: DataFrame) -> DataFrame:
    """A running number for each link of the same pair of tables."""
    return pairs.withColumn("lane", F.row_number().over(Window.partitionBy("table_name", "referenced_table").orderBy("column_name")) - 1)


def summary(catalog: Catalog, name: str, description: str = "", domain: str = "") -> DataFrame:
    """One row with the nested JSON document of a database: its tables in order with their columns."""
    cols = catalog.columns.groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct("ordinal", "column_name", "data_type", "column_key"))).alias("keys"))
    listed = catalog.tables.join(cols, "table_name", "left").withColumn("n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("table_name")))
    node = F.struct("table_name", F.lpad(F.col("n").cast("string"), 8, "0").alias("node_id"), F.col("business_description").alias("summary"), "entity_type", "keys")
    doc = listed.agg(F.sort_array(F.collect_list(node)).alias("structure"), F.count(F.lit(1)).alias("table_count"))
    return doc.select(F.to_json(F.struct(F.lit(name).alias("db_name"), F.lit(description).alias("db_description"), F.lit(domain).alias("business_domain"), "table_count", "structure")).alias("document"))


def save(catalog: Catalog, path: str) -> None:
    """All four frames under *path*; keys without all their parts are left out."""
    whole = catalog.foreign.where("column_name IS NOT NULL AND referenced_table IS NOT NULL AND referenced_column IS NOT NULL")
    frames = {"tables": catalog.tables, "columns": catalog.columns, "foreign": whole, "inferred": catalog.inferred}
    for name, df in frames.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Catalog:
    return Catalog(*[spark.read.parquet(f"{path}/{name}") for name in ("tables", "columns", "foreign", "inferred")])
