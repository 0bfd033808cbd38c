"""SQLite files as a PySpark data source: ranges of row ids as partitions, filters and columns pushed into the file's own SQL.

Options: ``path`` (a file that all executors see), ``table`` or ``query``; ``rows`` ids a partition. A table without row ids and a query are read in one task.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

#: Row ids a partition.
ROWS = 100_000
_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def type_of(declared: str):
    """The file's own rule of affinity, with numbers of undeclared kind as doubles."""
    kind = declared.upper()
    if "INT" in kind:
        return LongType()
    if any(x in kind for x in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return StringType()
    if "BLOB" in kind:
        return BinaryType()
    return DoubleType() if any(x in kind for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else StringType()


def _as(value, kind):
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else value.decode() if isinstance(value, bytes) else str(value)
    if isinstance(kind, BinaryType):
        return value if isinstance(value, bytes) else str(value).encode()
    return float(value) if isinstance(kind, DoubleType) else int(value)


def _plain(value) -> bool:
    return isinstance(value, (int, float, str)) and not isinstance(value, bool)


class _Rows(InputPartition):
    def __init__(self, first: int | None, last: int | None):
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.where: list[str] = []
        self.values: list = []

    def _push(self, sql: str, column: str, kind, values: list) -> None:
        """A column may hold other kinds of values than it declares; those rows are read as well and left to Spark, which sees them converted."""
        own = "'text'" if isinstance(kind, StringType) else "'integer', 'real'"
        self.where.append(f"({sql} OR typeof({quoted(column)}) NOT IN ({own}, 'null'))")
        self.values += values

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        if "query" in self.options:
            return filters
        kinds = {f.name: f.dataType for f in self.schema.fields}
        rest = []
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if column not in kinds:
                rest.append(f)
            elif isinstance(f, (IsNull, IsNotNull)):
                self.where.append(f"{quoted(column)} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
            elif type(f) in _COMPARE and _plain(value):
                self._push(f"{quoted(column)} COLLATE BINARY {_COMPARE[type(f)]} ?", column, kinds[column], [value])
                rest.append(f)
            elif isinstance(f, In) and f.value and all(map(_plain, f.value)):
                self._push(f"{quoted(column)} COLLATE BINARY IN ({', '.join('?' * len(f.value))})", column, kinds[column], list(f.value))
                rest.append(f)
            else:
                rest.append(f)
        return rest

    def partitions(self) -> list[_Rows]:
        if "query" in self.options:
            return [_Rows(None, None)]
        with connect(self.options["path"]) as db:
            try:
                lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.options['table'])}").fetchone()
            except sqlite3.OperationalError:  # a table without row ids
                return [_Rows(None, None)]
        if lo is None:
            return []
        step = int(self.options.get("rows", ROWS))
        return [_Rows(a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        kinds = [f.dataType for f in self.schema.fields]
        if "query" in self.options:
            sql, values = self.options["query"], []
        else:
            where, values = list(self.where), list(self.values)
            if partition.first is not None:
                where.append("rowid BETWEEN ? AND ?")
                values += [partition.first, partition.last]
            columns = ", ".join(quoted(f.name) for f in self.schema.fields) or "1"
            sql = f"SELECT {columns} FROM {quoted(self.options['table'])}" + (f" WHERE {' AND '.join(where)}" if where else "")
        with connect(self.options["path"]) as db:
            for row in db.execute(sql, values):
                yield tuple(_as(v, k) for v, k in zip(row, kinds))


class Sqlite(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> StructType:
        with connect(self.options["path"]) as db:
            if "query" in self.options:
                names = [c[0] for c in db.execute(f"SELECT * FROM ({self.options['query']}) LIMIT 0").description]
                return StructType([StructField(n, StringType()) for n in names])
            found = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return StructType([StructField(name, type_of(kind)) for _, name, kind, *_ in found])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Sqlite)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def scan(spark: SparkSession, path: str, table: str, rows: int = ROWS):
    """A whole table in partitions of *rows* row ids."""
    register(spark)
    return spark.read.format("sqlite_file").option("path", path).option("table", table).option("rows", str(rows)).load()


def run(spark: SparkSession, path: str, query: str):
    """A query that the file answers in one task, for its metadata and other small results; all columns are strings."""
    register(spark)
    return spark.read.format("sqlite_file").option("path", path).option("query", query).load()
