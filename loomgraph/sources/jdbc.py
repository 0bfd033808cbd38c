"""Relational tables over JDBC: partitioned scans, pages by offset, pages by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import keyset_page


def scan(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, split: str | None = None, parts: int = 16, max_rows: int = 0, **options: str) -> DataFrame:
    """A whole table; with a numeric *split* column in *parts* ranges that are read at once. Columns and filters are pushed to the source."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", "5000").options(**options)
    if split:
        bounds = spark.read.format("jdbc").option("url", url).options(**options).option("query", f"SELECT MIN({split}) AS lo, MAX({split}) AS hi FROM {table}").load().first()
        if bounds[0] is not None:
            reader = reader.option("partitionColumn", split).option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1])).option("numPartitions", str(parts))
    df = reader.load()
    df = df.select(*columns) if columns else df
    return df.limit(max_rows) if max_rows else df


def pages_by_offset(df: DataFrame, order: list[str], size: int = 5000, max_rows: int = 0):
    """Successive pages in a fixed order; 0 rows means no cap."""
    at = 0
    while not max_rows or at < max_rows:
        page = df.orderBy(*order).offset(at).limit(min(size, max_rows - at) if max_rows else size).collect()
        if not page:
            return
        yield page
        at += len(page)


def pages_by_key(df: DataFrame, keys: list[str], size: int = 5000, max_rows: int = 0):
    """Successive pages by key, each a filter on the last key seen, which the source can answer from its index."""
    last, done = None, 0
    while not max_rows or done < max_rows:
        page = keyset_page(df, keys, last, min(size, max_rows - done) if max_rows else size).collect()
        if not page:
            return
        yield page
        last, done = tuple(page[-1][k] for k in keys), done + len(page)


def any_row(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
