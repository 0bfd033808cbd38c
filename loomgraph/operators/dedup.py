"""Deduplication, last-wins maps, ranks and budgets: the ordered computations of the engine, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row a key: the first in *order*. Aggregates on the map side, so hot keys cost nothing."""
    columns = df.columns
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__row"))
    return best.select(*[F.col(f"__row.`{c}`").alias(c) for c in columns])


def last_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row a key: the last in *order*."""
    columns = df.columns
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__row"))
    return best.select(*[F.col(f"__row.`{c}`").alias(c) for c in columns])


def dedup_entities(df: DataFrame, name: str = "n", kind: str = "t", order: str = "seq") -> DataFrame:
    return first_per(df, [name, kind], order)


def dedup_triples(df: DataFrame, order: str = "seq") -> DataFrame:
    return first_per(df, ["s", "p", "o"], order)


def dedup_relations(df: DataFrame, order: str = "seq") -> DataFrame:
    """First row of each relationship id; rows without an id all stay."""
    named = df.where(F.coalesce("relationship_id", F.lit("")) != "")
    rest = df.where(F.coalesce("relationship_id", F.lit("")) == "")
    return first_per(named, ["relationship_id"], order).unionByName(rest)


def content_hash(*columns: str) -> Column:
    """md5 of the JSON of *columns* in name order."""
    return F.md5(F.to_json(F.struct(*sorted(columns))).cast("binary"))


def top_per(df: DataFrame, group: list[str], n: int, *order: Column) -> DataFrame:
    """At most *n* rows a group in *order*; Spark keeps only n a task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def last_turns(turns: DataFrame, n: int = 5, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    return top_per(turns, [session], n, F.desc(turn))


def budget_prefix(df: DataFrame, group: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The longest prefix of each group, in *order*, whose sizes fit *budget*; the first overflow ends it."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)


def mode_offset(df: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """The most frequent b - a; ties go to the one seen first."""
    counted = df.groupBy((F.col(b) - F.col(a)).alias("offset")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return counted.orderBy(F.desc("n"), "seen").limit(1).select("offset")


def dedup_links(links: DataFrame, order: str) -> DataFrame:
    """First link of each (src, dst, type)."""
    return first_per(links, ["src", "dst", "type"], order)


def sample_rows(df: DataFrame, n: int, *key: str, seed: int = 42) -> DataFrame:
    """*n* rows drawn by a seeded hash of *key*: the same ones in every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)
