"""The TPC-H-like tables as graphs: core (rows and foreign keys), trade (nations), transitions (event types)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dedup import last_per
from ..operators.paths import _cut
from .importing import Table, import_graph

DATASOURCE = "DBS://bench/tpch"

# Table, key, foreign keys, node type.
LAYOUT = [
    ("region", ["r_regionkey"], [], "location"),
    ("nation", ["n_nationkey"], [("n_regionkey", "region", "r_regionkey")], "location"),
    ("customer", ["c_custkey"], [("c_nationkey", "nation", "n_nationkey")], "person"),
    ("supplier", ["s_suppkey"], [("s_nationkey", "nation", "n_nationkey")], "organization"),
    ("part", ["p_partkey"], [], "concept"),
    ("orders", ["o_orderkey"], [("o_custkey", "customer", "c_custkey")], "event"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[Table]:
    return [Table(n, table(spark, sf_dir, n), keys, fks, kind) for n, keys, fks, kind in LAYOUT if not names or n in names]


def core(spark: SparkSession, sf_dir: str, mode: str = "all") -> tuple[DataFrame, DataFrame]:
    return import_graph(tables(spark, sf_dir), DATASOURCE, mode)


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (order, line): the largest by the other columns in order."""
    rows = table(spark, sf_dir, "lineitem")
    return last_per(rows, ["l_orderkey", "l_linenumber"], *[c for c in rows.columns if c not in ("l_orderkey", "l_linenumber")])


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations, and customer-nation -> supplier-nation edges whose strength is their share of all lines; no loops."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey", F.col("n_regionkey").alias("region"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    # Orders meet their customers before lines meet orders, so that lines are dealt out fewer times; the counts are written, as analyses read them again and again.
    homes = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    flows = lines.join(homes.select("o_orderkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    flows = flows.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = _cut(flows.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n")), rows=lines.count())
    total = counts.agg(F.sum("n").alias("total"))
    a = nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("name").alias("src"))
    b = nations.select(F.col("n_nationkey").alias("s_nationkey"), F.col("name").alias("dst"))
    edges = counts.join(a, "c_nationkey").join(b, "s_nationkey").join(F.broadcast(total)).where("src <> dst")  # one row of totals
    return nations.select("name", "region"), edges.select("src", "dst", (F.col("n") / F.col("total")).alias("strength"))


def strong_trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The trade graph with the three strongest edges out of each nation: sparse, so that paths have length."""
    nodes, edges = trade(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("strength"), "dst"))
    return nodes, edges.withColumn("r", rank).where("r <= 3").drop("r")


def supply(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph that grows with the tables: suppliers and parts, an edge in each direction with the lines of the pair as its strength; nodes with the nation or maker."""
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.lit("supplier").alias("type"), F.col("s_nationkey").cast("long").alias("group"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.lit("part").alias("type"), (F.col("p_partkey") % 25).cast("long").alias("group"))
    lines = table(spark, sf_dir, "lineitem")
    pairs = _cut(lines.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).cast("double").alias("strength")), rows=lines.count())
    s, p = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    ends = F.explode(F.array(F.struct(s.alias("src"), p.alias("dst")), F.struct(p.alias("src"), s.alias("dst")))).alias("e")
    return suppliers.unionByName(parts), pairs.select(ends, "strength").select("e.src", "e.dst", "strength")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): how often a user's event of one type is followed by one of another."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return steps.where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
