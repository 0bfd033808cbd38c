"""Paths on an edge table ``(src, dst, strength)``: frontier joins, one round a hop, with the frontier written between rounds."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that a shuffle deals to a partition, and bytes that a task reads, in tables that ``_cut`` writes.
ROWS, BYTES = 500_000, 8 << 20
#: Rows of an Arrow batch there.
BATCH_ROWS = 1000
#: What was dealt out for a written table is removed once that is written, not when Java next collects garbage.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def build(edges: DataFrame, directed: bool = True) -> DataFrame:
    """One edge for each ordered pair: the last by ``relationship_id`` wins; undirected pairs are put in order first."""
    e = edges if "relationship_id" in edges.columns else edges.withColumn("relationship_id", F.lit(""))
    if not directed:
        e = e.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    return e.groupBy("src", "dst").agg(F.max_by("strength", F.struct("relationship_id", "strength")).alias("strength"))


def _folder(spark: SparkSession) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names, or in the warehouse where a session names none; removed when the application ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/loomgraph-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    at, store = _place(spark, path)
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def _place(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _bytes(size: str) -> int:
    m = re.match(r"(\d+)\s*([kmgt]?)", size.lower())
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]]


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings with those *wanted*, for what runs inside."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def narrow(spark: SparkSession, rows: int = 0) -> Iterator[None]:
    """What runs inside has tasks of bounded input: partitions are put together up to ``BYTES`` only, and *rows* make as many more of them.

    With Spark's 64 MB a partition of short rows that compress well takes gigabytes to sort. Settings that are narrower already stay.
    """
    wanted = {}
    for key in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        if _bytes(spark.conf.get(key)) > BYTES:
            wanted[key] = f"{BYTES}b"
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < (parts := ceil(rows / ROWS)):
        wanted["spark.sql.shuffle.partitions"] = str(parts)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        wanted |= {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(4 * BYTES)}
    with settings(spark, wanted):
        yield


def _cut(df: DataFrame, old: DataFrame | None = None, rows: int = 0) -> DataFrame:
    """End the lineage of a loop by a written table; the files of *old*, which nothing reads any more once this is written, go. *rows* go into its largest shuffle.

    A table also ends the constraints that the optimizer keeps of a checkpoint, which grow with every round.
    """
    spark = df.sparkSession
    path = _folder(spark)
    with narrow(spark, rows), settings(spark, CLEAN):
        df.write.mode("append").parquet(path)
    if old is not None:
        drop(old)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove the files of tables that ``_cut`` wrote; other tables stay."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/loomgraph-" in path:
                at, store = _place(df.sparkSession, path)
                store.delete(at, True)


def _rounds(most: int | None):
    """Round numbers from 1; beyond *most* an error, as the frontier isn't empty then."""
    for n in count(1):
        if most is not None and n > most:
            raise RuntimeError(f"nodes left to visit after {most} rounds")
        yield n


def hops(edges: DataFrame, source: str, most: int | None = None) -> DataFrame:
    """(node, hops) for all nodes that *source* reaches; an error if *most* rounds don't reach them."""
    spark = edges.sparkSession
    step = edges.select("src", "dst").distinct()
    seen = front = spark.createDataFrame([(source, 0)], "node string, hops int")
    for n in _rounds(most):
        front = _cut(front.join(step, front.node == step.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(n).alias("hops")))
        if front.isEmpty():
            break
        seen = _cut(seen.unionByName(front), seen)
    return seen


def distances(edges: DataFrame, source: str, cost: str = "confidence", most: int | None = None) -> DataFrame:
    """(node, distance, path): least cost by repeated relaxation until nothing changes; an error if that takes more than
    *most* rounds, or if a cycle has a negative sum. A strong edge is long unless *cost* is ``inverse``."""
    weight = F.col("strength") if cost == "confidence" else 1 / F.col("strength")
    step = edges.select("src", "dst", weight.alias("w"))
    best = edges.sparkSession.createDataFrame([(source, 0.0, [source])], "node string, distance double, path array<string>")
    front = best
    for n in _rounds(most):
        tried = front.join(step, front.node == step.src).select(F.col("dst").alias("node"), (F.col("distance") + F.col("w")).alias("distance"), F.concat("path", F.array("dst")).alias("path"))
        merged = _cut(best.unionByName(tried).groupBy("node").agg(F.min(F.struct("distance", "path")).alias("b")).select("node", "b.distance", "b.path"))
        front = _cut(merged.join(best.select("node", F.col("distance").alias("__d")), "node", "left").where("__d IS NULL OR distance < __d - 1e-12").drop("__d"))
        best = merged
        if front.isEmpty():
            break
        if n % 20 == 0 and not front.where(F.size("path") > F.size(F.array_distinct("path"))).isEmpty():
            raise ValueError("a cycle of negative sum has no least distance")
    return best


def shortest_paths(edges: DataFrame, source: str, target: str, k: int = 1, most: int | None = None) -> DataFrame:
    """Up to *k* paths of the least number of edges, in order of their nodes: (path, length); an error if *most* edges don't decide it."""
    step = edges.select("src", "dst").distinct()
    spark = edges.sparkSession
    front = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    seen = front.select("node")
    for _ in _rounds(None if most is None else most + 1):
        hit = front.where(F.col("node") == target)
        if not hit.isEmpty():
            return hit.orderBy("path").limit(k).select("path", (F.size("path") - 1).alias("length"))
        nxt = front.join(step, front.node == step.src).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")).join(seen, "node", "left_anti")
        # No more than k paths a node can matter, in the order that the answer has.
        front = _cut(nxt.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("path")), 1, k).alias("p")).select("node", F.explode("p").alias("path")))
        if front.isEmpty():
            break
        seen = _cut(seen.unionByName(front.select("node").distinct()))
    return front.limit(0).select("path", F.lit(0).alias("length"))


def disjoint_paths(edges: DataFrame, source: str, target: str, k: int, cost: str = "confidence") -> list[tuple[list[str], float]]:
    """Up to *k* cheapest paths, each without the edges of those before it."""
    out: list[tuple[list[str], float]] = []
    left = edges
    for _ in range(k):
        found = distances(left, source, cost).where(F.col("node") == target).first()
        if found is None:
            break
        out.append((found.path, found.distance))
        used = edges.sparkSession.createDataFrame(list(zip(found.path, found.path[1:])), "src string, dst string")
        left = _cut(left.join(used, ["src", "dst"], "left_anti"))
    return out


def analyze(nodes: DataFrame, edges: DataFrame, source: str, target: str, k: int = 1, weighted: bool = False) -> dict:
    """Paths, their lengths and their number; a message tells unknown nodes from unconnected ones."""
    known = {r.name for r in nodes.where(F.col("name").isin(source, target)).select("name").collect()}
    missing = [n for n in (source, target) if n not in known]
    if missing:
        return {"paths": [], "path_lengths": [], "total_paths": 0, "message": f"unknown node: {', '.join(missing)}"}
    if weighted:
        found = [(p, len(p) - 1) for p, _ in disjoint_paths(edges, source, target, k)]
    else:
        found = [(r.path, r.length) for r in shortest_paths(edges, source, target, k).collect()]
    out = {"paths": [p for p, _ in found], "path_lengths": [n for _, n in found], "total_paths": len(found)}
    return out if found else out | {"message": f"no path from {source} to {target}"}
