"""Ad-hoc queries over the graph's views, with an implicit limit, patterns of one to three hops, and timing."""

from __future__ import annotations

import re
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.paths import _cut, drop

_STRING_OR_COMMENT = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", re.S)


def has_limit(sql: str) -> bool:
    """Whether the statement has a LIMIT outside of literals and comments."""
    return re.search(r"\blimit\b\s+\S+\s*;?\s*$", _STRING_OR_COMMENT.sub("''", sql), re.I) is not None


def run(spark: SparkSession, sql: str, nodes: DataFrame, edges: DataFrame, default_limit: int = 1000) -> DataFrame:
    """SQL over the views ``nodes`` and ``edges``; without a limit of its own it gets *default_limit*."""
    nodes.createOrReplaceTempView("nodes")
    edges.createOrReplaceTempView("edges")
    out = spark.sql(sql.rstrip().rstrip(";"))
    return out if has_limit(sql) else out.limit(default_limit)


def match(edges: DataFrame, hops: int = 1, predicate: str | None = None) -> DataFrame:
    """Paths of one to three directed hops: n0, p1, n1, ... over names in ``subject`` and ``object``."""
    if not 1 <= hops <= 3:
        raise ValueError("patterns have one to three hops")
    e = edges.where(F.col("predicate") == predicate) if predicate else edges
    out = None
    for i in range(1, hops + 1):
        step = e.select(F.col("subject").alias(f"n{i - 1}"), F.col("predicate").alias(f"p{i}"), F.col("object").alias(f"n{i}"))
        out = step if out is None else out.join(step, f"n{i - 1}")
    return out.select(*[c for i in range(hops + 1) for c in ([f"n{i}"] if i == 0 else [f"p{i}", f"n{i}"])])


def match_paths(edges: DataFrame, least: int = 1, most: int | None = None, predicate: str | None = None, start: DataFrame | None = None) -> DataFrame:
    """Directed paths of *least* to *most* hops, or of any length: n0, n1, hops, and ``path``, the relationship ids.

    No path uses an edge twice, so patterns without a bound end on cycles too. *start* (name) gives the first nodes. A round joins the paths that still
    grow with the edges; each round's paths are written once.
    """
    if least < 1 or (most is not None and most < least):
        raise ValueError("a path has one hop at least, and no fewer at most than at least")
    e = edges.where(F.col("predicate") == predicate) if predicate else edges
    step = _cut(e.select(F.col("subject").alias("__a"), F.col("object").alias("__b"), F.col("relationship_id").alias("__r")))
    first = step if start is None else step.join(start.select(F.col("name").alias("__a")).distinct(), "__a", "left_semi")
    front = _cut(first.select(F.col("__a").alias("n0"), F.col("__b").alias("n1"), F.lit(1).alias("hops"), F.array("__r").alias("path")))
    found = [front] if least == 1 else []
    hops = 1
    while (most is None or hops < most) and not front.isEmpty():
        hops += 1
        longer = front.join(step, F.col("n1") == F.col("__a")).where(~F.array_contains("path", F.col("__r")))
        new = _cut(longer.select("n0", F.col("__b").alias("n1"), F.lit(hops).alias("hops"), F.concat("path", F.array("__r")).alias("path")))
        if hops - 1 < least:
            drop(front)
        front = new
        if hops >= least:
            found.append(front)
    return reduce(DataFrame.unionByName, found or [front.limit(0)])


def profile(df: DataFrame) -> dict:
    """Seconds, rows and the plan of a query."""
    began = time.time()
    rows = df.count()
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return {"seconds": time.time() - began, "rows": rows, "plan": plan}
