"""Series over time: real buckets on a full calendar, with running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Range name, unit, number of units.
RANGES = {"7d": ("day", 7), "30d": ("day", 30), "3m": ("month", 3), "12m": ("month", 12)}
LABELS = {"day": "MM-dd", "month": "yyyy-MM"}


def series(df: DataFrame, ts: str, unit: str = "day") -> DataFrame:
    """(bucket, n, running): counts in every bucket from the first to the last, also where nothing happened."""
    counted = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    calendar = counted.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi", F.expr(f"interval 1 {unit}"))).alias("bucket"))
    w = Window.partitionBy(F.lit(1)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a bucket
    return calendar.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n")).withColumn("running", F.sum("n").over(w))


def trend(df: DataFrame, ts: str, span: str = "30d") -> DataFrame:
    """The last buckets of a named range up to the newest event: (label, n, running)."""
    unit, n = RANGES.get(span, ("month", 5))
    last = series(df, ts, unit).orderBy(F.desc("bucket")).limit(n)
    return last.select(F.date_format("bucket", LABELS[unit]).alias("label"), "bucket", "n", "running").orderBy("bucket")


def tumbling(events: DataFrame, ts: str, width: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
