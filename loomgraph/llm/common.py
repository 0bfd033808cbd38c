"""What the operators of this subpackage share: input tables, staged tables, column hygiene."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\x09-\\x0D]+"


#: Rows and bytes of an Arrow batch between Spark and Python, whichever is reached first; a text longer than that is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session; the default of 10 000 rows lets a batch of long texts fill a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the session names none (tests, local runs), a folder in its warehouse is set, which they share as well.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/loomgraph-{spark.sparkContext.applicationId}"
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the application ends, whether what is written to it succeeds or not."""
    path = f"{work_dir(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
    store, folder = _at(spark, path)
    store.mkdirs(folder)
    store.deleteOnExit(folder)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write *df* to the shared folder and read it again: lineage ends there, so that a lost
    executor costs one table scan and not the whole history. The files go with ``drop_staged``, else when the application ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str) -> tuple:
    """A folder's store and its path there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def drop_staged(*tables: DataFrame) -> None:
    """Remove the files of staged tables that no plan reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/loomgraph-" in path:
                store, folder = _at(df.sparkSession, path)
                store.delete(folder, True)


def unused(df: DataFrame, name: str) -> str:
    """*name*, with underscores before it until no column of *df* is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bounded_sample(df: DataFrame, bound: int, seed: int = 7, key: str | None = None) -> DataFrame:
    """About *bound* rows, each drawn by itself; every row if there are no more than that.

    With *key*, whose values must not repeat, the draw is a hash of it and so the same in whatever order rows come.
    Serves only to fit classifiers and trees, which may see a bounded number of rows.
    """
    n = df.count()
    if n <= bound:
        return df
    if key is None:
        return df.where(F.rand(seed) < bound / n)
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int(bound / n * (1 << 30)))


def held_out(doc_id) -> "F.Column":
    """Whether crc32 of the id's decimal text is divisible by 5; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def by_place(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, "F.Column"]]:
    """*df* with columns named by their place, and the column of each of *names* there.

    Of names that differ in case only, the one spelled so is meant; without one, the first that differs in case.
    """
    found = {}
    for name in names:
        same = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not same:
            raise ValueError(f"no column {name} in {df.columns}")
        found[name] = F.col(f"_{same[0]}")
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]), found


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever the names of the others."""
    placed, found = by_place(df, *names)
    return placed.select(*[c.alias(name) for name, c in found.items()])


def with_own_names(docs: DataFrame, keep, *needed: str) -> DataFrame:
    """The rows that *keep* leaves of *docs*, where only the *needed* columns have their names meanwhile; so the others may be called anything, also differ from those in case only."""
    names = [c if c in needed else f"__{i}" for i, c in enumerate(docs.columns)]
    return keep(docs.toDF(*names)).toDF(*docs.columns)
