"""Background jobs: a queue with a bounded number of threads, parameters and states kept in a table, cancelling by job group."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, type string, status string, created_at string, completed_at string, parameters string, result string"
# Kinds of jobs and threads.
TYPES = ("database_schema_analyze", "database_schema_import", "document_generate_summary")
THREADS = 5


def _now() -> str:
    return datetime.now(UTC).isoformat()


class Tasks:
    """Jobs by type; each runs in a Spark job group of its own id, so stopping one cancels its stages.

    The log is one JSON file a job on the driver; jobs that were pending or running when the driver ended are
    queued again with their parameters.
    """

    def __init__(self, spark: SparkSession, log: str, work: dict[str, Callable[[SparkSession, dict], object]]):
        self.spark, self.work = spark, work
        self.log = Path(log)
        self.log.mkdir(parents=True, exist_ok=True)
        self.pool = ThreadPoolExecutor(THREADS)
        self.lock = threading.Lock()
        self.jobs: dict[str, dict] = {}
        self.futures: dict[str, Future] = {}
        for f in sorted(self.log.glob("*.json")):
            job = json.loads(f.read_text())
            self.jobs[job["id"]] = job
            if job["status"] in ("pending", "running"):
                self._queue(job)

    def create(self, kind: str, parameters: dict) -> str:
        if kind not in self.work:
            raise ValueError(f"unknown kind of task: {kind}")
        job = {"id": uuid.uuid4().hex, "type": kind, "status": "pending", "created_at": _now(), "completed_at": None, "parameters": json.dumps(parameters), "result": None}
        self.jobs[job["id"]] = job
        self._queue(job)
        return job["id"]

    def _queue(self, job: dict) -> None:
        self._save(job, status="pending")
        self.futures[job["id"]] = self.pool.submit(self._run, job)

    def _save(self, job: dict, **changes) -> None:
        with self.lock:
            job.update(changes)
            at = self.log / f"{job['id']}.json"
            at.with_suffix(".tmp").write_text(json.dumps(job))
            at.with_suffix(".tmp").rename(at)

    def _run(self, job: dict) -> None:
        if job["status"] == "stopped":
            return
        self._save(job, status="running")
        self.spark.sparkContext.setJobGroup(job["id"], job["type"], True)
        try:
            result = self.work[job["type"]](self.spark, json.loads(job["parameters"]))
            done = {"status": "completed", "result": json.dumps(result, default=str)}
        except Exception as e:  # noqa: BLE001  a job may fail in any way
            done = {"status": "failed", "result": json.dumps(str(e)[:1000])}
        if job["status"] != "stopped":
            self._save(job, completed_at=_now(), **done)

    def stop(self, task: str) -> None:
        job = self.jobs[task]
        if job["status"] in ("pending", "running"):
            self._save(job, status="stopped", completed_at=_now())
            self.spark.sparkContext.cancelJobGroup(task)

    def delete(self, task: str) -> None:
        self.stop(task)
        del self.jobs[task]
        (self.log / f"{task}.json").unlink(missing_ok=True)

    def wait(self, task: str, seconds: float = 60) -> dict:
        self.futures[task].result(seconds)
        return self.jobs[task]

    def table(self, limit: int = 1000) -> DataFrame:
        """Newest first."""
        rows = sorted(self.jobs.values(), key=lambda j: j["created_at"], reverse=True)[:limit]
        return self.spark.createDataFrame([tuple(r[f.split()[0]] for f in SCHEMA.split(", ")) for r in rows], SCHEMA)

    def close(self) -> None:
        self.pool.shutdown(wait=True)


def soft_delete(control: DataFrame, ids: list[str], derived: DataFrame, key: str = "id") -> DataFrame:
    """Rows with derived data are flagged, others go."""
    used = derived.select(F.col(key)).distinct().withColumn("__used", F.lit(True))
    hit = F.col(key).isin(ids)
    rows = control.join(used, key, "left").where(~hit | F.col("__used").isNotNull())
    return rows.withColumn("is_deleted", hit | F.coalesce("is_deleted", F.lit(False))).drop("__used")


def restore(control: DataFrame, ids: list[str], key: str = "id") -> DataFrame:
    return control.withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)) & ~F.col(key).isin(ids))


def only_enabled(models: DataFrame, chosen: str) -> DataFrame:
    """Enabling one model disables the others."""
    return models.withColumn("enabled", F.col("id") == chosen)


def available_model(models: DataFrame) -> DataFrame:
    return models.where(F.col("enabled") & F.col("available")).orderBy("id").limit(1)
