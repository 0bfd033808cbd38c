"""Document quality by co-training two classifiers on separate views.

The content view sees measures of the text itself; the metadata view sees what a catalogue says of it (source and language)
and nothing of the text, its length included. Both are logistic regressions that start from the labelled rows. In each round each view labels
the pool documents, none of them labelled, that it is sure of, a bounded number a class, and hands those to the other view, which is fitted anew. At the
end each view is calibrated on labelled rows that it was not fitted on, and their calibrated log-odds are combined by weights
fitted on the same rows. All documents are then scored with the combination.

Labelled rows and pool are bounded samples (``LABELLED``, ``POOL``); the features of both, some tens of numbers a row, are what the
driver fits on. Defined results: a null or empty text has all measures 0; missing metadata is a value of its own; a null ``doc_id`` and repeated rows are
scored row by row; without both classes among the labels every score is 1 and everything is kept; an empty table gives no rows; columns
other than ``doc_id``, ``text``, ``lang``, ``source`` are ignored by the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, drop_staged, stage, with_own_names
from .toxicity import logistic

LABELLED, POOL = 12_000, 12_000
ROUNDS, SURE, PER_ROUND = 4, 0.97, 300
CONTENT, METADATA = 16, 50
#: Words by which shares of repeated words are drawn to 0, so that a few words say little.
FEW = 10
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-")
#: Places for sources and languages in the metadata view, by a hash: with more values than that some share a weight.
_SOURCES, _LANGS = 32, 16


def content(text: str | None) -> list[float]:
    """Measures of a whole text, each in or near 0..1."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * CONTENT
    codes = np.fromiter(map(hash, words), np.int64, n)
    distinct = len(np.unique(codes))
    pair = codes[:-1] * 3 + codes[1:]
    triple = pair[:-1] * 5 + codes[2:]
    _, counts = np.unique(codes, return_counts=True)
    size = len(raw)
    letters = sum(map(len, words))
    upper = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = size - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        1.0,
        min(1.0, np.log1p(n) / 10),
        (n - distinct) / (n + FEW),
        (len(pair) - len(np.unique(pair))) / (n + FEW),
        (len(triple) - len(np.unique(triple))) / (n + FEW),
        float((codes[1:] == codes[:-1]).sum()) / (n + FEW),
        float(counts.max() - 1) / (n + FEW),
        min(2.0, letters / n / 10),
        (size - len(raw.translate(None, _SYMBOLS))) / letters,
        (size - len(raw.translate(None, b"!?"))) / letters,
        (size - len(raw.translate(None, b"0123456789"))) / letters,
        (size - len(raw.translate(None, b".,;:"))) / n,
        upper / max(1, upper + lower),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, len(lines) / n),
        sum(len(w) <= 3 for w in words) / n,
    ]


def metadata(source: str | None, lang: str | None) -> list[float]:
    out = [0.0] * METADATA
    out[crc32(source.encode()) % _SOURCES if source else -2] = 1.0
    out[_SOURCES + crc32(lang.lower().encode()) % _LANGS if lang else -1] = 1.0
    return out


_COLUMNS = ["text", "source", "lang"]


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text, source, lang = (batch.column(k) for k in range(3))
    x = np.array([content(t.as_py()) for t in text], float).reshape(-1, CONTENT)
    y = np.array([metadata(*m) for m in zip(source.to_pylist(), lang.to_pylist())], float).reshape(-1, METADATA)
    return x, y


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, m = _features(batch)
        yield pa.RecordBatch.from_arrays([pa.array(list(np.hstack([x, m]).astype(np.float32)), pa.list_(pa.float32())), *batch.columns[3:]], names=["f", "y", "part"])


def _inputs(docs: DataFrame) -> DataFrame:
    """The columns that the features need; a missing one is null."""
    have = set(docs.columns)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in _COLUMNS])


class View:
    """One classifier and its calibration, both logistic."""

    def __init__(self, x: np.ndarray):
        self.x, self.w, self.curve = x, np.zeros(x.shape[1] + 1), np.array([1.0, 0.0])

    def fit(self, rows: np.ndarray, y: np.ndarray) -> None:
        self.w = logistic(self.x[rows], y, penalty=0.1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.w[:-1] + self.w[-1], -30, 30)

    def calibrate(self, rows: np.ndarray, y: np.ndarray) -> None:
        self.curve = logistic(self.logit(self.x[rows])[:, None], y, penalty=0.1)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds."""
        return np.clip(self.logit(x) * self.curve[0] + self.curve[1], -12, 12)


def cotrain(x: np.ndarray, m: np.ndarray, y: np.ndarray, part: np.ndarray, rounds: int = ROUNDS) -> tuple[View, View, np.ndarray]:
    """Fit both views. *part*: 0 labelled to fit on, 1 labelled to calibrate on, 2 pool without labels."""
    views = [View(x), View(m)]
    fit, cal, pool = (np.flatnonzero(part == k) for k in range(3))
    own = [(fit, y[fit].astype(float)) for _ in views]
    taken = [set(), set()]
    for r in range(rounds + 1):
        for v, (rows, labels) in zip(views, own):
            v.fit(rows, labels)
            v.calibrate(cal, y[cal])
        if r == rounds:
            break
        for k, v in enumerate(views):
            p = 1 / (1 + np.exp(-v.odds(v.x[pool])))
            other = 1 - k
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                order = np.argsort(-sure, kind="stable")
                pick = [i for i in order[: PER_ROUND * (r + 1)] if sure[i] >= SURE and i not in taken[other]][:PER_ROUND]
                taken[other].update(pick)
                own[other] = (np.concatenate([own[other][0], pool[pick]]), np.concatenate([own[other][1], np.full(len(pick), label)]))
    odds = np.stack([v.odds(v.x[cal]) for v in views], 1)
    weights = logistic(odds, y[cal], penalty=0.1)
    weights[:2] = np.maximum(weights[:2], 0)
    return views[0], views[1], weights


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, pool: int = POOL) -> list[np.ndarray] | None:
    """Weights and curves of both views and the weights that combine them."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    marked, known = known.select("doc_id"), bounded_sample(known, labelled, key="doc_id")
    rows = _inputs(docs)
    chosen = F.broadcast(known)  # about `labelled` pairs of numbers
    part = F.when(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)) == 0, 1).otherwise(0)
    with_label = bounded_sample(rows.join(chosen, "doc_id"), labelled)  # an id may have many rows
    with_label = with_label.select(*_COLUMNS, "y", part.cast("int").alias("part"))
    free = bounded_sample(rows, pool, seed=13).join(marked, "doc_id", "left_anti").select(*_COLUMNS, F.lit(-1).alias("y"), F.lit(2).alias("part"))
    staged = stage(with_label.unionByName(free).mapInArrow(_feature_batches, "f array<float>, y int, part int"), "features")
    table = staged.toPandas()
    drop_staged(staged)
    y, part = table.y.to_numpy(), table.part.to_numpy()
    if any(len(set(y[part == k])) < 2 for k in (0, 1)):
        return None
    f = np.array(table.f.tolist(), float)
    order = np.lexsort((*f.T[::-1], y, part))  # the same rows in the same order in every run
    f, y, part = f[order], y[order], part[order]
    a, b, weights = cotrain(f[:, :CONTENT], f[:, CONTENT:], y, part)
    return [a.w, a.curve, b.w, b.curve, weights]


def score_batches(batches: Iterator[pa.RecordBatch], fitted: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    views = [View(np.zeros((0, CONTENT))), View(np.zeros((0, METADATA)))]
    views[0].w, views[0].curve, views[1].w, views[1].curve, weights = fitted
    for batch in batches:
        x, m = _features(batch)
        odds = [views[0].odds(x), views[1].odds(m)]
        z = odds[0] * weights[0] + odds[1] * weights[1] + weights[2]
        p = [1 / (1 + np.exp(-o)) for o in (z, *odds)]
        yield pa.RecordBatch.from_arrays([*batch.columns[3:], *map(pa.array, p)], names=[*batch.schema.names[3:], "score", "content_score", "metadata_score"])


def score(docs: DataFrame, fitted: list[np.ndarray] | None, least: float = 0.5) -> DataFrame:
    """``doc_id``, ``score`` (probability of good quality), the two views' scores and ``kept``."""
    rows = _inputs(docs).select(*_COLUMNS, "doc_id")
    if fitted is None:
        one = F.lit(1.0)
        return rows.select("doc_id", one.alias("score"), one.alias("content_score"), one.alias("metadata_score"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    scored = rows.mapInArrow(lambda batches: score_batches(batches, shared.value), "doc_id long, score double, content_score double, metadata_score double")
    return scored.withColumn("kept", F.col("score") >= least)


def keep_good(docs: DataFrame, fitted: list[np.ndarray] | None, least: float = 0.5) -> DataFrame:
    """The rows of *docs* of good quality, with the columns that they came with."""
    return docs if fitted is None else with_own_names(docs, lambda d: _keep_good(d, fitted, least), "doc_id", *_COLUMNS)


def _keep_good(docs: DataFrame, fitted: list[np.ndarray], least: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    fields = docs.schema.fields
    have = set(docs.columns)
    lead = [(F.col(c) if c in have else F.lit(None)).cast("string").alias(f"__{c}") for c in _COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = next(score_batches(iter([batch.select([0, 1, 2])]), shared.value)).column("score")
            yield batch.select(list(range(3, batch.num_columns))).filter(pa.array(np.asarray(p) >= least))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*lead, *[F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, ddl)
