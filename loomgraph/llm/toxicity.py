"""Toxicity by class-conditional Kneser-Ney models of spellings and of word pairs.

For each class a byte model of order 7 gives the probability of a word's spelling. Its highest order
has the class's own counts; all lower orders are continuation counts that the classes share, so a rare
expression is judged by what both classes know of its parts and only well-attested differences tell them
apart. A second model gives the probability of a word after another one: each class's own counts, backed by the counts of both
together, backed by the word's shared continuation count; it multiplies what the spelling says, so that an expression of several ordinary words is seen.
A pair that no toxic document has says only what its words say.

A document's evidence is its length-normalised log-likelihood ratio, the sum over all its words and pairs over their length in bytes; beside it
stand its strongest words and its strongest pair, as few words make a long document toxic. A logistic curve, fitted on
labelled rows that gave no counts, turns that into a score.

Labels are learned only from rows that are not held out (``held_out`` in ``common``), at most about
``SAMPLE`` of them, word pairs from about ``PAIRED``; these bounds also bound the models, which are broadcast. Exact copies among them count once.

Defined results: a null or empty text has no evidence and gets the score of a document without any; repeated
rows are scored alike; a null ``doc_id`` is held out when crc32 of the empty text says so (it is 0, so
yes); labels that are null or repeat are dropped or merged (toxic if any says so); without both classes among the labels every score is 0; an empty table
gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, stage

#: Bytes of an n-gram (7 fit a 64-bit key).
ORDER, DISCOUNT = 7, 0.75
#: Labelled rows to learn from; every fifth of them sets the curve and gives no counts.
SAMPLE = 24_000
#: Of the rows that give counts, at most about so many give word pairs, of which there are far more than spellings.
PAIRED = 6_000
#: Strongest words that stand beside the document's own evidence and its strongest pair.
TOP = 3
MEMORY = 400_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def name(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def pairs_of(names: np.ndarray) -> np.ndarray:
    """64 bits for each two names that follow each other."""
    x = names[:-1] * np.uint64(0x9E3779B97F4A7C15) + names[1:]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """ORDER-byte windows of words as integers, and how many each word has.

    A word stands as ORDER - 1 blanks, its bytes and a closing blank.
    """
    lead = b" " * (ORDER - 1)
    raw = [lead + w.encode("utf-8", "surrogatepass") + b" " for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    keys = np.zeros(len(data) - ORDER + 1, np.int64)
    for i in range(ORDER):
        keys = keys << 8 | data[i : i + len(keys)]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.cumsum(sizes) - sizes
    n = sizes - (ORDER - 1)
    pick = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return keys[pick], n


@dataclass
class Level:
    """Known n-grams of one order: log-probabilities, and log back-off weights of known contexts, a column a class."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    logb: np.ndarray


class KneserNey:
    """Both classes' models at once, from the highest-order counts of each class (ordinary, toxic)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.levels: list[Level] = []
        types = keys[order]
        lower: list[tuple[np.ndarray, np.ndarray]] = []
        g = types
        for k in range(ORDER - 1, 0, -1):  # shared continuation counts: left neighbours that differ
            g, n = np.unique(g & ((1 << 8 * k) - 1), return_counts=True)
            lower.append((g, n))
        for k, (g, n) in zip(range(1, ORDER), reversed(lower)):
            self.levels.append(self._level(g, np.stack([n, n], 1).astype(float), k))
        self.levels.append(self._level(types, counts[order].astype(float), ORDER))

    def _level(self, keys: np.ndarray, counts: np.ndarray, k: int) -> Level:
        context = keys >> 8
        contexts, at = np.unique(context, return_inverse=True)
        total = np.stack([np.bincount(at, counts[:, c]) for c in range(2)], 1)
        kinds = np.stack([np.bincount(at, counts[:, c] > 0) for c in range(2)], 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(total > 0, DISCOUNT * kinds / total, 1.0)
            own = np.where(total[at] > 0, np.maximum(counts - DISCOUNT, 0) / total[at], 0.0)
        below = np.exp(self.logp(keys & ((1 << 8 * (k - 1)) - 1), k - 1))
        return Level(keys, np.log(own + weight[at] * below), contexts, np.log(weight))

    def logp(self, keys: np.ndarray, order: int | None = None) -> np.ndarray:
        """Log-probabilities of the last byte of each n-gram after the others, a column a class."""
        order = len(self.levels) if order is None else order
        out = np.full((len(keys), 2), -np.log(256.0))
        for k, level in enumerate(self.levels[:order], 1):
            g = keys & ((1 << 8 * k) - 1)
            ctx, hit = _find(level.contexts, g >> 8)
            out[hit] += level.logb[ctx[hit]]
            at, hit = _find(level.keys, g)
            out[hit] = level.logp[at[hit]]
        return out

    def evidence(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Toxic minus ordinary log-likelihood of each word's spelling, and the bytes that it was taken over."""
        if not words:
            return np.empty(0), np.empty(0, np.int64)
        keys, n = grams(words)
        distinct, back = np.unique(keys, return_inverse=True)
        both = self.logp(distinct)
        diff = (both[:, 1] - both[:, 0])[back]
        return np.add.reduceat(diff, np.cumsum(n) - n), n


class Pairs:
    """Evidence of the word pairs that toxic documents have."""

    def __init__(self, keys: np.ndarray, evidence: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], evidence[order]
        self.seen = np.zeros(1 << 22, bool)  # tells most other pairs apart without a search
        self.seen[keys & (len(self.seen) - 1)] = True

    def evidence(self, keys: np.ndarray) -> np.ndarray:
        """Of those of the pairs that are known."""
        keys = keys[self.seen[keys & (len(self.seen) - 1)]]
        at, hit = _find(self.keys, keys)
        return self.values[at[hit]]


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


class Scorer:
    """Features of whole texts; remembers the evidence of the words that it has met."""

    def __init__(self, model: KneserNey, pairs: Pairs):
        self.model, self.pairs = model, pairs
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sums, self.sizes, self.names = np.empty(0), np.empty(0, np.int64), np.empty(0, np.uint64)

    def _learn(self, words: list[list[str]]) -> None:
        new = list(set().union(*words).difference(self.known))
        if len(self.known) + len(new) > MEMORY and self.known:
            self._forget()
            new = list(set().union(*words))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            sums, sizes = self.model.evidence(new)
            self.sums, self.sizes = np.concatenate([self.sums, sums]), np.concatenate([self.sizes, sizes])
            self.names = np.concatenate([self.names, np.fromiter(map(name, new), np.uint64, len(new))])

    def features(self, texts: list[str | None]) -> np.ndarray:
        words = [words_of(t) for t in texts]
        self._learn(words)
        out = np.zeros((len(texts), TOP + 2))
        for row, own in zip(out, words):
            if own:
                at = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
                pairs = self.pairs.evidence(pairs_of(self.names[at]))
                row[TOP] = (self.sums[at].sum() + pairs.sum()) / self.sizes[at].sum()
                row[TOP + 1] = max(0.0, pairs.max(initial=0.0))
                each = np.unique(at)
                e = self.sums[each] / self.sizes[each]
                top = np.sort(np.partition(e, -TOP)[-TOP:] if len(e) > TOP else e)[::-1]
                row[: len(top)] = np.maximum(top, 0)
        return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression (last: intercept) by Newton steps with a small ridge."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], penalty)
    ridge[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (p - y) + ridge * w
        hess = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to highest-order counts by class; a document counts each of its words once."""
    for batch in batches:
        parts = []
        for label in (0, 1):
            words = [w for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if y == label for w in set(words_of(t))]
            if words:
                keys, n = np.unique(grams(words)[0], return_counts=True)
                parts.append((keys, n if label == 0 else n * 0, n if label else n * 0))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["gram", "ordinary", "toxic"])


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to the pairs of each document, once each: both words' names, the class."""
    for batch in batches:
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            names = np.fromiter(map(name, words_of(t)), np.uint64)
            if len(names) > 1:
                at = np.unique(pairs_of(names), return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(names[at].view(np.int64)), pa.array(names[at + 1].view(np.int64)), pa.array(np.full(len(at), y == 0, np.int32)), pa.array(np.full(len(at), y == 1, np.int32))], names=["first", "second", "ordinary", "toxic"])


def pair_evidence(rows: DataFrame) -> DataFrame:
    """``first``, ``second``, ``evidence`` of (text, __y) rows: log P(second | first, toxic) - log P(second | first, ordinary) of the pairs that toxic rows have."""
    n = {c: F.sum(c).cast("int").alias(c) for c in ("ordinary", "toxic")}
    pairs = stage(rows.mapInArrow(_pair_batches, "first long, second long, ordinary int, toxic int").groupBy("first", "second").agg(*n.values()), "pairs")
    kinds = lambda c: F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds")
    after = pairs.groupBy("first").agg(*[F.sum(c).alias(f"{c}_all") for c in n], kinds("ordinary"), kinds("toxic"), F.count(F.lit(1)).alias("kinds"))
    before = pairs.groupBy("second").agg(F.count(F.lit(1)).alias("lefts"))
    total = pairs.count() or 1  # sums of what is bounded by the sample of labelled rows

    def backed(count: Column, whole: Column, different: Column, lower: Column) -> Column:
        return F.when(whole > 0, (F.greatest(count - DISCOUNT, F.lit(0.0)) + DISCOUNT * different * lower) / whole).otherwise(lower)

    known = pairs.where("toxic > 0").join(after, "first").join(before, "second")
    both = backed(F.col("ordinary") + F.col("toxic"), F.col("ordinary_all") + F.col("toxic_all"), F.col("kinds"), F.col("lefts") / F.lit(total))
    known = known.withColumn("both", both)
    own = [backed(F.col(c), F.col(f"{c}_all"), F.col(f"{c}_kinds"), F.col("both")) for c in ("toxic", "ordinary")]
    return known.select("first", "second", (F.log(own[0]) - F.log(own[1])).alias("evidence"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> tuple[KneserNey, Pairs, np.ndarray] | None:
    """The models and the weights of the curve, from labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("__y")).where(F.col("__y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("__y").alias("__y")).where(~held_out(F.col("doc_id")))
    chosen = F.broadcast(bounded_sample(known, sample, key="doc_id"))  # about `sample` pairs of numbers
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id").select("text", "__y")
    rows = rows.groupBy(F.xxhash64("text").alias("__h")).agg(F.first("text").alias("text"), F.max("__y").alias("__y"))
    rows = stage(bounded_sample(rows, sample, key="__h"), "labelled")  # an id may have many texts
    curve = F.pmod(F.col("__h"), F.lit(5)) == 0
    counted = rows.where(~curve).select("text", "__y")
    table = counted.mapInArrow(_count_batches, "gram long, ordinary long, toxic long").groupBy("gram").agg(F.sum("ordinary").cast("int").alias("ordinary"), F.sum("toxic").cast("int").alias("toxic")).toPandas()
    if not table.ordinary.any() or not table.toxic.any():
        return None
    model = KneserNey(table.gram.to_numpy(np.int64), table[["ordinary", "toxic"]].to_numpy())
    del table
    found = pair_evidence(bounded_sample(rows.where(~curve), PAIRED, key="__h").select("text", "__y")).toPandas()
    names = found[["first", "second"]].to_numpy(np.int64).view(np.uint64)
    pairs = Pairs(pairs_of(names.ravel())[::2], found.evidence.to_numpy(float))
    shared = docs.sparkSession.sparkContext.broadcast((model, pairs))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            f = scorer.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(f), pa.list_(pa.float64())), batch.column(1)], names=["f", "y"])

    fit = rows.where(curve).select("text", "__y").mapInArrow(measured, "f array<double>, y int").toPandas()
    if fit.y.nunique() < 2:  # too few labels for a part of both classes: the curve is fitted on the rows that the models have counted as well
        fit = rows.select("text", "__y").mapInArrow(measured, "f array<double>, y int").toPandas()
    return model, pairs, logistic(np.array(fit.f.tolist()), fit.y.to_numpy(float))


def score(docs: DataFrame, fitted: tuple[KneserNey, Pairs, np.ndarray] | None) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and the evidence for every document."""
    out = docs.select(F.col("doc_id").cast("long"), "text")
    if fitted is None:
        zero = F.lit(0.0)
        scored = out.select("doc_id", zero.alias("score"), zero.alias("evidence"), zero.alias("strongest"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(fitted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, pairs, w = shared.value
            scorer = Scorer(model, pairs)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    f = scorer.features(part.column(1).to_pylist())
                    s = 1 / (1 + np.exp(-np.clip(f @ w[:-1] + w[-1], -40, 40)))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array(f[:, TOP]), pa.array(f[:, 0])], names=["doc_id", "score", "evidence", "strongest"])

        scored = out.mapInArrow(run, "doc_id long, score double, evidence double, strongest double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "strongest")
