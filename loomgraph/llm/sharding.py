"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. The rows are written once with their place (input block, position in it), which fixes what later
   steps and repeated tasks see.
2. A matrix is drawn on the driver: how many rows of each block go to each shard. Row by row it is
   multivariate hypergeometric over what the shards still have room for, so shard sizes hold exactly
   and every assignment of rows to shards is equally likely, whatever the number of rows. It has at most ``BLOCKS`` x shards counts.
3. Each block is permuted locally: a seeded permutation of the multiset of its shard numbers.
4. One exchange moves the rows, by shard and a random slice of the shard that keeps tasks small.
5. Each slice is permuted again, and slots follow from the slice counts without a gap.

Defined results: a null text counts 0 bytes; a null ``doc_id`` and repeated rows are rows like others; with
fewer rows than shards some shards are empty; an empty table gives no rows; a column of the input
whose name is that of a result column (``shard``, ``slot``) is replaced, all others come through as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log, log1p, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unused

#: Most rows of the matrix; more input blocks than that are taken together.
BLOCKS = 4096
#: Bytes of text that a slice of a shard should hold, and slices of a shard beyond which they grow instead.
SLICE_BYTES, SLICES = 24 << 20, 4096


def shard_sizes(n: int, shards: int) -> np.ndarray:
    """Row counts at most one apart."""
    return np.array([n // shards + (s < n % shards) for s in range(shards)], np.int64)


def communication_matrix(blocks: np.ndarray, shards: np.ndarray, seed: int) -> np.ndarray:
    """Counts of rows from block i to shard j: rows sum to *blocks*, columns to *shards*."""
    room, out = shards.copy(), np.zeros((len(blocks), len(shards)), np.int64)
    for i, n in enumerate(blocks):
        rng = np.random.Generator(np.random.Philox(key=[seed, i]))
        left, rest = int(n), int(room.sum())
        for j in range(len(shards)):
            rest -= int(room[j])
            take = _hypergeometric(rng, int(room[j]), rest, left)
            out[i, j] = take
            left -= take
        room -= out[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 10**9:  # the generator's own range
        return int(rng.hypergeometric(good, bad, n))
    return _hypergeometric_by_rejection(rng, good, bad, n)


def _log_factorial_step(a: int, x: int) -> float:
    """log((a + x)! / a!), to some 1e-9 for the step sizes of a draw, by Stirling's series with the large terms taken off."""
    if min(a, a + x) < 100:
        return float(np.log(np.arange(a + 1, a + x + 1, dtype=float)).sum()) if x >= 0 else -_log_factorial_step(a + x, -x)
    b, tail = a + x, lambda k: 1 / (12 * k) - 1 / (360 * k**3)
    return x * log(a) + (b + 0.5) * log1p(x / a) - x + tail(b) - tail(a)


def _hypergeometric_by_rejection(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A draw for any size, by Devroye's generator for discrete log-concave laws (1987): it needs only probabilities relative to the mode's."""
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)

    def ratio(x: int) -> float:
        """Probability of mode + x over that of the mode."""
        k = mode + x
        if not max(0, n - bad) <= k <= min(n, good):
            return 0.0
        return exp(-_log_factorial_step(mode, x) - _log_factorial_step(good - mode, -x) - _log_factorial_step(n - mode, -x) - _log_factorial_step(bad - n + mode, x))

    # The mode's own probability only shapes the envelope, which holds for any smaller number as well.
    variance = max(n * (good / total) * (bad / total) * ((total - n) / (total - 1)), 0.02)
    p = 0.9 * min(1.0, 1 / (2 * pi * variance) ** 0.5) if variance > 1 else 0.2
    w = 1 + p / 2
    while True:
        y = rng.random() * w / p if rng.random() < w / (1 + w) else (w + rng.standard_exponential()) / p
        x = int(y + 0.5) * (1 if rng.random() < 0.5 else -1)
        if rng.random() * min(1.0, exp(w - p * y)) <= ratio(x):
            return mode + x


def shuffle(docs: DataFrame, shards: int = 24, seed: int = 11, size: str = "text") -> DataFrame:
    """The rows of *docs* with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard)."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    at, cut, rank, first = (unused(docs, c) for c in ("__place", "__slice", "__rank", "__start"))
    place = stage(docs.withColumn(at, F.monotonically_increasing_id()), "placed")
    part = F.shiftright(at, 33)
    found = sorted(tuple(r) for r in place.groupBy(part.alias("p")).agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length(size), F.lit(0)))).collect())
    if not found:
        return place.drop(at).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    total, held = sum(n for _, n, _ in found), sum(b for _, _, b in found)

    # Blocks: runs of input partitions; a partition's rows follow those of the ones before it.
    per = -(-len(found) // BLOCKS)
    block_of, offset_of, blocks = {}, {}, []
    for k, (p, n, _) in enumerate(found):
        if k % per == 0:
            blocks.append(0)
        block_of[p], offset_of[p] = len(blocks) - 1, blocks[-1]
        blocks[-1] += n
    matrix = communication_matrix(np.array(blocks), shard_sizes(total, shards), seed)
    shared = spark.sparkContext.broadcast((block_of, offset_of, matrix))

    def permuted(places: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block_of, offset_of, matrix = shared.value
        labels: dict[int, np.ndarray] = {}
        for batch in places:
            where = batch.to_numpy()
            shard = np.empty(len(where), np.int32)
            for p in np.unique(where >> 33):
                b = block_of[int(p)]
                if b not in labels:
                    labels = {b: np.random.Generator(np.random.Philox(key=[seed + 1, b])).permutation(np.repeat(np.arange(matrix.shape[1], dtype=np.int32), matrix[b]))}
                mine = (where >> 33) == p
                shard[mine] = labels[b][offset_of[int(p)] + (where[mine] & ((1 << 33) - 1))]
            yield pa.array(shard)

    # Only places go to Python and shards come back; the rows themselves stay where they are until the exchange.
    shard_of = F.arrow_udf(permuted, "int")
    slices = min(SLICES, max(1, -(-held // (shards * SLICE_BYTES))))
    slice_of = F.pmod(F.xxhash64(F.lit(seed + 2), at), F.lit(slices)).cast("int")
    # The second pass reads places only; slice counts are at most shards x slices numbers.
    counts = place.select(shard_of(at).alias("shard"), slice_of.alias(cut)).groupBy("shard", cut).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", cut, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))

    # A task of the exchange for each slice, however many partitions the session gives other shuffles.
    moved = place.withColumn("shard", shard_of(at)).withColumn(cut, slice_of).repartition(shards * slices, "shard", cut)
    again = Window.partitionBy("shard", cut).orderBy(F.xxhash64(F.lit(seed + 3), at), at)
    slotted = moved.withColumn(rank, F.row_number().over(again)).join(starts, ["shard", cut])
    return slotted.select(*[F.col(f"`{c}`") for c in docs.columns], "shard", (F.col(first) + F.col(rank) - 1).cast("long").alias("slot"))
