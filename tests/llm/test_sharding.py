from collections import Counter, defaultdict
from math import comb, lgamma

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import sharding


def test_matrix_margins_and_law():
    blocks, shards = np.array([5, 0, 40, 1, 54]), sharding.shard_sizes(100, 7)
    seen = []
    for seed in range(300):
        m = sharding.communication_matrix(blocks, shards, seed)
        assert (m.sum(axis=1) == blocks).all() and (m.sum(axis=0) == shards).all() and (m >= 0).all()
        seen.append(m[2])
    mean = np.array(seen).mean(axis=0)
    assert abs(mean - 40 * shards / 100).max() < 0.5


def test_large_counts_keep_margins():
    blocks, shards = np.array([3 * 10**9, 2 * 10**9]), sharding.shard_sizes(5 * 10**9, 24)
    m = sharding.communication_matrix(blocks, shards, 1)
    assert (m.sum(axis=1) == blocks).all() and (m.sum(axis=0) == shards).all() and (m >= 0).all()


def test_rejection_draws_follow_the_law():
    """Against exact probabilities, where they can be summed; and mean and spread where the generator of numpy ends."""
    rng = np.random.default_rng(4)
    for good, bad, n in ((30, 50, 20), (3, 400, 100), (1000, 9, 500), (300, 500, 400)):
        seen = Counter(sharding._hypergeometric_by_rejection(rng, good, bad, n) for _ in range(20_000))
        chi = sum((seen[k] - e) ** 2 / e for k in range(n + 1) if (e := 20_000 * comb(good, k) * comb(bad, n - k) / comb(good + bad, n)) > 5)
        cells = sum(20_000 * comb(good, k) * comb(bad, n - k) / comb(good + bad, n) > 5 for k in range(n + 1))
        assert chi < cells + 4 * (2 * cells) ** 0.5 + 5
    good, bad, n = 4 * 10**9, 6 * 10**9, 3 * 10**9
    draws = np.array([sharding._hypergeometric(rng, good, bad, n) for _ in range(3000)], float)
    mean, sd = n * 0.4, (n * 0.4 * 0.6 * 0.7) ** 0.5
    assert abs(draws.mean() - mean) < 4 * sd / 3000**0.5 and abs(draws.std() / sd - 1) < 0.06
    steps = [sharding._log_factorial_step(a, x) for a, x in ((200, 50), (10**6, -999), (150, -80))]
    assert np.allclose(steps, [lgamma(251) - lgamma(201), lgamma(10**6 - 998) - lgamma(10**6 + 1), lgamma(71) - lgamma(151)], rtol=1e-9)


def check(rows, n, shards):
    assert len(rows) == n
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_are_exact_and_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_BYTES", 200)
    docs = spark.range(0, 1003, 1, 7).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 > 0, "same text").alias("text"), F.lit(9).alias("slot"), F.lit("x").alias("other"))
    rows = sharding.shuffle(docs).collect()
    check(rows, 1003, 24)
    assert sorted(r.doc_id for r in rows) == list(range(1003)) and rows[0].other == "x"
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.shuffle(docs).collect()))
    near = Counter(r.shard for r in rows if r.doc_id < 240)
    assert max(near.values()) < 40


def test_blocks_of_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCKS", 3)
    docs = spark.range(0, 500, 1, 8).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    check(sharding.shuffle(docs, 5).collect(), 500, 5)


def test_few_rows_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    check(sharding.shuffle(docs).collect(), 3, 24)
    assert sharding.shuffle(docs.limit(0)).collect() == []


def test_clashing_names_and_long_texts(spark):
    docs = spark.createDataFrame([(k, "w" * (5_000_000 if k == 3 else k), "own", 7, None) for k in range(60)], "doc_id long, text string, __place string, __Slice int, __rank string")
    rows = sharding.shuffle(docs).collect()
    check(rows, 60, 24)
    assert all((r["__place"], r["__Slice"], r["__rank"]) == ("own", 7, None) and len(r.text) == (5_000_000 if r.doc_id == 3 else r.doc_id) for r in rows)


def test_query_equals_brute_force(spark, sf):
    """Sizes, checksums, law and counts of the whole query."""
    import zlib
    from collections import Counter

    from loomgraph.llm import queries

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs) and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert all(r.size == len(docs[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in got)
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(24)) and max(counts.values()) - min(counts[s] for s in range(24)) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
