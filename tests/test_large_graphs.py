"""Graph operators that hold no graph in one place, against brute force."""

import math
import random
import time
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import centrality, community, paths


def graph(spark, n, pairs, weights=False, seed=1):
    rng = random.Random(seed)
    names = [f"n{i:03}" for i in range(n)]
    edges = {(a, b): rng.uniform(0.5, 2.0) for a, b in pairs}
    nodes = spark.createDataFrame([(x,) for x in names], "name string")
    return names, edges, nodes, spark.createDataFrame([(names[a], names[b], w) for (a, b), w in edges.items()], "src string, dst string, weight double")


def sparse(n, m, seed):
    rng = random.Random(seed)
    return {tuple(rng.sample(range(n), 2)) for _ in range(m)}


def brute(n, pairs):
    """Inward closeness and directed betweenness, a search from every node."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    between, reach, far = [0.0] * n, [0] * n, [0] * n
    for s in range(n):
        order, dist, ways, before = [], {s: 0}, {s: 1}, {s: []}
        queue = deque([s])
        while queue:
            u = queue.popleft()
            order.append(u)
            for v in out.get(u, ()):
                if v not in dist:
                    dist[v], ways[v], before[v] = dist[u] + 1, 0, []
                    queue.append(v)
                if dist[v] == dist[u] + 1:
                    ways[v] += ways[u]
                    before[v].append(u)
        credit = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before[v]:
                credit[u] += ways[u] / ways[v] * (1 + credit[v])
            if v != s:
                between[v] += credit[v]
                reach[v] += 1
                far[v] += dist[v]
    close = [r / f * r / (n - 1) if f else 0.0 for r, f in zip(reach, far)]
    return close, [b / ((n - 1) * (n - 2)) for b in between]


@pytest.mark.parametrize("states", [200_000_000, 700])
def test_closeness_and_betweenness(spark, monkeypatch, states):
    monkeypatch.setattr(centrality, "STATES", states)
    pairs = sparse(30, 60, 3)
    names, _, nodes, edges = graph(spark, 30, pairs)
    close, between = brute(30, pairs)
    for got, want in ((centrality.closeness, close), (centrality.betweenness, between)):
        found = {r.name: r.score for r in got(nodes, edges).collect()}
        assert all(math.isclose(found[x], w, abs_tol=1e-12) for x, w in zip(names, want)) and len(found) == 30


def test_closeness_by_sketches(spark):
    """Exact where the sets are small; at 600 nodes within four standard errors of the counts."""
    for n, m, bound in ((30, 60, 1e-9), (600, 1500, 0.07)):
        pairs = sparse(n, m, 5)
        names, _, nodes, edges = graph(spark, n, pairs)
        want = dict(zip(names, brute(n, pairs)[0]))
        found = {r.name: r.score for r in centrality.closeness_sketched(nodes, edges, 12).collect()}
        assert len(found) == n and all(abs(found[x] - want[x]) <= bound * want[x] + 1e-12 for x in names)


def test_sketches_are_sent_once_a_block(spark, monkeypatch):
    """Not once an edge (F4): of many copies of a graph, each lies in blocks of its own, so that sources are sent no more often than in one copy."""
    monkeypatch.setattr(centrality, "BLOCK", 300)
    rng = random.Random(6)
    part = {e for p in range(10, 60) for h in rng.sample(range(10), 8) for e in ((p, h), (h, p))}
    sent = []
    for copies in (1, 5):
        pairs = {(a + 60 * i, b + 60 * i) for a, b in part for i in range(copies)}
        names, _, nodes, edges = graph(spark, 60 * copies, pairs)
        dealt = centrality._dealt(edges.select("src", "dst"), len(pairs)).collect()
        assert sorted((r.src, x) for r in dealt for x in r.to) == sorted((names[a], names[b]) for a, b in pairs)
        assert len({(r.block, r.src) for r in dealt}) == len(dealt)
        assert all(len({int(x[1:]) // 60 for r in dealt if r.block == block for x in [r.src, *r.to]}) == 1 for block in {r.block for r in dealt})
        sent.append(len(dealt) / copies)
        want = dict(zip(names, brute(60 * copies, pairs)[0]))
        found = {r.name: r.score for r in centrality.closeness_sketched(nodes, edges, 12).collect()}
        assert len(found) == 60 * copies and all(math.isclose(found[x], want[x], rel_tol=1e-9) for x in names)
    assert max(sent) <= 50 + 10 * 5 < len(part) / 4


@pytest.mark.parametrize("n, m, bits, bound", [(30, 60, 12, 1e-9), (200, 500, 8, 0.26)])
def test_sketches_in_parts_take_bounded_disk(spark, monkeypatch, n, m, bits, bound):
    """Of supply_closeness (r04, F1): with a bound on sketches all nodes still count as exactly, no table holds more of them, and what was dealt out does not stay."""
    monkeypatch.setattr(centrality, "SHARE", 0, raising=False)
    monkeypatch.setattr(centrality, "SKETCHES", n << bits, raising=False)  # copies are beyond it
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        found = {files.apply(i).getPath(): files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}
        return {path: size for path, size in found.items() if path.endswith(".data")}

    widths, real = [], centrality._cut

    def cut(df, *args, **kwargs):
        table = real(df, *args, **kwargs)
        if "s" in table.columns:
            widths.append(table.selectExpr("max(length(s))").first()[0])
        return table

    monkeypatch.setattr(centrality, "_cut", cut)
    before = shuffled()
    pairs = sparse(n, m, 5)
    names, _, nodes, edges = graph(spark, n, pairs)
    want = dict(zip(names, brute(n, pairs)[0]))
    out = centrality.closeness_sketched(nodes, edges, bits)
    end = time.time() + 20
    while (left := sum(size for path, size in shuffled().items() if path not in before)) > 2000 and time.time() < end:
        time.sleep(0.5)  # files are removed in the background
    found = {r.name: r.score for r in out.collect()}
    assert len(found) == n and all(abs(found[x] - want[x]) <= bound * want[x] + 1e-12 for x in names)
    assert max(widths) <= 2 ** (bits - 1) + 64 and left <= 2000


def test_ids_of_nodes_are_told_apart(spark, monkeypatch):
    """A seed under which two names have one number is passed over."""
    real = F.xxhash64
    monkeypatch.setattr(centrality.F, "xxhash64", lambda seed, name: F.when(seed == 0, 7).otherwise(real(seed, name)).cast("long"))
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "name string")
    known, number = centrality._numbered(nodes)
    rows = known.select("name", F.col("id") == number("name"), "id").collect()
    assert sorted(r.name for r in rows) == ["a", "b", "c"] and all(r[1] for r in rows) and len({r.id for r in rows}) == 3


def test_spectral_vectors_span_the_same_space(spark):
    pairs = {(min(p), max(p)) for p in sparse(60, 150, 8)}
    names, weights, _, edges = graph(spark, 64, pairs)  # four nodes at least have no links
    at = sorted({i for p in pairs for i in p})
    a = np.zeros((64, 64))
    for (i, j), w in weights.items():
        a[i, j] = a[j, i] = w
    a = a[np.ix_(at, at)]
    d = 1 / np.sqrt(a.sum(axis=1))
    want = np.linalg.eigh(d[:, None] * a * d[None])[1][:, ::-1][:, :4]
    found = {r.name: r.w for r in community.spectral_vectors(edges, 4).collect()}
    got = np.array([found[names[i]] for i in at])
    assert len(found) == len(at) and np.abs(got @ got.T - want @ want.T).max() < 1e-6


def test_spectral_finds_blocks_and_sets_isolated_nodes_apart(spark):
    rng = random.Random(2)
    pairs = {(i, j) for b in range(3) for i in range(b * 12, b * 12 + 12 - b) for j in range(i + 1, b * 12 + 12 - b) if rng.random() < 0.6} | {(0, 12), (12, 24)}
    names, _, nodes, edges = graph(spark, 40, pairs)
    part = {r.name: r.partition_id for r in community.spectral(nodes, edges, 4).collect()}
    assert [part[x] for x in names] == [0] * 12 + [1] * 11 + [3] + [2] * 10 + [3] * 6
    assert {r.partition_id for r in community.spectral(nodes, edges.limit(0), 3).collect()} == {0}


def test_loops_leave_no_tables(spark):
    import glob

    folder = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    _, _, nodes, edges = graph(spark, 20, sparse(20, 40, 4))
    before = set(glob.glob(f"{folder}/loomgraph-*"))
    centrality.pagerank(nodes, edges, iterations=12).count()
    paths.hops(edges, "n001").count()
    assert len(set(glob.glob(f"{folder}/loomgraph-*")) - before) < 10
