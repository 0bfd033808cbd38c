"""Communities, partitions, compression and super-graphs of an undirected weighted graph ``(src, dst, weight)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedup import top_per
from .paths import _cut, drop

#: Nodes and edges up to which a partition may be found in one task.
SMALL, SMALL_EDGES = 20_000, 400_000


def undirected(edges: DataFrame, weight: str = "strength") -> DataFrame:
    """One row a pair, ends in order; of parallel and opposite edges the last in (src, dst) wins."""
    back = F.coalesce(F.col("src") > F.col("dst"), F.lit(False))
    pair = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), back.cast("int").alias("back"), F.when(back, F.col(weight)).alias("last"), F.when(~back, F.col(weight)).alias("first"))
    best = pair.groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("back", "last", "first")])  # numbers alone, so Spark hashes and sorts nothing
    return _cut(best.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.when(F.col("back") == 1, F.col("last")).otherwise(F.col("first")).alias("weight")), rows=edges.count())


def louvain_labels(names: list[str], edges: list[tuple[str, str, float]], resolution: float = 1.0) -> dict[str, int]:
    """Louvain (Blondel et al. 2008), nodes in sorted order, ties to the smaller label; labels by size, then least name."""
    group = {n: i for i, n in enumerate(sorted(names))}
    links: dict[int, dict[int, float]] = {i: {} for i in group.values()}
    for a, b, w in edges:
        i, j = group[a], group[b]
        links[i][j] = links[i].get(j, 0.0) + w
        links[j][i] = links[j].get(i, 0.0) + w
    total = sum(sum(v.values()) for v in links.values())
    while total:
        label = {i: i for i in links}
        strength = {i: sum(v.values()) for i, v in links.items()}
        volume = dict(strength)
        moved = improved = True
        improved = False
        while moved:
            moved = False
            for i in sorted(links):
                near: dict[int, float] = {}
                for j, w in links[i].items():
                    if j != i:
                        near[label[j]] = near.get(label[j], 0.0) + w
                own = label[i]
                volume[own] -= strength[i]
                gain = lambda c: near.get(c, 0.0) - resolution * volume[c] * strength[i] / total  # noqa: B023, E731
                best, most = own, gain(own)
                for c in sorted(near):
                    if gain(c) > most + 1e-12:
                        best, most = c, gain(c)
                volume[best] += strength[i]
                if best != own:
                    label[i], moved, improved = best, True, True
        if not improved:
            break
        number = {c: k for k, c in enumerate(sorted(set(label.values())))}
        group = {n: number[label[i]] for n, i in group.items()}
        merged: dict[int, dict[int, float]] = {k: {} for k in number.values()}
        for i, v in links.items():
            for j, w in v.items():
                a, b = number[label[i]], number[label[j]]
                merged[a][b] = merged[a].get(b, 0.0) + w
        links = merged
    members: dict[int, list[str]] = {}
    for n, c in group.items():
        members.setdefault(c, []).append(n)
    ordered = sorted(members.values(), key=lambda m: (-len(m), min(m)))
    return {n: k for k, m in enumerate(ordered) for n in m}


def louvain(nodes: DataFrame, edges: DataFrame, weighted: bool = True, resolution: float = 1.0) -> DataFrame:
    """(name, partition_id), largest first. One task for small graphs, joins for larger ones (``label_rounds``); both move until no level gains."""
    e = edges.select("src", "dst", (F.col("weight") if weighted else F.lit(1.0)).alias("weight")).where("src <> dst")
    if nodes.count() > SMALL or e.count() > SMALL_EDGES:
        return label_rounds(nodes, e, resolution)
    rows = nodes.select("name", F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("weight")).unionByName(e.withColumnRenamed("src", "name")).withColumn("g", F.lit(1))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        links = f[f.dst.notna()]
        names = set(f.name[f.dst.isna()]) | set(links.name) | set(links.dst)
        found = louvain_labels(sorted(names), sorted(zip(links.name, links.dst, links.weight)), resolution)
        return pd.DataFrame({"name": list(found), "partition_id": list(found.values())})

    return rows.groupBy("g").applyInPandas(run, "name string, partition_id long")


def _quality(state: DataFrame, both: DataFrame, total: float, resolution: float) -> float:
    """Newman's modularity of labels (name, c, k) on links that are there from both ends."""
    ends = both.join(state.select(F.col("name").alias("src"), F.col("c").alias("__a")), "src").join(state.select(F.col("name").alias("dst"), F.col("c").alias("__b")), "dst")
    inside = ends.where("__a = __b").agg(F.sum("weight")).first()[0] or 0.0
    squares = state.groupBy("c").agg(F.sum("k").alias("v")).agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
    return inside / total - resolution * squares / total**2


def _round_of_moves(state: DataFrame, links: DataFrame, total: float, resolution: float, number: int) -> DataFrame:
    """The half of the nodes that a hash names for this round moves to the neighbouring label of most gain. *state* (name, c, k) has the labels and strengths of all linked nodes."""
    volume = state.groupBy("c").agg(F.sum("k").alias("v"))
    near = links.join(state.select(F.col("name").alias("dst"), "c"), "dst").select(F.col("src").alias("name"), "c", F.col("weight").alias("w"))
    near = near.unionByName(state.select("name", "c", F.lit(0.0).alias("w"))).groupBy("name", "c").agg(F.sum("w").alias("w"))
    scored = near.join(volume, "c").join(state.withColumnRenamed("c", "own"), "name")
    inside = F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(F.lit(0.0))
    gain = F.col("w") - resolution * (F.col("v") - inside) * F.col("k") / total
    best = scored.groupBy("name", "own", "k").agg(F.max_by("c", F.struct(gain, (F.col("c") == F.col("own")).cast("int"), "c")).alias("to"))  # every node has its own label at least
    turn = F.pmod(F.xxhash64(F.lit(number), "name"), F.lit(2)) == 0
    return _cut(best.select("name", F.when(turn, F.col("to")).otherwise(F.col("own")).alias("c"), "k"))


def _local_moves(names: DataFrame, both: DataFrame, total: float, resolution: float, patience: int = 3) -> DataFrame | None:
    """The best labels (name, c) that pairs of rounds find until *patience* of them bring no more; None if none beats one label a node.

    Only nodes with links take part in the rounds; the others keep their labels.
    """
    linked = both.groupBy(F.col("src").alias("name")).agg(F.sum("weight").alias("k"))
    state = _cut(names.join(linked, "name").select("name", F.col("name").alias("c"), "k"))
    links = both.where("src <> dst")
    found, best, number, idle = None, _quality(state, both, total, resolution), 0, 0
    while idle < patience:
        for _ in range(2):
            old, state = state, _round_of_moves(state, links, total, resolution, number)
            if old is not found:
                drop(old)
            number += 1
        now = _quality(state, both, total, resolution)
        idle += 1
        if now > best + 1e-7:
            if found is not None:
                drop(found)
            found, best, idle = state, now, 0
    if found is None:
        return None
    return names.join(found.select("name", "c"), "name", "left").select("name", F.coalesce("c", "name").alias("c"))


def numbered(df: DataFrame, *order, to: str = "number") -> DataFrame:
    """Gapless numbers from 0 in *order*: ranges are sorted apart, and only one count a range goes through the driver."""
    row = F.monotonically_increasing_id()
    laid = _cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.shiftright(row, 33), "__at": row.bitwiseAND(F.lit((1 << 33) - 1))}))
    before, starts = 0, []
    for r in laid.groupBy("__part").count().orderBy("__part").collect():
        starts.append((r["__part"], before))
        before += r["count"]
    start = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    return laid.join(F.broadcast(start), "__part").withColumn(to, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")  # a row a range


def label_rounds(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Louvain as joins, for graphs of any size: local moves, then communities become the nodes of the next level, until none gains.

    Ties differ from the form in one task, as half of the nodes move at a time.
    """
    both = _cut(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    whole = nodes.select("name", F.col("name").alias("c"))
    total = both.agg(F.sum("weight")).first()[0]
    names = nodes.select("name")
    while total and (label := _local_moves(names, both, total, resolution)) is not None:
        whole = _cut(whole.join(label.select(F.col("name").alias("c"), F.col("c").alias("__to")), "c", "left").select("name", F.coalesce("__to", "c").alias("c")))
        src, dst = (label.select(F.col("name").alias(end), F.col("c").alias(f"__{end}")) for end in ("src", "dst"))
        both = _cut(both.join(src, "src").join(dst, "dst").groupBy(F.col("__src").alias("src"), F.col("__dst").alias("dst")).agg(F.sum("weight").alias("weight")))
        names = _cut(label.select(F.col("c").alias("name")).distinct())
    sizes = whole.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("least"))
    return whole.join(numbered(sizes, F.desc("n"), "least", to="partition_id").select("c", "partition_id"), "c").select("name", "partition_id")


def kmeans(nodes: DataFrame, edges: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """k-means on the degree alone; fewer nodes than k are one partition each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ends = edges.select(F.explode(F.array("src", "dst")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("d"))
    d = _cut(nodes.select("name").join(ends, "name", "left").select("name", F.coalesce("d", F.lit(0)).cast("double").alias("degree")))  # read by count, fit and transform
    if d.count() < k:
        return d.select("name", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("name")) - 1).cast("long").alias("partition_id"))
    rows = VectorAssembler(inputCols=["degree"], outputCol="features").transform(d)
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("name", F.col("prediction").cast("long").alias("partition_id"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _gram(rows: DataFrame, held: int, k: int) -> np.ndarray:
    """[v w]^T w over all rows (v, w): (held + k) x k numbers, summed in the tasks; nothing else comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((held + k, k))
        for b in batches:
            if b.num_rows:
                w = _matrix(b.column("w"))
                total += np.hstack([_matrix(b.column("v")).reshape(len(w), held), w]).T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["i", "x"])

    sums = rows.select("v", "w").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((held + k) * k)
    for r in sums:
        out[r.i] = r.x
    return out.reshape(held + k, k)


def _mapped(rows: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray], columns: tuple[str, ...] = ("v", "w")) -> DataFrame:
    """Rows (name, v, w) with w replaced by what *f* makes of the matrices of v and w, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = f(*[_matrix(b.column(c)) for c in columns])
                ends = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column("name"), b.column("v"), pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(w).ravel()))], ["name", "v", "w"])

    return rows.mapInArrow(run, "name string, v array<double>, w array<double>")


def _orthogonal(rows: DataFrame, held: int, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """w made orthonormal to v and in itself, with h and r of w = v h + q r. Two passes, the second on what the first leaves, keep full precision; directions that vanish are 0."""
    h = _gram(rows, held, k)[:held]
    first = _mapped(rows, lambda v, w: w - v.reshape(len(w), held) @ h)
    again = _gram(first, held, k)
    fix, rest = again[:held], again[held:]
    values, turned = np.linalg.eigh(rest - fix.T @ fix)
    size = np.sqrt(np.where(values > 1e-24, values, 0.0))
    scaled = turned * np.where(size > 0, 1 / np.where(size > 0, size, 1), 0)
    return _mapped(first, lambda v, w: (w - v.reshape(len(w), held) @ fix) @ scaled), h + fix, size[:, None] * turned.T


def spectral_vectors(edges: DataFrame, k: int, depth: int = 6, tolerance: float = 1e-8, most: int = 60, extra: int = 4) -> DataFrame:
    """(name, w): each linked node's entries in the *k* leading eigenvectors of the normalised adjacency, that is the least of the Laplacian.

    Block Lanczos with restarts: a block of k + *extra* vectors (those beyond k make the others converge sooner) is multiplied by the matrix in one join along the edges, made orthogonal to the blocks before it through a small
    Gram matrix, and after *depth* blocks the projected problem, of depth x (k + extra) rows, is solved on the driver. The matrix is (I + S) / 2, so that
    its spectrum is positive. A node's row holds as many numbers; no task holds the graph. *tolerance* bounds the residual.
    """
    both = edges.where("src <> dst").select("src", "dst", "weight").where("weight > 0")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    strength = _cut(both.groupBy("src").agg(F.sum("weight").alias("d")))
    ends = strength.select(F.col("src").alias("dst"), F.col("d").alias("e"))
    step = _cut(both.join(strength, "src").join(ends, "dst").select("src", "dst", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("s")))
    n = strength.count()
    asked, k = min(k, n), min(k + extra, n)
    schema = "name string, v array<double>, w array<double>"
    if not n:
        return edges.sparkSession.createDataFrame([], schema).select("name", "w")
    none = F.array().cast("array<double>")
    start = F.array(*[F.pmod(F.xxhash64(F.lit(i), "src"), F.lit(1 << 20)) / F.lit(float(1 << 19)) - 1 for i in range(k)])
    found = _cut(_orthogonal(_cut(strength.select(F.col("src").alias("name"), none.alias("v"), start.alias("w"))), 0, k)[0])
    for _ in range(most):
        basis, t = found.select("name", F.col("w").alias("v")), np.zeros((depth * k, depth * k))
        for j in range(1, depth + 1):
            held = j * k
            last = basis.select("name", F.slice("v", held - k + 1, k).alias("b"))
            flow = last.join(step, F.col("name") == F.col("src")).groupBy(F.col("dst").alias("name")).agg(*[F.sum(F.col("s") * F.get("b", F.lit(i))).alias(f"z{i}") for i in range(k)])
            w = F.array(*[(F.get("v", F.lit(held - k + i)) + F.col(f"z{i}")) / 2 for i in range(k)])
            rows = _cut(basis.join(flow, "name").select("name", "v", w.alias("w")))
            q, h, r = _orthogonal(rows, held, k)
            t[:held, held - k : held] = h
            if j < depth:
                t[held : held + k, held - k : held] = r
                new = _cut(q.select("name", F.concat("v", "w").alias("v")))
                drop(rows, *([basis] if j > 1 else []))
                basis = new
        _, vectors = np.linalg.eigh((t + t.T) / 2)
        best = vectors[:, ::-1][:, :k]
        new = _cut(_mapped(basis.select("name", "v", none.alias("w")), lambda v: v @ best, ("v",)).select("name", "w"))
        drop(found, basis, rows)
        found = new
        if np.linalg.norm(r @ best[-k:, :asked]) <= tolerance:
            break
    return found.select("name", F.slice("w", 1, asked).alias("w"))


def spectral(nodes: DataFrame, edges: DataFrame, k: int = 5, seed: int = 42, tolerance: float = 1e-4, most: int = 15) -> DataFrame:
    """Spectral clustering of the weighted adjacency, the same at every size: ``spectral_vectors``, then distributed k-means on the rows, each normed
    to length 1 (Ng, Jordan and Weiss 2002). Where the spectrum has no gap after the k-th value, vectors are taken as they are after *most* restarts.

    Partitions of linked nodes are numbered by size, then least name; where there are nodes without links, those are one of the *k* partitions, the last.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ends = edges.where("src <> dst AND weight > 0").select(F.explode(F.array("src", "dst")).alias("name"))
    if not nodes.select("name").join(ends, "name", "left_anti").isEmpty():
        k = max(1, k - 1)
    vectors = spectral_vectors(edges, k, tolerance=tolerance, most=most)
    linked = vectors.count()
    if linked > k:
        length = F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x))
        unit = F.transform("w", lambda x: F.when(length > 0, x / length).otherwise(0.0))
        rows = _cut(vectors.select("name", unit.alias("w")).orderBy("name")).select("name", array_to_vector("w").alias("features"))
        label = KMeans(k=k, seed=seed, maxIter=100).fit(rows).transform(rows).select("name", F.col("prediction").alias("c"))
    else:
        label = vectors.select("name", F.col("name").alias("c"))
    label = _cut(label)
    sizes = label.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("least")).orderBy(F.desc("n"), "least").collect()  # k rows
    order = nodes.sparkSession.createDataFrame([(r.c, i) for i, r in enumerate(sizes)], label.select("c", F.lit(0).cast("long").alias("partition_id")).schema)
    placed = label.join(F.broadcast(order), "c")  # k rows
    return nodes.select("name").join(placed, "name", "left").select("name", F.coalesce("partition_id", F.lit(len(sizes))).cast("long").alias("partition_id"))


def partition(nodes: DataFrame, edges: DataFrame, method: str = "louvain", **options) -> DataFrame:
    work = {"louvain": louvain, "kmeans": kmeans, "spectral": spectral}
    if method not in work:
        raise ValueError(f"unknown partition method: {method}")
    return work[method](nodes, edges, **options)


def partition_of(parts: DataFrame, name: str) -> DataFrame:
    """(partition_id, size) of the partition of one node."""
    own = parts.where(F.col("name") == name).select("partition_id")
    return parts.join(own, "partition_id", "left_semi").groupBy("partition_id").agg(F.count(F.lit(1)).alias("size"))


def _placed(edges: DataFrame, parts: DataFrame) -> DataFrame:
    # A row a node stands on one side: by the size of its files it would be broadcast, which takes every task gigabytes as tables grow.
    a = parts.select(F.col("name").alias("src"), F.col("partition_id").alias("pa")).hint("merge")
    b = parts.select(F.col("name").alias("dst"), F.col("partition_id").alias("pb")).hint("merge")
    return edges.join(a, "src").join(b, "dst")


def _between(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(pa, pb, weight, n): the edges from partition to partition, summed in the one pass that joins them."""
    return _cut(_placed(edges, parts).groupBy("pa", "pb").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")), rows=edges.count())


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: Newman's weighted modularity, sum of in/2m - (tot/2m)^2."""
    placed = _between(edges, parts)
    inside = placed.where("pa = pb").groupBy(F.col("pa").alias("p")).agg(F.sum(2 * F.col("weight")).alias("in"))
    tot = placed.select(F.explode(F.array("pa", "pb")).alias("p"), "weight").groupBy("p").agg(F.sum("weight").alias("tot"))
    m2 = edges.agg((2 * F.sum("weight")).alias("m2"))
    per = tot.join(inside, "p", "left").join(F.broadcast(m2))  # one row of totals
    return per.agg(F.sum(F.coalesce("in", F.lit(0.0)) / F.col("m2") - F.pow(F.col("tot") / F.col("m2"), 2)).alias("modularity"))


def partition_stats(edges: DataFrame, parts: DataFrame) -> DataFrame:
    sizes = parts.groupBy("partition_id").agg(F.count(F.lit(1)).alias("size"))
    stats = sizes.agg(F.count(F.lit(1)).alias("partitions"), F.avg("size").alias("mean_size"), F.max("size").alias("largest"), F.min("size").alias("smallest"))
    return stats.join(F.broadcast(modularity(edges, parts)))  # one row each


def community_stats(nodes: DataFrame, edges: DataFrame, parts: DataFrame, top: int = 3) -> DataFrame:
    """Per community, largest first: size, inner edges, density, type counts, best nodes by degree. *nodes* has name and type."""
    placed = _between(edges, parts)
    size = parts.groupBy("partition_id").agg(F.count(F.lit(1)).alias("size"))
    inner = placed.where("pa = pb").groupBy(F.col("pa").alias("partition_id")).agg(F.sum("n").alias("inner_edges"))
    kinds = parts.join(nodes.select("name", "type"), "name").groupBy("partition_id", "type").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("partition_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("types"))
    degree = _cut(edges.select(F.explode(F.array("src", "dst")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("d")), rows=2 * edges.count())
    best = top_per(parts.join(degree, "name", "left").na.fill(0, ["d"]), ["partition_id"], top, F.desc("d"), F.asc("name"))
    best = best.groupBy("partition_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("d")).alias("o"), "name"))), lambda x: x["name"]).alias("key_nodes"))
    n, m = F.col("size"), F.coalesce("inner_edges", F.lit(0))
    out = size.join(inner, "partition_id", "left").join(kinds, "partition_id", "left").join(best, "partition_id", "left")
    return out.select("partition_id", "size", m.alias("inner_edges"), F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density"), "types", "key_nodes").orderBy(F.desc("size"), "partition_id")


def compress(edges: DataFrame, ratio: float = 0.5) -> tuple[DataFrame, float]:
    """The int(E x ratio) heaviest edges, and 1 - kept / all."""
    total = edges.count()
    keep = int(total * ratio)
    return edges.orderBy(F.desc("weight"), "src", "dst").limit(keep), (1 - keep / total if total else 0.0)


def meta_graph(edges: DataFrame, parts: DataFrame, drop_zero: bool = False) -> tuple[DataFrame, DataFrame]:
    """Super-nodes (partition_id, size) and super-edges (a, b, weight) between different partitions.

    *drop_zero* keeps an old fault that loses the edges of partition 0.
    """
    nodes = parts.groupBy("partition_id").agg(F.count(F.lit(1)).alias("size"))
    placed = _between(edges, parts).where("pa <> pb")
    if drop_zero:
        placed = placed.where("pa <> 0 AND pb <> 0")
    return nodes, placed.groupBy(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).agg(F.sum("weight").alias("weight"))
