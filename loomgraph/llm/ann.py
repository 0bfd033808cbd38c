"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

The trees are fitted on a bounded sample, a share of the distinct vectors, so that leaves keep their size while the table grows up to
``SHARE * MOST / width`` vectors (a million of 64 components); every row is then placed in its leaf of each tree. A node splits its points
at the median of their projections on the difference of two points drawn at random. Inner products become angles by one
more coordinate that lifts every vector to the largest norm. A query walks all trees through one priority queue, ordered by the
squared margins that a path has crossed on the wrong side, until the leaves it has taken hold a budget of vectors; their members are ranked
again by the exact inner product, in double precision, on the original vectors.

The budget is what the data ask for: a bounded number of queries is answered exactly in one pass over all rows, and the budget is the
smallest at which the forest finds ``TARGET`` of their true neighbours. Clustered vectors need a small part of the
table; for vectors without any structure no index does with little, and the budget follows the table.

Neighbouring leaves of a tree are put together in cells of bounded size, leaves beyond that are cut into several. A vector is sent once a tree,
to its cell; a query is sent once to each cell in which it takes leaves, with their numbers; cells that many queries take are
searched by a bounded number of queries at a time. Only a query's best of a cell leave it.

Copies of a vector are one class, of which the TOP + 1 smallest ids are enough; so a group of copies costs one vector
to place and one query to search, however large it is.

Defined results: vectors that are null or zero, hold null or non-finite components, or have no id
take no part; shorter vectors count as if zeros followed, up to the longest; repeated rows count once, and of an id with several
vectors each is a candidate and the best counts; ties go to the smaller id; with fewer candidates than asked for all
are returned; an empty table gives no rows; columns other than ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, stage

TOP, EVERY = 20, 20
#: Trees, fewest sample points of a leaf.
TREES, NODE = 4, 32
#: About how many distinct vectors the trees are fitted on: one in SHARE, up to MOST components together, but no fewer than SAMPLE (all, if fewer).
SAMPLE, MOST, SHARE = 16_384, 1 << 24, 4
#: The recall that sets how many vectors a query takes; queries to set it by.
TARGET, TRIED = 0.96, 64
#: Most vectors of a cell; most queries that search a copy of a cell.
CELL, QUERIES = 16_384, 16_384


@dataclass
class Tree:
    """Nodes in arrays; a child below 0 is leaf -child-1."""

    normal: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int


def grow(points: np.ndarray, rng: np.random.Generator, node: int = NODE) -> Tree:
    normals, cuts, kids = [], [], []
    leaves = 0

    def build(rows: np.ndarray) -> int:
        nonlocal leaves
        for _ in range(4):
            if len(rows) < 2 * node:
                break
            a, b = points[rng.choice(rows, 2, replace=False)]
            normal = a - b
            at = points[rows] @ normal
            cut = float(np.median(at))
            side = at > cut
            if 0.2 < side.mean() < 0.8:
                k = len(normals)
                normals.append(normal / np.linalg.norm(normal))
                cuts.append(cut / np.linalg.norm(normal))
                kids.append([0, 0])
                kids[k] = [build(rows[~side]), build(rows[side])]
                return k
        leaves += 1
        return -leaves

    build(np.arange(len(points)))
    width = points.shape[1]
    kid = np.array(kids, np.int64).reshape(-1, 2)
    return Tree(np.array(normals, np.float64).reshape(-1, width), np.array(cuts), kid[:, 0], kid[:, 1], leaves)


def sample_size(distinct: int, width: int) -> int:
    """About how many of so many distinct vectors of a width the trees are fitted on."""
    return max(SAMPLE, min(distinct // SHARE, MOST // width))


def leaf_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    if not len(tree.cut):
        return np.zeros(len(points), np.int64)
    at = np.zeros(len(points), np.int64)
    while (live := np.flatnonzero(at >= 0)).size:
        n = at[live]
        right = (points[live] * tree.normal[n]).sum(axis=1) > tree.cut[n]
        at[live] = np.where(right, tree.right[n], tree.left[n])
    return -at - 1


def walk(forest: list[Tree], query: np.ndarray) -> Iterator[tuple[int, int]]:
    """(tree, leaf) in the order of one queue over all trees."""
    queue = [(0.0, t, 0 if len(tree.cut) else -1) for t, tree in enumerate(forest)]
    margins = [tree.normal @ query - tree.cut if len(tree.cut) else None for tree in forest]
    heapq.heapify(queue)
    while queue:
        crossed, t, n = heapq.heappop(queue)
        if n < 0:
            yield t, -n - 1
            continue
        m, tree = float(margins[t][n]), forest[t]
        near, far = (tree.right[n], tree.left[n]) if m > 0 else (tree.left[n], tree.right[n])
        heapq.heappush(queue, (crossed, t, int(near)))
        heapq.heappush(queue, (crossed + m * m, t, int(far)))


def visit(forest: list[Tree], sizes: list[np.ndarray], query: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """The leaves that a query takes until they hold *budget* vectors."""
    taken, found = [], 0
    for t, leaf in walk(forest, query):
        taken.append((t, leaf))
        found += int(sizes[t][leaf])
        if found >= budget:
            break
    return taken


def needed(forest: list[Tree], sizes: list[np.ndarray], query: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """The budget at which each of the neighbours is first met."""
    home = np.stack([leaf_of(tree, neighbours) for tree in forest])
    out, held = np.full(len(neighbours), np.inf), 0
    for t, leaf in walk(forest, query):
        held += int(sizes[t][leaf])
        out[(home[t] == leaf) & np.isinf(out)] = held
        if not np.isinf(out).any():
            break
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _kind(vectors: DataFrame) -> str:
    return "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"


def clean(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``v`` (the vector; floats stay floats), ``h1``, ``h2`` (128 bits that name its class)."""
    x = F.col("v")
    kind = _kind(vectors)
    fine = x.isNotNull() & F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False)) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>").alias("v")).where("vec_id IS NOT NULL").where(fine)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    whole = F.when(F.size("v") < width, F.concat("v", F.array_repeat(F.lit(0.0).cast(kind), F.lit(width) - F.size("v")))).otherwise(x)
    return rows.withColumn("v", whole).withColumns({"h1": F.xxhash64(F.lit(1), "v"), "h2": F.xxhash64(F.lit(2), "v")})


def exact_neighbours(classes: DataFrame, queries: np.ndarray, top: int, width: int) -> list[tuple[int, list[float]]]:
    """(query number, vector) of the *top* nearest classes to each of a few queries, in one pass over all classes."""
    shared = classes.sparkSession.sparkContext.broadcast(queries)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), width)
            score = shared.value @ x.T
            k = min(top, len(x))
            near = np.argpartition(-score, k - 1, axis=1)[:, :k]
            at = np.repeat(np.arange(len(score)), k)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(score[at, near.ravel()]), b.column(0).take(pa.array(near.ravel()))], names=["i", "score", "v"])

    kind = classes.schema["v"].dataType.simpleString()
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score")))
    found = classes.select("v").mapInArrow(best, f"i int, score double, v {kind}").withColumn("r", rank).where(F.col("r") <= top)
    return [(r.i, r.v) for r in found.select("i", "v").collect()]  # at most TRIED x top vectors


class Cells:
    """Where the leaves of a forest are: cells of up to ``CELL`` vectors, numbered over all trees.

    A run of neighbouring leaves shares a cell; a leaf with more vectors has several cells of its own.
    """

    def __init__(self, sizes: list[np.ndarray]):
        self.sizes, self.first, self.parts, n = sizes, [], [], 0
        for own in sizes:
            first, parts, held = np.zeros(len(own), np.int64), np.ones(len(own), np.int64), CELL + 1
            for leaf, size in enumerate(own):
                if held + size > CELL:
                    n, held = n + 1, 0
                first[leaf], held = n - 1, held + size
                if size > CELL:
                    parts[leaf] = -(-size // CELL)
                    n, held = n + int(parts[leaf]) - 1, CELL + 1
            self.first.append(first)
            self.parts.append(parts)


def _best(at: np.ndarray, hit: np.ndarray, score: np.ndarray, least: np.ndarray, top: int) -> np.ndarray:
    """Places of the *top* best of each ``at``: largest score first, ties to the smallest ``least``."""
    order = np.lexsort((least[hit], -score, at))
    at = at[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
    rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
    return order[rank < top]


def search_cell(queries: np.ndarray, taken: list[np.ndarray], vectors: np.ndarray, leaf: np.ndarray, least: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's *top* best among the vectors of the leaves that it takes in one cell."""
    order = np.argsort(leaf, kind="stable")
    names, starts = np.unique(leaf[order], return_index=True)
    ends = np.r_[starts[1:], len(order)]
    who = np.repeat(np.arange(len(taken)), [len(t) for t in taken])
    what = np.concatenate(taken)
    by_leaf = np.argsort(what, kind="stable")
    who, what = who[by_leaf], what[by_leaf]
    # Rounding of the matrix product, which only chooses what is summed exactly.
    slack = 1e-12 * max(1e-300, float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1])
    floor = np.full(len(queries), -np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for name, lo, hi in zip(names, starts, ends):
        mine = who[np.searchsorted(what, name, "left") : np.searchsorted(what, name, "right")]
        members = order[lo:hi]
        x = vectors[members].T
        for k in range(0, len(mine), 512):
            some = mine[k : k + 512]
            near = queries[some] @ x
            if near.shape[1] > top:
                floor[some] = np.maximum(floor[some], np.partition(near, -top, axis=1)[:, -top] - slack)
            at, hit = np.nonzero(near >= floor[some][:, None])
            found.append((some[at], members[hit], near[at, hit]))
    at, hit, near = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    keep = near >= floor[at]
    at, hit, near = at[keep], hit[keep], near[keep]
    first = _best(at, hit, near, least, top)
    if len(first):  # whatever may tie with the last of them is summed exactly as well
        last = np.full(len(queries), np.inf)
        np.minimum.at(last, at[first], near[first])
        full = np.bincount(at[first], minlength=len(queries)) >= top
        keep = near >= np.where(full, last - 2 * slack, -np.inf)[at]
        at, hit = at[keep], hit[keep]
    score = np.empty(len(at))
    for k in range(0, len(at), 1 << 14):  # component after component, as SQL sums
        score[k : k + (1 << 14)] = (queries[at[k : k + (1 << 14)]] * vectors[hit[k : k + (1 << 14)]]).cumsum(axis=1)[:, -1]
    best = _best(at, hit, score, least, top)
    return at[best], hit[best], score[best]


def search(vectors: DataFrame, top: int = TOP, every: int = EVERY, budget: int | None = None, sample: int | None = None, trees: int = TREES, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the *top* nearest found for each row whose id *every* divides."""
    spark = vectors.sparkSession
    kind = f"array<{_kind(vectors)}>"
    rows = stage(clean(vectors), "vectors")
    stats = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)).alias("norm"), F.first(F.size("v")).alias("width")).first()
    if stats.norm is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, norm = stats.width, stats.norm

    # Classes of several rows with their smallest ids; only these rows' ids are ever shuffled, not the vectors.
    first = Window.partitionBy("h1", "h2").orderBy("vec_id")
    names = rows.select("h1", "h2", "vec_id")
    several = names.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    few = names.join(several, ["h1", "h2"], "left_semi").withColumn("__r", F.dense_rank().over(first)).where(F.col("__r") <= top + 1)
    copies = stage(few.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "copies")
    least = copies.select("h1", "h2", F.element_at("ids", 1).alias("least"))
    if not copies.isEmpty():  # one row a class; rows that repeat an id are told apart by nothing, so any one of them
        single = rows.join(least, ["h1", "h2"], "left_anti")
        reps = rows.join(least, ["h1", "h2"]).where("vec_id = least").drop("least").dropDuplicates(["h1", "h2"])
        classes = stage(single.select("vec_id", "v", "h1", "h2").unionByName(reps.select("vec_id", "v", "h1", "h2")), "classes")
    else:
        classes = rows

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(norm - (x * x).sum(axis=1), 0))[:, None]])

    fitted = bounded_sample(classes.select("h1", "v"), sample or sample_size(classes.count(), width), seed, key="h1").toArrow().sort_by("h1")
    points = lifted(_matrix(fitted["v"].combine_chunks(), width))
    forest = [grow(points, np.random.Generator(np.random.Philox(key=[seed, t]))) for t in range(trees)]
    grown = spark.sparkContext.broadcast(forest)  # at most trees x sample / NODE nodes

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [np.zeros(t.leaves, np.int64) for t in grown.value]
        for b in batches:
            x = lifted(_matrix(b.column(0), width))
            for n, tree in zip(sizes, grown.value):
                n += np.bincount(leaf_of(tree, x), minlength=tree.leaves)
        for t, n in enumerate(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t, np.int32)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["tree", "leaf", "n"])

    sizes = [np.zeros(t.leaves, np.int64) for t in forest]
    for r in classes.select("v").mapInArrow(counted, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():  # one number a leaf
        sizes[r.tree][r.leaf] = r.n
    cells = spark.sparkContext.broadcast(Cells(sizes))

    asked = rows.where(F.col("vec_id") % every == 0)
    queries = stage(asked.groupBy("h1", "h2").agg(F.first("v").alias("v")), "queries")
    if budget is None:
        tried = np.array([r.v for r in queries.orderBy(F.xxhash64(F.lit(seed), "h1", "h2"), "h1", "h2").limit(TRIED).collect()], np.float64).reshape(-1, width)
        budget, near = 1, {}
        for i, v in exact_neighbours(classes, tried, top + 1, width) if len(tried) else []:
            if not np.array_equal(np.array(v, np.float64), tried[i]):
                near.setdefault(i, []).append(v)
        if near:
            at = np.concatenate([needed(forest, sizes, np.append(tried[i], 0.0), lifted(np.array(v, np.float64))) for i, v in near.items()])
            budget = int(np.quantile(at, TARGET, method="higher"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, h = lifted(_matrix(b.column(1), width)), b.column(2).to_numpy()
            for t, tree in enumerate(grown.value):
                leaf = leaf_of(tree, x)
                cell = cells.value.first[t][leaf] + h % cells.value.parts[t][leaf]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(leaf.astype(np.int32)), *b.columns], names=["cell", "leaf", "least", "v", "h1", "h2"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = cells.value
        for b in batches:
            x = np.hstack([_matrix(b.column(2), width), np.zeros((b.num_rows, 1))])
            at, cell, leaves = [], [], []
            for i, q in enumerate(x):
                taken: dict[int, list[int]] = {}
                for t, leaf in visit(grown.value, where.sizes, q, budget):
                    for c in range(where.first[t][leaf], where.first[t][leaf] + where.parts[t][leaf]):
                        taken.setdefault(c, []).append(leaf)
                at += [i] * len(taken)
                cell += taken.keys()
                leaves += taken.values()
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(leaves, pa.list_(pa.int32())), *[c.take(pa.array(at, pa.int64())) for c in b.columns]], names=["cell", "leaves", "q1", "q2", "v"])

    visits = stage(queries.select("h1", "h2", "v").mapInArrow(routed, f"cell long, leaves array<int>, q1 long, q2 long, v {kind}"), "visits")
    busy = stage(visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).cast("int").alias("copies")), "cells")  # one number a cell
    visits = visits.join(busy, "cell").withColumn("copy", F.pmod(F.xxhash64("q1", "q2"), F.col("copies")).cast("int")).drop("copies")
    index = classes.select("vec_id", "v", "h1", "h2").mapInArrow(placed, f"cell long, leaf int, least long, v {kind}, h1 long, h2 long")
    index = index.join(busy, "cell").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")

    def ranked(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        q, x = _matrix(left["v"].combine_chunks(), width), _matrix(right["v"].combine_chunks(), width)
        lists = left["leaves"].combine_chunks()
        taken = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
        at, hit, score = search_cell(q, taken, x, right["leaf"].to_numpy(), right["least"].to_numpy(), top + 1)
        at, hit = pa.array(at), pa.array(hit)
        return pa.table([left["q1"].take(at), left["q2"].take(at), right["h1"].take(hit), right["h2"].take(hit), right["least"].take(hit), pa.array(score)], schema=_FOUND)

    keys = ["cell", "copy"]
    found = visits.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(ranked, "q1 long, q2 long, h1 long, h2 long, vec_id long, score double")
    found = found.groupBy("q1", "q2", "h1", "h2", "vec_id").agg(F.max("score").alias("score"))
    by_query = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("__r", F.row_number().over(by_query)).where(F.col("__r") <= top + 1)
    ids = best.join(copies, ["h1", "h2"], "left").select("q1", "q2", "score", F.explode(F.coalesce("ids", F.array("vec_id"))).alias("vec_id"))
    ids = ids.groupBy("q1", "q2", "vec_id").agg(F.max("score").alias("score")).withColumn("__r", F.row_number().over(by_query)).where(F.col("__r") <= top + 1)
    lists = ids.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("__r", "vec_id", "score"))).alias("near"))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).distinct()
    own = F.filter("near", lambda x: x.vec_id != F.col("query_id"))
    per = asked.join(lists, ["q1", "q2"]).select("query_id", F.posexplode(F.slice(own, 1, top)).alias("p", "n"))
    return per.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))


_FOUND = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def brute_force(ids: np.ndarray, vectors: np.ndarray, top: int = TOP, every: int = EVERY) -> dict[int, list[int]]:
    """The exact answer, to measure recall against."""
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = vectors @ vectors[i]
        score[i] = -np.inf
        order = np.lexsort((ids, -score))[: min(top, len(ids) - 1)]
        out[int(ids[i])] = ids[order].tolist()
    return out
