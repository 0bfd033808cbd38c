"""Centralities on ``nodes(name)`` and ``edges(src, dst)``: joins and aggregations in loops whose tables are written and dropped round by round."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import top_per
from .paths import BYTES, ROWS, _cut, drop, settings

MEASURES = ("degree", "betweenness", "closeness", "pagerank", "eigenvector")
#: Rows (source, node) that the searches of one batch of sources hold together.
STATES = 200_000_000
#: Ends of edges in one list.
LIST = 1000
#: Edges in a block of sketches that are united in one task, and sketches that a task unites in memory; more are sorted.
BLOCK, HELD = 100_000, 50_000
#: Bytes of sketches that a round may deal out at any size, bytes an edge beyond that, and the fewest bits of a part's sketches.
SKETCHES, SHARE, LEAST = 1 << 30, 12, 4


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(in + out) / (n - 1)."""
    n = nodes.count()
    ends = _cut(edges.select(F.explode(F.array("src", "dst")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("d")), rows=2 * edges.count())
    return nodes.select("name").join(ends, "name", "left").select("name", (F.coalesce("d", F.lit(0)) / max(n - 1, 1)).alias("score"))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, iterations: int | None = None) -> DataFrame:
    """Power iteration with uniform teleport and dangling mass; stops when the L1 change is below n x tolerance, or after *iterations*."""
    n, rows = nodes.count(), edges.count()
    out = edges.groupBy(F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("out"))
    # A node's row holds its number of out-edges, so that no round counts edges again.
    rank = _cut(nodes.select("name", F.lit(1.0 / n).alias("score")).join(out, "name", "left").select("name", "score", "out"), rows=rows)
    # Out-edges in lists of about LIST ends: rounds deal a row a list, not a row an edge.
    lists = ceil((rank.agg(F.max("out")).first()[0] or 1) / LIST)
    step = _cut(edges.groupBy("src", F.pmod(F.xxhash64("dst"), F.lit(lists)).alias("__list")).agg(F.collect_list("dst").alias("to")).select("src", "to"), rows=rows)
    for _ in range(iterations if iterations is not None else rounds):
        dangling = rank.where("out IS NULL").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        shares = rank.where("out IS NOT NULL").select(F.col("name").alias("src"), (F.col("score") / F.col("out")).alias("share"))
        flow = shares.join(step.hint("merge"), "src").select(F.explode("to").alias("name"), "share").groupBy("name").agg(F.sum("share").alias("in"))
        new = _cut(rank.join(flow, "name", "left").select("name", F.col("score").alias("old"), ((1 - alpha) / n + alpha * (F.coalesce("in", F.lit(0.0)) + dangling / n)).alias("score"), "out"), rows=rows)
        drop(rank)
        rank = new.drop("old")
        if iterations is None and new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] < n * tolerance:
            break
    drop(step)
    return rank.select("name", "score")


def eigenvector(nodes: DataFrame, edges: DataFrame, tolerance: float = 1e-6, rounds: int = 1000, iterations: int | None = None) -> DataFrame:
    """Power iteration of (A + I) over in-edges, normed to length 1; all 0 if it does not converge."""
    n = nodes.count()
    step = edges.select("src", "dst")
    score = _cut(nodes.select("name", F.lit(1.0 / n).alias("score")))
    for _ in range(iterations if iterations is not None else rounds):
        flow = score.join(step, score.name == step.src).groupBy(F.col("dst").alias("name")).agg(F.sum("score").alias("in"))
        raw = _cut(score.join(flow, "name", "left").select("name", F.col("score").alias("old"), (F.col("score") + F.coalesce("in", F.lit(0.0))).alias("new")))
        norm = raw.agg(F.sqrt(F.sum(F.col("new") * F.col("new")))).first()[0] or 1.0
        moved = raw.agg(F.sum(F.abs(F.col("new") / norm - F.col("old")))).first()[0]
        drop(score)
        score = raw.select("name", (F.col("new") / norm).alias("score"))
        if iterations is None and moved < n * tolerance:
            return score
    return score if iterations is not None else nodes.select("name", F.lit(0.0).alias("score"))


def _sources(nodes: DataFrame, count: int | None, seed: int = 42) -> DataFrame:
    names = nodes.select("name")
    return names if count is None else names.orderBy(F.xxhash64(F.lit(seed), "name"), "name").limit(count)


def _batches(sources: DataFrame, n: int) -> Iterator[DataFrame]:
    """The sources in runs whose searches hold about ``STATES`` rows (source, node) together."""
    runs = max(1, ceil(sources.count() * n / STATES))
    dealt = _cut(sources.select("name", F.pmod(F.xxhash64("name"), F.lit(runs)).alias("run")))
    for i in range(runs):
        yield dealt.where(F.col("run") == i).select("name")
    drop(dealt)


def _levels(sources: DataFrame, step: DataFrame) -> list[DataFrame]:
    """Breadth-first search from all sources at once: a written table (source, node, ways) for each distance, ways being the number of shortest paths."""
    levels = [_cut(sources.select(F.col("name").alias("source"), F.col("name").alias("node"), F.lit(1.0).alias("ways")))]
    while True:
        reached = levels[-1].join(step, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("ways").alias("ways"))
        seen = reduce(DataFrame.unionByName, levels).select("source", "node")
        front = _cut(reached.join(seen, ["source", "node"], "left_anti"))
        if front.isEmpty():
            drop(front)
            return levels
        levels.append(front)


def closeness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Inward: (reachable / total distance) x (reachable / (n - 1)) over the nodes that reach a node; 0 if none does.

    Exact, by a search from every node: n^2 rows (source, node) on a connected graph, in batches of ``STATES``. ``closeness_sketched`` needs n sketches.
    """
    n = nodes.count()
    step = _cut(edges.select("src", "dst").distinct())
    sums = None
    for sources in _batches(nodes.select("name"), n):
        levels = _levels(sources, step)
        found = reduce(DataFrame.unionByName, [lv.groupBy("node").agg(F.count(F.lit(1)).alias("c")).select("node", "c", (F.col("c") * d).alias("far")) for d, lv in enumerate(levels)])
        now = found if sums is None else found.unionByName(sums)
        sums = _cut(now.groupBy("node").agg(F.sum("c").alias("c"), F.sum("far").alias("far")), sums)
        drop(*levels)
    reach = F.col("c") - 1
    score = F.when(F.col("far") > 0, reach / F.col("far") * (reach / (n - 1))).otherwise(F.lit(0.0))
    return nodes.select("name").join(sums.withColumnRenamed("node", "name"), "name", "left").select("name", F.coalesce(score, F.lit(0.0)).alias("score"))


def _dealt(step: DataFrame, rows: int) -> DataFrame:
    """Edges in blocks of about ``BLOCK``, as (block, src, to), a row a block and source: a block has all edges of its nodes with the end of more edges.

    A source is then sent once a block, not once an edge. Ends of few edges that hang together share blocks, by a label: the least name that their ends
    of many edges see two steps away. The label says only where an edge lies, not what comes out. Both directions of a pair are one row until the last
    table, and no table is made by more than two shuffles of pairs.
    """
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    pairs = _cut(step.groupBy(a, b).agg(F.bit_or(F.when(F.col("src") < F.col("dst"), 1).otherwise(2)).alias("way")), rows=rows)  # 1: out of a, 2: into it
    ends = _cut(pairs.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("d")), rows=rows)
    left, right = ends.select(F.col("name").alias("a"), F.col("d").alias("da")), ends.select(F.col("name").alias("b"), F.col("d").alias("db"))
    pairs = _cut(pairs.join(left.hint("merge"), "a"), pairs, rows=rows)
    first = F.struct("da", "a") < F.struct("db", "b")  # a is the end of fewer edges
    way = F.when(first | (F.col("way") == 3), F.col("way")).otherwise(3 - F.col("way")).alias("way")
    pairs = _cut(pairs.join(right.hint("merge"), "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("high"), way), pairs, rows=rows)
    drop(ends)
    lists = [F.collect_list(F.when(F.col("way") == i, F.col("high"))).alias(name) for i, name in ((1, "out"), (2, "into"), (3, "both"))]
    lows = _cut(pairs.groupBy("low").agg(*lists), pairs, rows=rows)  # a node has 2 x sqrt(edges) ends of more edges at most
    highs = F.concat("out", "into", "both")
    first = F.array_min(highs).alias("first")
    sees = lows.select(first, F.explode(highs).alias("high")).groupBy("high").agg(F.min("first").alias("label")).withColumnRenamed("high", "first")
    named = _cut(lows.select("low", first, F.size(highs).alias("d")).join(sees.hint("merge"), "first").select("low", "label", "d"), rows=rows)
    parts = named.groupBy("label").agg(F.ceil(F.sum("d") / BLOCK).alias("parts"))
    homes = named.join(parts.hint("merge"), "label").select("low", F.xxhash64("label", F.pmod(F.xxhash64("low"), "parts")).alias("block"))
    placed = lows.join(homes.hint("merge"), "low").repartition("block")  # lists are dealt out, and taken apart where they lie
    there = F.transform(F.concat("out", "both"), lambda x: F.struct(F.col("low").alias("src"), x.alias("dst")))
    back = F.transform(F.concat("into", "both"), lambda x: F.struct(x.alias("src"), F.col("low").alias("dst")))
    long = placed.select("block", F.explode(F.concat(there, back)).alias("e")).select("block", "e.src", "e.dst")
    dealt = _cut(long.groupBy("block", "src").agg(F.collect_list("dst").alias("to")), lows, rows=rows)
    drop(named)
    return dealt


def _numbered(nodes: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """(id, name) of all nodes, and the ids of a column: 64 bits of a hash under the first seed that tells all names apart."""
    for seed in count():
        number = lambda name, seed=seed: F.xxhash64(F.lit(seed), name)
        known = _cut(nodes.select("name").distinct().select(number("name").alias("id"), "name"), rows=nodes.count())
        if known.groupBy("id").count().where("count > 1").isEmpty():
            return known, number
        drop(known)


def closeness_sketched(nodes: DataFrame, edges: DataFrame, bits: int = 12) -> DataFrame:
    """Closeness by distinct-count sketches of the nodes that reach a node within 1, 2, ... steps (Boldi and Vigna 2013).

    A round sends each sketch that changed to the blocks of its node's out-edges and unites there, then a node's from all blocks. Work is edges x sketch (2^bits
    bytes) x diameter; what is dealt out is (nodes + their copies in blocks) x sketch a round, never more than a sketch an edge. The relative standard error of a
    count is about 1.04 / sqrt(2^bits), 1.6 % with 12 bits; small sets are counted exactly.

    Where that is more than ``SKETCHES`` bytes and ``SHARE`` bytes an edge, the nodes that reach others are split by a hash into 2, 4, ... parts, whose sets are counted one part after the other
    with as many times fewer registers and then added: all nodes still count, the registers of a node together are 2^bits as before, and so is the error.
    """
    n, spark = nodes.count(), nodes.sparkSession
    m = edges.count()
    known, number = _numbered(nodes)
    step = _dealt(edges.where("src <> dst").select(number("src").alias("src"), number("dst").alias("dst")), m)
    less = min(ceil(log2(max(((n + step.count()) << bits) / max(SKETCHES, SHARE * m), 1))), bits - LEAST)
    width, parts = bits - less, 2**less
    # Sketches are wide: a task has about BYTES of them.
    rows = max(m, n * ceil((2**width + 64) * ROWS / BYTES))
    # Both sides of a block meet in its task, whatever else they are joined by, and are united in memory before anything is dealt out by node.
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(HELD), "spark.sql.parquet.compression.codec": "zstd"}
    with settings(spark, wanted):
        places = step.groupBy(F.col("src").alias("id")).agg(F.collect_list("block").alias("blocks"))
        alone = known.groupBy("id").agg(F.hll_sketch_agg("name", width).alias("alone"))
        none = F.lit(0).cast("long")
        state = _cut(alone.join(places.hint("merge"), "id", "left").select("id", "blocks", "alone", none.alias("all"), none.alias("far")), rows=rows)
        for part in range(parts):
            own = F.pmod(F.xxhash64("id"), F.lit(parts)) == part
            state = state.select("id", "blocks", "alone", F.when(own, F.col("alone")).alias("s"), own.cast("long").alias("c"), "all", "far", own.alias("fresh"))
            d = 0
            while not state.where("fresh").isEmpty():
                d += 1
                copies = state.where("fresh").select(F.explode("blocks").alias("block"), F.col("id").alias("src"), "s").repartition("block")
                sent = copies.join(step.repartition("block").hint("merge"), ["block", "src"]).select(F.explode("to").alias("id"), "s")
                united = sent.groupBy("id").agg(F.hll_union_agg("s").alias("got"))
                now = F.coalesce(F.hll_union("s", "got"), "got", "s")  # the one of both that there is, or both
                found = state.join(united.hint("merge"), "id", "left").withColumn("now", now)
                found = found.withColumn("new", F.greatest("c", F.hll_sketch_estimate("now")))
                far = F.col("far") + d * (F.col("new") - F.col("c"))
                state = _cut(found.select("id", "blocks", "alone", F.col("now").alias("s"), F.col("new").alias("c"), "all", far.alias("far"), (~F.col("now").eqNullSafe(F.col("s"))).alias("fresh")), state, rows=rows)
            state = state.withColumn("all", F.col("all") + F.col("c"))
    drop(step)
    reach = F.col("all") - 1
    score = F.when(F.col("far") > 0, reach / F.col("far") * (reach / (n - 1))).otherwise(F.lit(0.0))
    return known.join(state.hint("merge"), "id").select("name", score.alias("score"))


def betweenness(nodes: DataFrame, edges: DataFrame, sample: int | None = None) -> DataFrame:
    """Directed, unweighted, over (n - 1)(n - 2); with *sample*, scaled from that many sources.

    Brandes (2001) as joins: searches from a batch of sources level by level, then credit passed back from the last level to the first.
    No task holds the graph; a batch holds about ``STATES`` rows (source, node).
    """
    n = nodes.count()
    step = _cut(edges.select("src", "dst").where("src <> dst").distinct())
    total = None
    for sources in _batches(_sources(nodes, sample), n):
        levels = _levels(sources, step)
        credit, parts = None, []
        for level in reversed(levels):
            own = level.withColumn("credit", F.lit(0.0))
            if credit is not None:
                later = credit.select("source", F.col("node").alias("dst"), F.col("ways").alias("later_ways"), F.col("credit").alias("later"))
                back = step.join(later, "dst").join(level.select("source", F.col("node").alias("src"), "ways"), ["source", "src"])
                back = back.groupBy("source", F.col("src").alias("node")).agg(F.sum(F.col("ways") / F.col("later_ways") * (1 + F.col("later"))).alias("credit"))
                own = level.join(back, ["source", "node"], "left").select("source", "node", "ways", F.coalesce("credit", F.lit(0.0)).alias("credit"))
            credit = _cut(own)
            parts.append(credit)
        found = reduce(DataFrame.unionByName, parts).where("source <> node AND credit > 0").groupBy(F.col("node").alias("name")).agg(F.sum("credit").alias("p"))
        now = found if total is None else found.unionByName(total).groupBy("name").agg(F.sum("p").alias("p"))
        total = _cut(now, total)
        drop(*levels, *parts)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    scale *= n / sample if sample else 1.0
    return nodes.select("name").join(total, "name", "left").select("name", (F.coalesce("p", F.lit(0.0)) * scale).alias("score"))


def table(nodes: DataFrame, edges: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """A row a node with the asked measures; unknown names are passed over."""
    work = {"degree": degree, "betweenness": betweenness, "closeness": closeness, "pagerank": pagerank, "eigenvector": eigenvector}
    out = nodes.select("name")
    for m in measures or MEASURES:
        if m in work:
            out = out.join(work[m](nodes, edges).withColumnRenamed("score", m), "name")
    return out


def top(scores: DataFrame, n: int = 10) -> DataFrame:
    """The *n* best nodes of each measure of a table: (measure, name, score)."""
    measures = [c for c in scores.columns if c != "name"]
    long = scores.unpivot("name", measures, "measure", "score")
    return top_per(long, ["measure"], n, F.desc("score"), F.asc("name"))
