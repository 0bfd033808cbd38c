import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.operators import centrality, community, dedup, graph, paths, store


@pytest.fixture(scope="module")
def small(spark):
    names = [("a", "person"), ("b", "person"), ("c", "place"), ("d", None), ("e", "time")]
    nodes = store.unique_nodes(spark.createDataFrame(names, "name string, type string")).cache()
    rels = [("a", "knows", "B"), ("b", "lives in", "c"), ("c", "p", "a"), ("a", "p", "zz"), ("a", "self", "a")]
    edges = store.edges_of(store.resolve(spark.createDataFrame(rels, "s string, p string, o string"), nodes)).cache()
    return nodes, edges


def test_names_resolve_by_case_and_unknown_ends_are_left_out(small):
    nodes, edges = small
    assert nodes.count() == 4 and edges.count() == 4
    assert store.attached(edges, nodes).count() == 4


def test_degrees_count_loops_twice_and_keep_lonely_nodes(small):
    nodes, edges = small
    found = {r.name: r.degree for r in graph.degrees(nodes, edges).join(nodes, "id").collect()}
    assert found == {"a": 4, "b": 2, "c": 2, "d": 0}


def test_store_versions_upserts_and_deletes(spark, small, tmp_path):
    nodes, edges = small
    s = store.GraphStore(spark, str(tmp_path / "g"))
    assert s.nodes.count() == 0 and s.version("nodes") is None
    s.write("nodes", nodes)
    s.write("edges", edges)
    s.upsert("nodes", nodes.where("name = 'a'").withColumn("type", F.lit("robot")))
    assert {r.name: r.type for r in s.nodes.collect()}["a"] == "robot" and s.nodes.count() == 4
    s.delete(s.nodes.where("name = 'a'"))
    assert s.nodes.count() == 3 and s.edges.count() == 1
    assert len(s.versions("nodes")) == 3
    s.keep_newest("nodes", 1)
    assert s.nodes.count() == 3 and len(s.versions("nodes")) == 3  # the whole table and two changes, all in use
    s.compact("nodes", keep=1)
    assert s.nodes.count() == 3 and len(s.versions("nodes")) == 1
    s.export(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/nodes")).count() == 3
    with pytest.raises(ValueError):
        s.export("x", "xml")


def test_batches_report_what_they_reject(spark):
    df = spark.createDataFrame([("a", "person"), ("a", "person"), (None, "x"), ("t", "time")], "name string, type string")
    assert {r.reason: r["count"] for r in store.rejected(df).collect()} == {"repeated name": 1, "no name": 1, "type is not stored": 1}


def test_update_sets_and_clears(small):
    nodes, _ = small
    me = nodes.where("name = 'a'").first().id
    row = store.update_entity(nodes, me, {"type": None, "note": "x"}).where(F.col("id") == me).first()
    assert row.type is None and row.note == "x"


def test_save_all(spark):
    e = spark.createDataFrame([("Ann", "person"), ("Bo", "person")], "name string, type string")
    r = spark.createDataFrame([("ann", "knows", "Bo"), ("ann", "knows", "Bo"), ("x", "y", "z")], "s string, p string, o string")
    nodes, edges = store.save_all(e, r, "DOC://1/f")
    assert sorted((r.name, r["count"], r.confidence) for r in nodes.collect()) == [("Ann", 1, 0.5), ("Bo", 1, 0.5)]
    assert edges.count() == 1


def test_dedup_and_budget(spark):
    df = spark.createDataFrame([("r1", 1), ("r1", 2), ("", 3), (None, 4)], "relationship_id string, seq int")
    assert sorted(r.seq for r in dedup.dedup_relations(df).collect()) == [1, 3, 4]
    sizes = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "k int, n int").withColumn("g", F.lit(1))
    assert [r.k for r in dedup.budget_prefix(sizes, ["g"], [F.asc("k")], F.col("n"), 10).collect()] == [1]
    pairs = spark.createDataFrame([(1, 4, 0), (2, 6, 1), (3, 7, 2), (4, 7, 3)], "a int, b int, i int")
    assert dedup.mode_offset(pairs, "a", "b", "i").first().offset == 3


def graphs(seed, n=12, m=30):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(n)]
    pairs = {tuple(rng.sample(names, 2)) for _ in range(m)}
    return names, [(a, b, round(rng.uniform(0.1, 1), 3)) for a, b in sorted(pairs)]


def floyd(names, edges, weight):
    d = {(a, b): 0 if a == b else float("inf") for a in names for b in names}
    for a, b, w in edges:
        d[a, b] = min(d[a, b], weight(w))
    for k, i, j in itertools.product(names, repeat=3):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    return d


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_match_floyd_warshall(spark, seed):
    names, edges = graphs(seed)
    e = spark.createDataFrame(edges, "src string, dst string, strength double").cache()
    hop, cost = floyd(names, edges, lambda w: 1), floyd(names, edges, lambda w: w)
    s, far = names[0], max((n for n in names), key=lambda n: hop[names[0], n] if hop[names[0], n] < 99 else -1)
    assert {r.node: r.hops for r in paths.hops(e, s).collect()} == {n: hop[s, n] for n in names if hop[s, n] < 99}
    found = {r.node: r.distance for r in paths.distances(e, s).collect()}
    assert found == pytest.approx({n: cost[s, n] for n in names if cost[s, n] < 99})
    short = paths.shortest_paths(e, s, far, 3).collect()
    assert short and all(r.length == hop[s, far] and r.path[0] == s and r.path[-1] == far for r in short)
    both = paths.disjoint_paths(e, s, far, 3)
    used = [x for p, _ in both for x in zip(p, p[1:])]
    assert len(used) == len(set(used)) and both[0][1] == pytest.approx(cost[s, far])


def test_paths_end_only_with_the_frontier(spark):
    e = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(5)], "src string, dst string, strength double").cache()
    for call in (paths.hops, paths.distances):
        with pytest.raises(RuntimeError):
            call(e, "n00", most=3)
        assert call(e, "n00", most=6).count() == 6
    with pytest.raises(RuntimeError):
        paths.shortest_paths(e, "n00", "n05", most=3)
    assert paths.shortest_paths(e, "n00", "n05", most=5).first().length == 5


def test_paths_beyond_fifty_hops(spark, tmp_path):
    """Rounds of a deep graph are cut in a checkpoint folder."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    e = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(52)], "src string, dst string, strength double").coalesce(1).cache()
    assert paths.shortest_paths(e, "n00", "n52").first().length == 52


def test_path_messages(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    e = spark.createDataFrame([("a", "b", 0.5)], "src string, dst string, strength double")
    assert paths.analyze(nodes, e, "a", "b")["path_lengths"] == [1]
    assert "no path" in paths.analyze(nodes, e, "b", "a")["message"]
    assert "unknown" in paths.analyze(nodes, e, "a", "x")["message"]
    assert paths.analyze(nodes, e, "a", "b", k=2, weighted=True)["total_paths"] == 1


def brute_betweenness(names, edges):
    step = {}
    for a, b, _ in edges:
        step.setdefault(a, []).append(b)

    def all_shortest(s, t):
        level, found = [[s]], []
        while level and not found:
            found = [p for p in level if p[-1] == t]
            level = [p + [v] for p in level for v in step.get(p[-1], []) if v not in p]
        return found

    out = dict.fromkeys(names, 0.0)
    for s, t in itertools.permutations(names, 2):
        ps = all_shortest(s, t)
        for v in names:
            if ps and v not in (s, t):
                out[v] += sum(v in p for p in ps) / len(ps)
    n = len(names)
    return {k: v / ((n - 1) * (n - 2)) for k, v in out.items()}


def test_centralities(spark):
    names, edges = graphs(5, 8, 16)
    nodes = spark.createDataFrame([(n,) for n in names], "name string").cache()
    e = spark.createDataFrame(edges, "src string, dst string, strength double").cache()
    got = {r.name: r.score for r in centrality.betweenness(nodes, e).collect()}
    assert got == pytest.approx(brute_betweenness(names, edges))
    hop = floyd(names, edges, lambda w: 1)
    near = {}
    for v in names:
        ds = [hop[u, v] for u in names if u != v and hop[u, v] < 99]
        near[v] = len(ds) / sum(ds) * len(ds) / (len(names) - 1) if ds else 0.0
    assert {r.name: r.score for r in centrality.closeness(nodes, e).collect()} == pytest.approx(near)
    rank = centrality.pagerank(nodes, e, iterations=15).collect()
    assert sum(r.score for r in rank) == pytest.approx(1)
    table = centrality.table(nodes, e, ["degree", "closeness", "no such"])
    assert table.columns == ["name", "degree", "closeness"]
    assert centrality.top(table, 2).count() == 4


def two_cliques():
    left, right = [f"l{i}" for i in range(6)], [f"r{i}" for i in range(5)]
    edges = [(a, b, 1.0) for g in (left, right) for a, b in itertools.combinations(g, 2)] + [("l0", "r0", 0.1)]
    return left, right, edges


def test_partitions(spark):
    left, right, edges = two_cliques()
    nodes = spark.createDataFrame([(n, "x") for n in [*left, *right, "alone"]], "name string, type string")
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    want = {**dict.fromkeys(left, 0), **dict.fromkeys(right, 1), "alone": 2}
    parts = community.louvain(nodes, e)
    assert {r.name: r.partition_id for r in parts.collect()} == want
    q = community.modularity(e, parts).first().modularity
    assert q > community.modularity(e, nodes.select("name", F.lit(0).alias("partition_id"))).first().modularity
    rounds = {r.name: r.partition_id for r in community.label_rounds(nodes, e).collect()}
    assert len({rounds[n] for n in left}) == 1 and len({rounds[n] for n in right}) == 1
    spec = {r.name: r.partition_id for r in community.spectral(nodes, e, k=3).collect()}
    assert len({spec[n] for n in left}) == 1 and spec["l1"] != spec["r1"]
    assert community.partition(nodes, e, "kmeans", k=2).count() == 12
    assert community.partition_of(parts, "r1").first().size == 5
    with pytest.raises(ValueError):
        community.partition(nodes, e, "other")
    stats = community.community_stats(nodes, e, parts).collect()
    assert [(r["size"], r.inner_edges, round(r.density, 3)) for r in stats] == [(6, 15, 1.0), (5, 10, 1.0), (1, 0, 0.0)]
    supers, links = community.meta_graph(e, parts)
    assert supers.count() == 3 and [tuple(r) for r in links.collect()] == [(0, 1, 0.1)]
    assert community.meta_graph(e, parts, drop_zero=True)[1].count() == 0


def test_louvain_as_joins_is_as_good_as_in_one_task(spark):
    rng = random.Random(3)
    names = [f"n{i:02d}" for i in range(48)]
    edges = [(a, b, 1.0) for (i, a), (j, b) in itertools.combinations(enumerate(names), 2) if rng.random() < (0.7 if i // 6 == j // 6 else 0.15 if i // 24 == j // 24 else 0.01)]
    nodes = spark.createDataFrame([(n,) for n in [*names, "alone"]], "name string")
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    parts = community.label_rounds(nodes, e).cache()
    best = community.modularity(e, community.louvain(nodes, e)).first().modularity
    assert community.modularity(e, parts).first().modularity >= 0.95 * best
    ids = [r.partition_id for r in parts.collect()]
    assert len(ids) == 49 and sorted(set(ids)) == list(range(len(set(ids)))) and ids.count(0) == max(map(ids.count, ids))
    empty = community.label_rounds(nodes, e.limit(0)).collect()
    assert sorted(r.partition_id for r in empty) == list(range(49))


def test_compress_of_tiny_graph_is_empty(spark):
    e = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    kept, ratio = community.compress(e, 0.5)
    assert kept.count() == 0 and ratio == 1.0


def test_parallel_edges_last_wins(spark):
    e = spark.createDataFrame([("a", "b", 0.1, "r1"), ("a", "b", 0.9, "r2"), ("b", "a", 0.3, "r3")], "src string, dst string, strength double, relationship_id string")
    assert {(r.src, r.dst): r.strength for r in paths.build(e).collect()} == {("a", "b"): 0.9, ("b", "a"): 0.3}
    assert {(r.src, r.dst): r.strength for r in paths.build(e, directed=False).collect()} == {("a", "b"): 0.3}


def test_forbidden_name_is_none(spark):
    assert model.ENTITY_TYPES[0] == "person"
