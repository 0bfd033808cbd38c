"""Steps whose tasks and passes stay bounded as tables grow."""

from loomgraph.functions import folds
from loomgraph.operators import centrality, community, paths
from loomgraph.plans import annotate, documents, sample


def test_undirected_is_written_once_and_the_later_edge_wins(spark):
    """Of (a, b) and (b, a) the second in order counts, even without a weight; of parallel ones the heaviest."""
    rows = [("a", "b", 5.0), ("b", "a", 2.0), ("c", "d", 1.0), ("c", "d", 3.0), ("f", "e", None), ("e", "f", 4.0), ("g", "g", 1.0)]
    found = community.undirected(spark.createDataFrame(rows, "src string, dst string, strength double"))
    assert {(r.src, r.dst): r.weight for r in found.collect()} == {("a", "b"): 2.0, ("c", "d"): 3.0, ("e", "f"): None, ("g", "g"): 1.0}
    assert all("/loomgraph-" in f for f in found.inputFiles())


def test_narrow_partitions_only_inside(spark):
    keys = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(k) for k in keys]
    with paths.narrow(spark, 20 * paths.ROWS):
        inside = [spark.conf.get(k) for k in keys]
    assert inside == [f"{paths.BYTES}b", f"{paths.BYTES}b", "20"] and [spark.conf.get(k) for k in keys] == before


def test_pagerank_by_lists_of_any_length(spark, monkeypatch):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "name string")
    edges = spark.createDataFrame([("a", x) for x in "bcdef"] + [("b", "a"), ("c", "a"), ("c", "a")], "src string, dst string")
    want = {r.name: r.score for r in centrality.pagerank(nodes, edges, iterations=4).collect()}
    monkeypatch.setattr(centrality, "LIST", 2)
    found = {r.name: r.score for r in centrality.pagerank(nodes, edges, iterations=4).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want) and abs(sum(want.values()) - 1) < 1e-12


def test_rounds_of_moves_take_linked_nodes_only(spark, monkeypatch):
    seen, moves = [], community._round_of_moves
    monkeypatch.setattr(community, "_round_of_moves", lambda state, *more: (seen.append(state.count()), moves(state, *more))[1])
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(40)], "name string")
    edges = spark.createDataFrame([("n00", "n01", 1.0), ("n02", "n03", 1.0)], "src string, dst string, weight double")
    part = {r.name: r.partition_id for r in community.label_rounds(nodes, edges).collect()}
    assert len(part) == 40 and part["n00"] == part["n01"] == 0 and part["n02"] == part["n03"] == 1 and len(set(part.values())) == 38
    assert seen and max(seen) <= 4


def test_homes_are_written_once(spark, sf):
    from loomgraph import index_queries

    assert all("/loomgraph-" in f for t in index_queries._homes(spark, sf) for f in t.inputFiles())


def test_trade_counts_are_written_once(spark, sf):
    _, edges = sample.trade(spark, sf)
    assert not any("lineitem" in f for f in edges.inputFiles())


def test_answers_are_parsed_once_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(annotate, "PIECE", 2)
    rows = [(str(i), f'{{"tables": [{{"t": "t{i}", "d": "x"}}]}}') for i in range(7)] + [("7", "no")]
    found = annotate.parse_answers(spark.createDataFrame(rows, "key string, answer string"))
    assert sorted((r.key, r.kind, r.table_name) for r in found.collect()) == [(str(i), "table", f"t{i}") for i in range(7)] + [("7", "error", None)]
    assert found.inputFiles() and all("/loomgraph-" in f for f in found.inputFiles())


def test_only_long_texts_are_split_in_python(spark, capsys):
    texts = ["short", "。".join(["0123456789"] * 30), "", None, "x" * 50]
    nodes = spark.createDataFrame([(i, 1, "t", t) for i, t in enumerate(texts)], "doc_id int, ord int, title string, text string")
    segs = documents.segments(nodes, 50)
    want = [(i, k, p) for i, t in enumerate(texts) if t for k, p in enumerate([t] if len(t) <= 50 else folds.split_text(t, 50))]
    assert sorted((r.doc_id, r.part, r.text) for r in segs.collect()) == want
    segs.explain()
    assert "Python" not in capsys.readouterr().out
