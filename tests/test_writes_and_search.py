"""Writes that break off, streams without ids, rarity under filters, JSON that breaks off early, sizes of subtrees."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.functions import folds
from loomgraph.operators import retrieval, store
from loomgraph.plans import documents
from loomgraph.streaming import cdc


def nodes_of(spark, names, datasource="a"):
    return model.with_defaults(spark.createDataFrame([(n, datasource) for n in names], "name string, datasource string").withColumns({"id": model.entity_id("name"), "type": F.lit("person")}))


def test_a_write_that_fails_leaves_the_version_before(spark, tmp_path, monkeypatch):
    kept = store.GraphStore(spark, str(tmp_path / "graph"))
    assert kept.nodes.count() == 0
    kept.write("nodes", nodes_of(spark, ["x"]))
    with monkeypatch.context() as m:  # dies after the data, before the pointer
        m.setattr(kept, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            kept.write("nodes", nodes_of(spark, ["y"]))
    (tmp_path / "graph" / "graph.9.json").write_text("{\"nodes\": [\"no such")  # dies while it writes the pointer
    assert [r.name for r in kept.nodes.collect()] == ["x"]
    kept.upsert("nodes", nodes_of(spark, ["x", "z"], "b"))
    assert sorted((r.name, r.datasource) for r in store.GraphStore(spark, kept.path).nodes.collect()) == [("x", "b"), ("z", "b")]
    for k in range(3):
        kept.write("nodes", nodes_of(spark, [f"n{k}"]))
    assert [r.name for r in kept.nodes.collect()] == ["n2"] and len(kept._pointers()) <= 3


def test_changes_are_small_and_read_in_order(spark, tmp_path, monkeypatch):
    kept = store.GraphStore(spark, str(tmp_path / "graph"))
    none = nodes_of(spark, ["x"]).limit(0)
    kept.change("nodes", nodes_of(spark, ["x", "y", "z"]), none)
    state = lambda: sorted((r.name, r.datasource) for r in kept.nodes.collect())
    kept.change("nodes", nodes_of(spark, ["x"], "b"), nodes_of(spark, ["x", "y", "unknown"]))
    assert state() == [("x", "b"), ("z", "a")] and len(kept._parts("nodes")) == 2
    kept.change("nodes", nodes_of(spark, ["y"], "c").withColumn("extra", F.lit(1)), nodes_of(spark, ["z"]))
    assert state() == [("x", "b"), ("y", "c")]
    assert spark.read.parquet(f"{kept.path}/nodes/{kept.version('nodes')}").count() == 2
    kept.keep_newest("nodes", 1)
    assert state() == [("x", "b"), ("y", "c")]
    with monkeypatch.context() as m:
        m.setattr(kept, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            kept.change("nodes", none, nodes_of(spark, ["x", "y"]))
    assert state() == [("x", "b"), ("y", "c")]
    monkeypatch.setattr(store.GraphStore, "CHANGES", 2)
    kept.change("nodes", none, nodes_of(spark, ["x"]))
    assert state() == [("y", "c")] and len(kept._parts("nodes")) == 1


def test_rejects_need_no_ids(spark):
    good = json.dumps({"op": "c", "after": {"k": "1"}, "source": {"table": "t"}, "ts_ms": 5})
    rows = [("1-0", good), ("1-0", "no json"), (None, '{"op": "x"}'), ("2-0", None), ("3-0", '{"op": "d", "before": null, "source": {"table": "t"}}')]
    messages = spark.createDataFrame(rows, "seq string, payload string")
    assert cdc.parse(messages).count() == 1
    assert sorted(map(str, cdc.rejected(messages).collect())) == sorted(map(str, [r for r in messages.collect() if r.payload != good]))
    bare = messages.drop("seq")
    assert cdc.parse(bare).first().seq == "0-0" and cdc.rejected(bare).count() == 4


def test_rarity_follows_from_all_nodes(spark):
    nodes = nodes_of(spark, ["alpha beta"], "one").unionByName(nodes_of(spark, [f"alpha {k}" for k in range(30)], "two"))
    whole = {r.name: r.score for r in retrieval.full_text(nodes, "alpha", 50, fields=("name",)).collect()}
    part = {r.name: r.score for r in retrieval.full_text(nodes, "alpha", 50, prefixes=["one"], fields=("name",)).collect()}
    assert part == {"alpha beta": pytest.approx(whole["alpha beta"])}
    plain = retrieval.full_text(nodes, "lph", 3, fields=("name",)).collect()
    assert len(plain) == 3 and all(r.score is None for r in plain)


def test_json_is_cut_back_to_its_last_whole_value():
    assert folds.repair_json('{"a": {"b": [1, 2], "c": "' + "x" * 5000) == {"a": {"b": [1, 2]}}
    assert folds.repair_json('[{"k": "v,]}"}, {"k": tru' + "?" * 3000) == [{"k": "v,]}"}, {}]
    assert folds.repair_json('{"a": 12') == {"a": 12} and folds.repair_json("nothing") is None and folds.repair_json('{"a": 1}}') == {"a": 1}


def test_subtree_sizes_against_plain_sums(spark):
    rng = random.Random(2)
    rows = [(d, i, rng.randrange(1, 7), "x" * rng.randrange(200)) for d in range(3) for i in range(1, 40)]
    got = {(r.doc_id, r.ord): r.tokens for r in documents.subtree_tokens(spark.createDataFrame(rows, "doc_id long, ord int, level int, text string")).collect()}
    for d, i, level, _ in rows:
        later = [r for r in rows if r[0] == d and r[1] > i]
        end = min((r[1] for r in later if r[2] <= level), default=1 << 30)
        assert got[d, i] == sum(len(r[3]) // 4 for r in rows if r[0] == d and i <= r[1] < end)
