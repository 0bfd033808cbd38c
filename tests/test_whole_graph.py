"""Queries on whole graphs against their SQL."""

import duckdb
import pytest

from loomgraph import queries

SF = "/root/testdata/sf0.01"  # every pair of nations trades
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
WHOLE = ["trade_hops", "trade_distance", "trade_k_paths", "core_hops", "core_k_paths", "trade_degree", "pagerank_20", "eigenvector_20", "trade_closeness", "trade_topk_centrality"]


def same(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = db.execute(queries.ORACLES[name])
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    clean = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    have = clean(map(tuple, got.collect()))
    assert have and have == clean([r[i] for i in at] for r in want.fetchall())


@pytest.mark.parametrize("name", WHOLE)
def test_whole_graph(spark, name):
    same(spark, SF, name)


@pytest.mark.parametrize("name", ["full_text_hit", "full_text_ranked", "name_resolution_all"])
def test_search_of_all_nodes(spark, name):
    same(spark, SF, name)


def test_hit_is_searched_in_all_nodes(spark, monkeypatch):
    seen = []
    search = queries.retrieval.full_text
    monkeypatch.setattr(queries.retrieval, "full_text", lambda nodes, *a, **k: seen.append(nodes.count()) or search(nodes, *a, **k))
    queries.full_text_hit(spark, SF)
    assert seen == [queries.sample.core(spark, SF)[0].count()]
