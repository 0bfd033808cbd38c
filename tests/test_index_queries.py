"""Queries of ``index_queries`` and the centralities as joins against their SQL."""

import os

import duckdb
import pytest

from loomgraph import index_queries, more_queries, queries  # noqa: F401  ``more_queries`` adds its own

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")
NAMES = sorted(n for n, f in queries.QUERIES.items() if f.__module__ == index_queries.__name__ and n in queries.ORACLES)


@pytest.mark.parametrize("name", [*NAMES, "betweenness", "trade_betweenness", "closeness", "ctx_build", "fn_text_basics", "fuse_rank"])
def test_equals_sql(spark, sf, name):
    sf = "/root/testdata/sf0.01" if name == "core_kmeans" else sf  # nations have clearly more edges than all others from there on
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = queries.QUERIES[name](spark, sf)
    want = db.execute(queries.ORACLES[name])
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    clean = lambda rows: sorted((tuple(float(f"{x:.8g}") if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    have = clean(map(tuple, got.collect()))
    assert have and have == clean([r[i] for i in at] for r in want.fetchall())
    spark.catalog.clearCache()
