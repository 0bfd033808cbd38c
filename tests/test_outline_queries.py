"""Queries of ``outline_queries`` against their SQL, and what they rest on."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph import outline_queries, queries
from loomgraph.plans import annotate, documents

NAMES = sorted(n for n, f in queries.QUERIES.items() if f.__module__ == outline_queries.__name__)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "conversations"):
        path = f"{sf}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = queries.QUERIES[name](spark, sf)
    want = db.execute(queries.ORACLES[name])
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    have = sorted(map(tuple, got.collect()), key=repr)
    assert have and have == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


TREE = "doc_id long, node string, parent string, title string, start_index int, end_index int"


def book(spark):
    """Two documents of 12 pages; sections 1 and 2 share page 5 of the first."""
    text = {1: "1 One", 2: "1.1 A", 4: "1.2 B\n1.2.1 C", 5: "1.3 D\n2 Two\n2.1 E", 9: "2.2 F\n2.2 F"}
    rows = [(d, p, (text.get(p, "") if d == 1 else "") + "\n" + "abcd" * 10) for d in (1, 2) for p in range(1, 13)]
    return spark.createDataFrame(rows, "doc_id long, page int, text string")


def split(spark, rows, *limits, **options):
    found = documents.split_large(spark.createDataFrame(rows, TREE), book(spark), *limits, **options).collect()
    return sorted((r.doc_id, r.title, r.parent, r.start_index, r.end_index) for r in found)


ROWS = [(1, "a", None, "One", 1, 5), (1, "b", None, "Two", 5, 12), (2, "a", None, "Plain", 1, 12), (3, "a", None, "No pages", 1, 12)]
#: Codes of depth 2 and 3 under the sections, a repeated line, and documents without numbered lines or pages.
ALL = [(1, "A", "a", 2, 4), (1, "B", "a", 4, 4), (1, "C", "a.00000002", 4, 5), (1, "D", "a", 5, 5), (1, "E", "b", 5, 9), (1, "F", "b", 9, 9), (1, "F", "b", 9, 12), (1, "One", None, 1, 2), (1, "Two", None, 5, 5), (2, "Plain", None, 1, 12), (3, "No pages", None, 1, 12)]


def test_large_sections_are_split(spark):
    assert split(spark, ROWS, 3, 40) == ALL


def test_small_sections_stay(spark):
    whole = sorted((d, t, p, s, e) for d, _, p, t, s, e in ROWS)
    assert split(spark, ROWS, 11, 40) == whole
    assert split(spark, ROWS, 3, 10**6) == whole
    assert split(spark, [], 3, 40) == []


def test_only_what_is_large_goes_deeper(spark):
    """Parts of the first level only, as B is small; E (pages 5 to 9) is large but has no lines of its own."""
    assert split(spark, ROWS, 3, 40, all_levels=False) == sorted([(1, "B", "a", 4, 5)] + [r for r in ALL if r[1] not in ("B", "C")])


def test_an_outline_of_ones_own(spark):
    """A model that finds one part, half way, of whatever it is given: halves until they are small."""
    def half(pages):
        middle = pages.groupBy("doc_id").agg(F.floor((F.min("page") + F.max("page")) / 2).cast("int").alias("physical_index"))
        return middle.select("doc_id", F.lit(1).alias("ord"), F.lit("1").alias("structure"), F.concat(F.lit("half "), "physical_index").alias("title"), "physical_index")

    assert split(spark, [(2, "a", None, "Plain", 1, 12)], 3, 40, outline=half) == [(2, "Plain", None, 1, 6), (2, "half 6", "a", 6, 9), (2, "half 9", "a.00000001", 9, 12)]


def test_answers_of_odd_forms(spark):
    rows = [("a", None), ("b", ""), ("c", "[1, 2]"), ("d", '{"tables": [1]}'), ("e", '{"tables": [{"t": 7, "d": ["x"]}]}'), ("f", "{}"), ("g", '{"db": {"ov": "", "dom": "d"}, "tables": [{"table_name": "t", "description": "long"}]}')]
    got = annotate.parse_answers(spark.createDataFrame(rows, "key string, answer string")).collect()
    assert {r.key for r in got if r.kind == "error"} == {"a", "b", "c", "d"}
    assert [(r.key, r.kind, r.table_name, r.description) for r in got if r.kind != "error"] == [("e", "table", "7", "['x']"), ("g", "db", None, ""), ("g", "table", "t", "long")]


def test_the_last_of_two_descriptions_counts(spark):
    parsed = annotate.parse_answers(spark.createDataFrame([("k", '{"tables": [{"t": "x", "d": "one"}, {"t": "x", "d": "two"}, {"t": "X", "d": "other"}]}')], "key string, answer string"))
    tables = spark.createDataFrame([("k", "x", "old"), ("k", "y", "old"), ("l", "x", None)], "key string, table_name string, business_description string")
    t, c = annotate.merge_answers(tables, tables.select("key", "table_name").withColumn("column_name", tables.table_name), parsed)
    assert sorted((r.key, r.table_name, r.business_description) for r in t.collect()) == [("k", "x", "two"), ("k", "y", "old"), ("l", "x", None)]
    assert [r.business_description for r in c.collect()] == [None] * 3
