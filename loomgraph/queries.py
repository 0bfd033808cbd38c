"""Queries of the graph engine: name -> function of (spark, sf_dir), and the same in SQL where SQL has it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog, model
from .functions import text as fn
from .operators import centrality, community, dedup, graph, paths, retrieval, store, trend
from .plans import documents, extraction, importing, sample
from .streaming import cdc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# The core graph in SQL.
def _name(table: str, keys: list[str]) -> str:
    return f"'{table}:' || " + " || ':' || ".join(keys)


_NODES = " UNION ALL ".join(f"SELECT md5({_name(t, k)}) AS id, {_name(t, k)} AS name, '{kind}' AS type, '{sample.DATASOURCE}/{t}' AS datasource FROM {t}" for t, k, _, kind in sample.LAYOUT)
_PAIRS = " UNION ALL ".join(f"SELECT {_name(t, k)} AS subject, '{to}:' || {c} AS object FROM {t}" for t, k, fks, _ in sample.LAYOUT for c, to, _ in fks)
CORE = f"""nodes AS ({_NODES}),
edges AS (SELECT md5(md5(subject) || '_Foreign key_' || md5(object)) AS relationship_id, md5(subject) AS subject_id, md5(object) AS object_id, subject, object FROM ({_PAIRS})),
degree AS (SELECT id, CAST(coalesce(d, 0) AS BIGINT) AS degree FROM nodes LEFT JOIN (SELECT id, count(*) AS d FROM (SELECT subject_id AS id FROM edges UNION ALL SELECT object_id FROM edges) GROUP BY id) USING (id))"""
TRADE = """flows AS (SELECT a.n_name AS src, b.n_name AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1, 2),
trade AS (SELECT src, dst, n / (SELECT sum(n) FROM flows) AS strength, n FROM flows WHERE src <> dst),
strong AS (SELECT src, dst, strength FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY strength DESC, dst) AS r FROM trade) WHERE r <= 3),
pairs AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, arg_max(strength, (src, dst)) AS weight FROM trade GROUP BY 1, 2),
parts AS (SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS partition_id FROM nation)"""


@query(f"WITH {CORE} SELECT name, type, degree FROM nodes JOIN degree USING (id) ORDER BY degree DESC, name LIMIT 10")
def top_degree(spark, sf):
    nodes, edges = sample.core(spark, sf)
    return nodes.join(graph.degrees(nodes, edges), "id").select("name", "type", "degree").orderBy(F.desc("degree"), "name").limit(10)


@query(f"WITH {CORE} SELECT id, name, type, datasource FROM nodes")
def import_nodes(spark, sf):
    return sample.core(spark, sf)[0].select("id", "name", "type", "datasource")


@query("SELECT md5('customer:' || c_custkey) AS id, 'c_custkey=' || c_custkey || ', c_nationkey=' || c_nationkey AS description FROM customer")
def row_descriptions(spark, sf):
    rows = sample.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return importing.row_nodes(importing.Table("customer", rows, ["c_custkey"]), sample.DATASOURCE).select("id", "description")


@query(f"WITH {CORE} SELECT relationship_id, subject_id, object_id FROM edges")
def import_edges(spark, sf):
    return sample.core(spark, sf)[1].select("relationship_id", "subject_id", "object_id")


@query("SELECT 'orders:' || max(o_orderkey) AS subject, 'customer:' || o_custkey AS object FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
def import_edges_last(spark, sf):
    customer, orders = sample.tables(spark, sf, "customer", "orders")
    return importing.fk_edges(orders, "o_custkey", customer, "c_custkey", mode="last").select("subject", "object")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC, l_shipdate DESC) AS r FROM lineitem) WHERE r = 1")
def lineitem_dedup(spark, sf):
    return sample.lineitems(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(f"WITH {CORE} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def type_counts(spark, sf):
    return graph.type_counts(sample.core(spark, sf)[0])


@query(f"WITH {CORE} SELECT count(*) AS n FROM edges")
def total_edges(spark, sf):
    return sample.core(spark, sf)[1].agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CORE} SELECT id, degree FROM degree")
def agg_degree(spark, sf):
    return graph.degrees(*sample.core(spark, sf))


@query(f"WITH {CORE} SELECT n.type AS type, degree, count(*) AS n FROM nodes n JOIN degree USING (id) WHERE degree >= 10 GROUP BY 1, 2")
def degree_histogram(spark, sf):
    nodes, edges = sample.core(spark, sf)
    return nodes.join(graph.degrees(nodes, edges).where("degree >= 10"), "id").groupBy("type", "degree").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CORE} SELECT id, name FROM nodes WHERE starts_with(datasource, '{sample.DATASOURCE}/customer') ORDER BY id LIMIT 100")
def prefix_search(spark, sf):
    nodes, _ = sample.core(spark, sf)
    return nodes.where(model.under("datasource", f"{sample.DATASOURCE}/customer")).orderBy("id").limit(100).select("id", "name")


@query(f"WITH {CORE} SELECT id, name FROM nodes WHERE datasource LIKE '%/nation' OR datasource LIKE '%/region'")
def any_prefix(spark, sf):
    nodes, _ = sample.core(spark, sf)
    return nodes.where(model.under_any("datasource", [f"{sample.DATASOURCE}/nation", f"{sample.DATASOURCE}/region"])).select("id", "name")


@query(f"WITH {CORE} SELECT id, name FROM nodes WHERE datasource = 'orders' OR starts_with(datasource, '{sample.DATASOURCE}/part')")
def exact_or_prefix(spark, sf):
    nodes, _ = sample.core(spark, sf)
    return nodes.where(model.exact_or_under("datasource", "orders") | model.exact_or_under("datasource", f"{sample.DATASOURCE}/part")).select("id", "name")


@query(f"WITH {CORE} SELECT id, name FROM nodes WHERE contains(lower(name), 'customer:1') ")
def icontains(spark, sf):
    return graph.search_names(sample.core(spark, sf)[0], "Customer:1", True, ("name",)).select("id", "name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a') AND NOT p_brand IN ('Brand#1', 'Brand#2')")
def contains_not_in(spark, sf):
    rows = sample.table(spark, sf, "part")
    return rows.where(graph.contains("p_name", "a") & ~F.col("p_brand").isin("Brand#1", "Brand#2")).select("p_partkey", "p_name")


@query(f"WITH {CORE} SELECT id, name FROM nodes WHERE type = 'person' ORDER BY id LIMIT 30 OFFSET 20")
def type_page(spark, sf):
    return graph.list_page(sample.core(spark, sf)[0], kind="person", limit=30, offset=20)[0].select("id", "name")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey > 100 OR (o_custkey = 100 AND o_orderkey > 500) ORDER BY 1, 2 LIMIT 50")
def keyset_page(spark, sf):
    return graph.keyset_page(sample.table(spark, sf, "orders"), ["o_custkey", "o_orderkey"], (100, 500), 50).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(f"WITH {CORE} SELECT relationship_id, subject, object FROM edges ORDER BY relationship_id LIMIT 5000")
def scan_edges(spark, sf):
    nodes, edges = sample.core(spark, sf)
    return graph.scan_edges(edges.drop("subject", "object"), nodes).select("relationship_id", "subject", "object")


@query(f"WITH {CORE}, x AS (SELECT id FROM nodes WHERE type = 'location') SELECT relationship_id FROM edges WHERE subject_id IN (SELECT id FROM x) OR object_id IN (SELECT id FROM x)")
def incident_edges(spark, sf):
    nodes, edges = sample.core(spark, sf)
    return graph.incident(edges, nodes.where("type = 'location'").select("id")).select("relationship_id")


@query(f"WITH {CORE} SELECT relationship_id, CASE WHEN subject = 'nation:3' THEN 'outgoing' ELSE 'incoming' END AS direction FROM edges WHERE subject = 'nation:3' OR object = 'nation:3'")
def entity_relationships(spark, sf):
    _, edges = sample.core(spark, sf)
    me = spark.range(1).select(model.entity_id(F.lit("nation:3")).alias("i")).first().i
    return graph.incident_to(edges, me).select("relationship_id", "direction")


@query(f"""WITH {CORE}, w AS (SELECT subject AS source, object AS target, relationship_id FROM edges UNION ALL SELECT object, subject, relationship_id FROM edges WHERE subject <> object)
SELECT source, target, relationship_id FROM w WHERE source IN ('nation:1', 'nation:2', 'customer:5') ORDER BY relationship_id, source LIMIT 200""")
def undirected_expand(spark, sf):
    _, edges = sample.core(spark, sf)
    names = spark.createDataFrame([("nation:1",), ("nation:2",), ("customer:5",)], "name string")
    return graph.expand(edges, names).select("source", "target", "relationship_id")


@query(f"WITH {CORE}, x AS (SELECT id FROM nodes WHERE type IN ('location', 'organization')) SELECT relationship_id FROM edges WHERE subject_id IN (SELECT id FROM x) AND object_id IN (SELECT id FROM x)")
def semi_edges(spark, sf):
    nodes, edges = sample.core(spark, sf)
    return graph.induced(edges, nodes.where(F.col("type").isin("location", "organization")).select("id")).select("relationship_id")


@query(f"""WITH {CORE}, x AS (SELECT id FROM nodes WHERE type = 'organization')
SELECT DISTINCT id FROM (SELECT object_id AS id FROM edges WHERE subject_id IN (SELECT id FROM x) UNION ALL SELECT subject_id FROM edges WHERE object_id IN (SELECT id FROM x)) WHERE id NOT IN (SELECT id FROM x)""")
def anti_neighbors(spark, sf):
    nodes, edges = sample.core(spark, sf)
    return graph.neighbours(edges, nodes.where("type = 'organization'").select("id"))


_STRATA = """c AS (SELECT type, count(*) AS n FROM {nodes} GROUP BY type), f AS (SELECT count(*) AS kinds, sum(n) AS total FROM c),
q AS (SELECT type, least(n, greatest(1, {limit} // (5 * kinds)) + CAST(floor(greatest(0, {limit} - greatest(1, {limit} // (5 * kinds)) * kinds) * n / total) AS BIGINT)) AS quota FROM c, f),
s AS (SELECT id FROM (SELECT id, CASE WHEN row_number() OVER (PARTITION BY type ORDER BY id) <= quota THEN 0 ELSE 1 END AS late FROM {nodes} JOIN q USING (type)) ORDER BY late, id LIMIT {limit})"""


@query(f"WITH {CORE}, {_STRATA.format(nodes='nodes', limit=1000)} SELECT id, type FROM s JOIN nodes USING (id)")
def strata_sample(spark, sf):
    return graph.list_page(sample.core(spark, sf)[0], limit=1000)[0].select("id", "type")


_VIZ = f"""{CORE}, core AS (SELECT n.* FROM nodes n JOIN degree USING (id) WHERE degree >= 3), {_STRATA.format(nodes='core', limit=300)},
near AS (SELECT DISTINCT id FROM (SELECT object_id AS id FROM edges WHERE subject_id IN (SELECT id FROM s) UNION ALL SELECT subject_id FROM edges WHERE object_id IN (SELECT id FROM s)) WHERE id NOT IN (SELECT id FROM s)),
shown AS (SELECT id FROM (SELECT id, 0 AS late FROM s UNION ALL SELECT id, 1 FROM near) ORDER BY late, id LIMIT 300)"""


@query(f"WITH {_VIZ} SELECT id, type FROM nodes WHERE id IN (SELECT id FROM shown)")
def subgraph_viz_nodes(spark, sf):
    return graph.subgraph(*sample.core(spark, sf), min_edges=3, max_nodes=300)[0].select("id", "type")


@query(f"WITH {_VIZ} SELECT relationship_id FROM edges WHERE subject_id IN (SELECT id FROM shown) AND object_id IN (SELECT id FROM shown)")
def subgraph_viz_edges(spark, sf):
    return graph.subgraph(*sample.core(spark, sf), min_edges=3, max_nodes=300)[1].select("relationship_id")


@query("SELECT 'supplier:' || s_suppkey AS subject, 'nation:' || n_nationkey AS object FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def inferred_join(spark, sf):
    nation, supplier = sample.tables(spark, sf, "nation", "supplier")
    return importing.inferred_edges(supplier, nation, "located in", ("s_nationkey", "n_nationkey")).select("subject", "object")


@query("SELECT 'region:' || a.r_regionkey AS subject, 'region:' || b.r_regionkey AS object FROM region a, region b")
def cross_guard(spark, sf):
    (region,) = sample.tables(spark, sf, "region")
    return importing.inferred_edges(region, region, "related to").select("subject", "object")


@query("SELECT 'nation:0' AS subject, 'nation:0' AS object WHERE false")
def cross_guard_large(spark, sf):
    (nation,) = sample.tables(spark, sf, "nation")
    return importing.inferred_edges(nation, nation, "related to").select("subject", "object")


@query("""SELECT lower(n_name) AS s, 'nation:' || n_nationkey AS exact, md5(n_name) AS subject_id FROM nation WHERE n_nationkey % 2 = 0""")
def name_resolution(spark, sf):
    """Names in lower case are found by the second, case-folded lookup."""
    nation = sample.table(spark, sf, "nation")
    nodes = nation.select(model.entity_id("n_name").alias("id"), F.col("n_name").alias("name"))
    rels = nation.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("s"), F.col("n_name").alias("o"), F.concat(F.lit("nation:"), "n_nationkey").alias("exact"))
    return store.resolve(rels, nodes).select("s", "exact", "subject_id")


@query("SELECT lower(n_name) AS s, n_name AS o, 'nation:' || n_nationkey AS exact, md5(n_name) AS subject_id, md5(n_name) AS object_id FROM nation")
def name_resolution_all(spark, sf):
    """Both ends of a relation of every nation: one by its exact, one by its case-folded name."""
    nation = sample.table(spark, sf, "nation")
    nodes = nation.select(model.entity_id("n_name").alias("id"), F.col("n_name").alias("name"))
    rels = nation.select(F.lower("n_name").alias("s"), F.col("n_name").alias("o"), F.concat(F.lit("nation:"), "n_nationkey").alias("exact"))
    return store.resolve(rels, nodes).select("s", "o", "exact", "subject_id", "object_id")


@query("SELECT md5('customer:' || c_custkey) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'renewed' ELSE 'old' END AS description FROM customer UNION ALL SELECT md5('new:' || c_custkey), 'renewed' FROM customer WHERE c_custkey % 100 = 0")
def upsert_nodes(spark, sf):
    rows = sample.table(spark, sf, "customer")
    ids = lambda p: model.entity_id(F.concat(F.lit(f"{p}:"), "c_custkey")).alias("id")
    old = rows.select(ids("customer"), F.lit("old").alias("description"))
    new = rows.where("c_custkey % 3 = 0").select(ids("customer"), F.lit("renewed").alias("description")).unionByName(rows.where("c_custkey % 100 = 0").select(ids("new"), F.lit("renewed").alias("description")))
    return store.merge(old, new, "id")


@query(f"WITH {CORE} SELECT relationship_id FROM edges WHERE NOT starts_with(subject, 'customer') AND NOT starts_with(object, 'customer')")
def delete_by_datasource(spark, sf):
    nodes, edges = sample.core(spark, sf)
    return store.delete_by_datasource(nodes, edges, f"{sample.DATASOURCE}/customer")[1].select("relationship_id")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS hash FROM documents GROUP BY text")
def content_dedup(spark, sf):
    rows = sample.table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    return dedup.first_per(rows, ["hash"], "doc_id").select("doc_id", "hash")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5")
def history5(spark, sf):
    return dedup.last_turns(sample.table(spark, sf, "conversations")).select("conv_id", "turn", "role")


@query("SELECT conv_id, count(*) AS turns, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS user_turns, max(turn) AS last FROM conversations GROUP BY conv_id")
def session_stats(spark, sf):
    return sample.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max("turn").alias("last"))


@query("SELECT lang, doc_id, running FROM (SELECT lang, doc_id, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 20000")
def budget_prefix(spark, sf):
    docs = sample.table(spark, sf, "documents")
    return dedup.budget_prefix(docs, ["lang"], [F.asc("n_chars"), F.asc("doc_id")], F.col("n_chars"), 20_000).select("lang", "doc_id", "running")


@query("SELECT doc_id, CAST((CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'und') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'rights') THEN 1 ELSE 0 END) / 3.0 AS DOUBLE) AS score FROM documents")
def kw_score(spark, sf):
    return sample.table(spark, sf, "documents").select("doc_id", fn.keyword_score("text", ["The", "und", "Rights", ""]).alias("score"))


@query("SELECT doc_id, CAST(trunc(length(regexp_replace(text, '[^一-鿿]', '', 'g')) / 1.5 + (length(text) - length(regexp_replace(text, '[^一-鿿]', '', 'g'))) / 4.0) AS INTEGER) AS tokens FROM documents")
def token_count(spark, sf):
    return sample.table(spark, sf, "documents").select("doc_id", fn.tokens("text").alias("tokens"))


@query(r"SELECT doc_id, len([x for x in regexp_split_to_array(text, '\s+') if x <> '']) AS words, length(text) AS chars, len(string_split(text, chr(10))) AS lines FROM documents")
def char_word_line(spark, sf):
    return sample.table(spark, sf, "documents").select("doc_id", fn.words("text").cast("long").alias("words"), F.length("text").cast("long").alias("chars"), fn.lines("text").cast("long").alias("lines"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS BIGINT) AS sentences FROM documents")
def sentence_split(spark, sf):
    return sample.table(spark, sf, "documents").select("doc_id", F.size(fn.sentences("text")).cast("long").alias("sentences"))


@query("SELECT doc_id, CAST(i * 1000 AS BIGINT) AS chunk_offset, md5(substr(text, CAST(i * 1000 + 1 AS BIGINT), 1000)) AS hash FROM documents, unnest(range(0, CAST(greatest(0, (length(text) - 1) // 1000) AS BIGINT) + 1)) AS t(i)")
def chunk_fixed(spark, sf):
    rows = sample.table(spark, sf, "documents").select("doc_id", F.explode(fn.fixed_chunks("text", 1000)).alias("c"))
    return rows.select("doc_id", F.col("c.offset").cast("long").alias("chunk_offset"), F.md5(F.col("c.chunk").cast("binary")).alias("hash"))


_BM25 = r"""w AS (SELECT doc_id, unnest([x for x in regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') if x <> '']) AS term FROM documents),
sz AS (SELECT doc_id, count(*) AS size FROM w GROUP BY 1), tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN ('idiot', 'rights', 'reserved', 'the') GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), f AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(size) FROM sz) / (SELECT count(*) FROM documents) AS mean)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN sz USING (doc_id), f GROUP BY doc_id"""


@query(f"WITH {_BM25}")
def fts_bm25(spark, sf):
    docs = sample.table(spark, sf, "documents")
    facts = docs.select(F.size(retrieval.terms("text")).alias("n")).agg(F.count(F.lit(1)), F.avg("n")).first()
    scores = retrieval.bm25(retrieval.index(docs, "doc_id", "text"), ["idiot", "rights", "reserved", "the"], "doc_id", facts[0], facts[1])
    return scores.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {CORE} SELECT count(*) AS n FROM nodes WHERE name = 'nation:7'")
def full_text_hit(spark, sf):
    nodes, _ = sample.core(spark, sf)
    found = retrieval.full_text(nodes, "nation 7", 30, fields=("name",))
    return found.where("name = 'nation:7'").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""WITH {CORE}, w AS (SELECT id, unnest([x for x in regexp_split_to_array(lower(name), '[^\p{{L}}\p{{N}}]+') if x <> '']) AS term FROM nodes),
sz AS (SELECT id, count(*) AS size FROM w GROUP BY 1), tf AS (SELECT id, term, count(*) AS tf FROM w WHERE term IN ('nation', '7') GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), f AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT sum(size) FROM sz) / (SELECT count(*) FROM nodes) AS mean),
hit AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN sz USING (id), f GROUP BY id)
SELECT name, type, score FROM hit JOIN nodes USING (id) ORDER BY score DESC, id LIMIT 10""")
def full_text_ranked(spark, sf):
    """The ten best of all nodes."""
    nodes, _ = sample.core(spark, sf)
    return retrieval.full_text(nodes, "nation 7", 10, fields=("name",)).select("name", "type", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT 'document' AS source_type, 'd' || doc_id AS source_id, least(1.0, n_chars / 10000.0 + 0.05) AS score FROM documents)
SELECT source_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, source_id) - 1 AS BIGINT) AS rank FROM e""")
def fuse_rank(spark, sf):
    docs = sample.table(spark, sf, "documents")
    content = F.map_from_arrays(F.array(F.lit("summary"), F.lit("uri")), F.array(F.lit("text"), F.col("doc_id").cast("string")))
    ev = docs.select(F.lit("document").alias("source_type"), F.concat(F.lit("d"), "doc_id").alias("source_id"), content.alias("content"), (F.col("n_chars") / 10000.0).alias("score"))
    fused = retrieval.fuse(ev, ["no such entity"])
    return fused.select("source_id", F.round("score", 6).alias("score"), F.regexp_extract("evidence_id", r"_(\d+)$", 1).cast("long").alias("rank"))


# Paths and centralities on the trade graph.
@query(f"""WITH RECURSIVE {TRADE}, walk AS (SELECT (SELECT min(n_name) FROM nation) AS node, 0 AS hops UNION SELECT s.dst, w.hops + 1 FROM walk w JOIN strong s ON s.src = w.node WHERE w.hops < 24)
SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY node""")
def bfs_hops(spark, sf):
    nodes, edges = sample.strong_trade(spark, sf)
    return paths.hops(edges.cache(), nodes.agg(F.min("name")).first()[0])


@query(f"""WITH RECURSIVE {TRADE}, walk AS (SELECT (SELECT min(n_name) FROM nation) AS node, CAST(0 AS DOUBLE) AS d, 0 AS hops UNION ALL SELECT s.dst, w.d + s.strength, w.hops + 1 FROM walk w JOIN strong s ON s.src = w.node WHERE w.hops < 9)
SELECT node, round(min(d), 8) AS distance FROM walk GROUP BY node""")
def weighted_distance(spark, sf):
    nodes, edges = sample.strong_trade(spark, sf)
    return paths.distances(edges.cache(), nodes.agg(F.min("name")).first()[0]).select("node", F.round("distance", 8).alias("distance"))


@query(f"""WITH RECURSIVE {TRADE}, walk AS (SELECT [(SELECT min(n_name) FROM nation)] AS path UNION ALL SELECT list_append(w.path, s.dst) FROM walk w JOIN strong s ON s.src = w.path[-1] WHERE len(w.path) < 8 AND NOT list_contains(w.path, s.dst)),
hit AS (SELECT path FROM walk WHERE path[-1] = (SELECT max(n_name) FROM nation)), best AS (SELECT min(len(path)) AS n FROM hit)
SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS length FROM hit, best WHERE len(path) = n ORDER BY path LIMIT 5""")
def k_shortest_paths(spark, sf):
    nodes, edges = sample.strong_trade(spark, sf)
    ends = nodes.agg(F.min("name"), F.max("name")).first()
    return paths.shortest_paths(edges.cache(), ends[0], ends[1], 5).select(F.array_join("path", ">").alias("path"), F.col("length").cast("int").alias("length"))


@query(f"WITH {TRADE} SELECT n_name AS name, round(coalesce(d, 0) / 24.0, 8) AS score FROM nation LEFT JOIN (SELECT name, count(*) AS d FROM (SELECT src AS name FROM strong UNION ALL SELECT dst FROM strong) GROUP BY name) ON name = n_name")
def degree_centrality(spark, sf):
    return centrality.degree(*sample.strong_trade(spark, sf)).select("name", F.round("score", 8).alias("score"))


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT n_name AS name, 1.0 / 25 AS score FROM nation)"]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        steps.append(
            f"r{i} AS (SELECT n_name AS name, 0.15 / 25 + 0.85 * (coalesce(f.v, 0) + (SELECT coalesce(sum(score), 0) FROM {p} WHERE name NOT IN (SELECT src FROM strong)) / 25) AS score "
            f"FROM nation LEFT JOIN (SELECT dst, sum(score / o.n) AS v FROM {p} JOIN strong ON src = name JOIN (SELECT src AS s, count(*) AS n FROM strong GROUP BY 1) o ON o.s = src GROUP BY dst) f ON f.dst = n_name)"
        )
    return f"WITH {TRADE}, {', '.join(steps)} SELECT name, round(score, 8) AS score FROM r{rounds}"


@query(_pagerank_sql(8))
def pagerank_8(spark, sf):
    nodes, edges = sample.strong_trade(spark, sf)
    return centrality.pagerank(nodes.cache(), edges.cache(), iterations=8).select("name", F.round("score", 8).alias("score"))


def _eigen_sql(rounds: int) -> str:
    steps = ["e0 AS (SELECT n_name AS name, 1.0 / 25 AS score FROM nation)"]
    for i in range(1, rounds + 1):
        p = f"e{i - 1}"
        steps.append(f"u{i} AS (SELECT a.name, a.score + coalesce(f.v, 0) AS score FROM {p} a LEFT JOIN (SELECT dst, sum(score) AS v FROM {p} JOIN strong ON src = name GROUP BY dst) f ON f.dst = a.name)")
        steps.append(f"e{i} AS (SELECT name, score / (SELECT sqrt(sum(score * score)) FROM u{i}) AS score FROM u{i})")
    return f"WITH {TRADE}, {', '.join(steps)} SELECT name, round(score, 8) AS score FROM e{rounds}"


@query(_eigen_sql(6))
def eigenvector_6(spark, sf):
    nodes, edges = sample.strong_trade(spark, sf)
    return centrality.eigenvector(nodes.cache(), edges.cache(), iterations=6).select("name", F.round("score", 8).alias("score"))


@query(f"""WITH RECURSIVE {TRADE}, walk AS (SELECT n_name AS a, n_name AS b, 0 AS h FROM nation UNION SELECT w.a, s.dst, w.h + 1 FROM walk w JOIN strong s ON s.src = w.b WHERE w.h < 12),
far AS (SELECT b, a, min(h) AS h FROM walk GROUP BY 1, 2)
SELECT b AS name, round(CASE WHEN sum(h) > 0 THEN ((count(*) - 1) / sum(h)) * ((count(*) - 1) / 24.0) ELSE 0 END, 8) AS score FROM far GROUP BY b""")
def closeness(spark, sf):
    nodes, edges = sample.strong_trade(spark, sf)
    return centrality.closeness(nodes, edges).select("name", F.round("score", 8).alias("score"))


#: Least distances, numbers of shortest paths, and of those through a third node: the definition, with nothing passed back.
_BETWEEN = f"""WITH RECURSIVE {TRADE}, walk AS (SELECT n_name AS a, n_name AS b, 0 AS h FROM nation UNION SELECT w.a, s.dst, w.h + 1 FROM walk w JOIN strong s ON s.src = w.b WHERE w.h < 24),
far AS MATERIALIZED (SELECT a, b, min(h) AS h FROM walk GROUP BY 1, 2),
route AS (SELECT n_name AS a, n_name AS b, 0 AS h FROM nation UNION ALL SELECT r.a, s.dst, r.h + 1 FROM route r JOIN strong s ON s.src = r.b JOIN far f ON f.a = r.a AND f.b = s.dst AND f.h = r.h + 1),
ways AS MATERIALIZED (SELECT a, b, any_value(h) AS h, count(*) AS n FROM route GROUP BY 1, 2),
through AS (SELECT x.b AS name, sum(x.n * y.n / z.n) AS v FROM ways x JOIN ways y ON x.b = y.a JOIN ways z ON z.a = x.a AND z.b = y.b AND z.h = x.h + y.h WHERE x.a <> x.b AND y.a <> y.b GROUP BY 1)
SELECT n_name AS name, round(coalesce(v, 0) / (24 * 23), 8) AS score FROM nation LEFT JOIN through ON n_name = name"""


@query(_BETWEEN)
def betweenness(spark, sf):
    nodes, edges = sample.strong_trade(spark, sf)
    return centrality.betweenness(nodes, edges).select("name", F.round("score", 8).alias("score"))


@query()
def louvain(spark, sf):
    nodes, edges = sample.trade(spark, sf)
    return community.louvain(nodes, community.undirected(edges))


@query()
def kmeans_degree(spark, sf):
    nodes, edges = sample.strong_trade(spark, sf)
    return community.kmeans(nodes, edges)


@query()
def spectral(spark, sf):
    nodes, edges = sample.trade(spark, sf)
    return community.spectral(nodes, community.undirected(edges))


def _regions(nodes: DataFrame) -> DataFrame:
    return nodes.select("name", F.col("region").cast("long").alias("partition_id"))


@query(f"""WITH {TRADE}, p AS (SELECT weight, a.partition_id AS pa, b.partition_id AS pb FROM pairs JOIN parts a ON src = a.name JOIN parts b ON dst = b.name), m AS (SELECT 2 * sum(weight) AS m2 FROM pairs),
t AS (SELECT p, sum(weight) AS tot, sum(CASE WHEN pa = pb THEN weight ELSE 0 END) AS inn FROM (SELECT pa AS p, * FROM p UNION ALL SELECT pb, * FROM p) GROUP BY p)
SELECT round(sum(inn / m2 - (tot / m2) * (tot / m2)), 8) AS modularity FROM t, m""")
def modularity_by_region(spark, sf):
    nodes, edges = sample.trade(spark, sf)
    return community.modularity(community.undirected(edges), _regions(nodes)).select(F.round("modularity", 8).alias("modularity"))


@query(f"WITH {TRADE} SELECT least(a.partition_id, b.partition_id) AS a, greatest(a.partition_id, b.partition_id) AS b, round(sum(weight), 8) AS weight FROM pairs JOIN parts a ON src = a.name JOIN parts b ON dst = b.name WHERE a.partition_id <> b.partition_id GROUP BY 1, 2")
def meta_graph(spark, sf):
    nodes, edges = sample.trade(spark, sf)
    return community.meta_graph(community.undirected(edges), _regions(nodes))[1].select("a", "b", F.round("weight", 8).alias("weight"))


@query(f"WITH {TRADE} SELECT src, dst, round(weight, 8) AS weight FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, src, dst) AS r FROM pairs) WHERE r <= (SELECT count(*) // 2 FROM pairs)")
def compress(spark, sf):
    _, edges = sample.trade(spark, sf)
    return community.compress(community.undirected(edges).cache())[0].select("src", "dst", F.round("weight", 8).alias("weight"))


@query(f"""WITH {TRADE}, s AS (SELECT partition_id, count(*) AS size FROM parts GROUP BY 1), e AS (SELECT a.partition_id, count(*) AS m FROM pairs JOIN parts a ON src = a.name JOIN parts b ON dst = b.name WHERE a.partition_id = b.partition_id GROUP BY 1)
SELECT partition_id, size, coalesce(m, 0) AS inner_edges, CASE WHEN size > 1 THEN round(2.0 * coalesce(m, 0) / (size * (size - 1)), 8) ELSE 0 END AS density FROM s LEFT JOIN e USING (partition_id)""")
def community_stats(spark, sf):
    nodes, edges = sample.trade(spark, sf)
    stats = community.community_stats(nodes.withColumn("type", F.lit("location")), community.undirected(edges), _regions(nodes))
    return stats.select("partition_id", "size", "inner_edges", F.round("density", 8).alias("density"))


@query("SELECT src, dst, count(*) AS n FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY 1, 2")
def transitions(spark, sf):
    return sample.transitions(spark, sf)


def _millis(c: str) -> Column:
    """Epoch milliseconds of a timestamp that is meant in UTC, whatever the session's zone."""
    return F.unix_millis(F.to_timestamp(F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("Z"))))


# Change stream: event types as operations, the user as the row.
_OPS = "CASE event_type WHEN 'signup' THEN 'c' WHEN 'purchase' THEN 'u' WHEN 'error' THEN 'd' ELSE 'r' END"


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    events = sample.table(spark, sf, "events")
    row = F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), (F.col("event_id") % 7).cast("string").alias("group_id")))
    op = F.expr(_OPS)
    body = F.concat(F.lit('{"op":"'), op, F.lit('","before":'), F.when(op == "d", row).otherwise("null"), F.lit(',"after":'), F.when(op == "d", "null").otherwise(row), F.lit(',"source":{"table":"users"},"ts_ms":'), _millis("ts"), F.lit("}"))
    return events.select(F.concat(_millis("ts").cast("string"), F.lit("-"), "event_id").alias("seq"), body.alias("payload"))


_USERS = [cdc.Schema("users", ["id", "group_id"], ["id"], [("group_id", "groups")])]
_LATEST = f"l AS (SELECT * FROM (SELECT *, {_OPS} AS op, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) AS r FROM events) WHERE r = 1)"


@query(f"WITH {_LATEST} SELECT 'users:' || user_id AS name, op, (epoch_us(ts) // 1000) || '-' || event_id AS seq FROM l")
def cdc_latest(spark, sf):
    return cdc.latest(cdc.parse(_messages(spark, sf)), _USERS).select("name", "op", "seq")


@query(f"WITH {_LATEST} SELECT md5('users:' || user_id) AS id, 'id=' || user_id || ', group_id=' || (event_id % 7) AS description FROM l WHERE op <> 'd'")
def cdc_merge(spark, sf):
    changes = cdc.parse(_messages(spark, sf))
    nodes, edges = spark.createDataFrame([], model.NODE), spark.createDataFrame([], model.EDGE)
    return cdc.apply(nodes, edges, changes, _USERS, "DBS://bench/app")[0].select("id", "description")


@query(f"WITH {_LATEST} SELECT md5('users:' || user_id) AS subject_id, md5('groups:' || (event_id % 7)) AS object_id, 'new' AS kind FROM l WHERE op <> 'd' AND event_id % 7 <> 0 UNION ALL SELECT md5('users:' || user_id), md5('groups:0'), 'stale' FROM l WHERE op <> 'd' AND event_id % 7 <> 0")
def fk_diff(spark, sf):
    """Against a store in which every user is in group 0."""
    now = paths._cut(cdc.latest(cdc.parse(_messages(spark, sf)), _USERS))
    users = sample.table(spark, sf, "events").select("user_id").distinct()
    old = cdc.wanted_edges(users.select(F.lit("r").alias("op"), F.lit("users").alias("table"), F.concat(F.lit("users:"), "user_id").alias("name"), F.create_map(F.lit("group_id"), F.lit("0")).alias("row")), _USERS)
    stale, new = cdc.fk_diff(now, _USERS, old)
    return new.select("subject_id", "object_id", F.lit("new").alias("kind")).unionByName(stale.select("subject_id", "object_id", F.lit("stale").alias("kind")))


@query(f"WITH {_LATEST} SELECT DISTINCT md5('groups:' || (event_id % 7)) AS id FROM l WHERE op <> 'd'")
def cdc_placeholders(spark, sf):
    nodes, edges = spark.createDataFrame([], model.NODE), spark.createDataFrame([], model.EDGE)
    return cdc.placeholders(*cdc.apply(nodes, edges, cdc.parse(_messages(spark, sf)), _USERS, "DBS://bench/app"))


@query("SELECT CAST(max(epoch_us(ts) // 1000) AS BIGINT) AS last_event_ts, count(*) AS events_processed FROM events")
def cdc_progress(spark, sf):
    return cdc.progress(cdc.parse(_messages(spark, sf))).select("last_event_ts", "events_processed")


def _series_sql(table: str, ts: str, unit: str) -> str:
    return f"WITH c AS (SELECT date_trunc('{unit}', {ts}) AS b, count(*) AS n FROM {table} GROUP BY 1), k AS (SELECT unnest(generate_series(CAST((SELECT min(b) FROM c) AS TIMESTAMP), CAST((SELECT max(b) FROM c) AS TIMESTAMP), INTERVAL 1 {unit})) AS b) SELECT strftime(k.b, '%Y-%m-%d') AS bucket, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (ORDER BY k.b) AS BIGINT) AS running FROM k LEFT JOIN c ON k.b = c.b"


@query(_series_sql("events", "ts", "day"))
def trend_daily(spark, sf):
    return trend.series(sample.table(spark, sf, "events"), "ts").select(F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "n", "running")


@query(_series_sql("orders", "o_orderdate", "month"))
def trend_monthly(spark, sf):
    return trend.series(sample.table(spark, sf, "orders"), "o_orderdate", "month").select(F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "n", "running")


@query("SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    return trend.tumbling(sample.table(spark, sf, "events"), "ts", "6 hours", "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 4 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS n FROM g GROUP BY user_id, k""")
def events_session(spark, sf):
    return trend.sessions(sample.table(spark, sf, "events"), "ts", "4 hours", "user_id").select("user_id", _millis("start").alias("start_ms"), "n")


# Catalog of the tables.
def _catalog(spark: SparkSession, sf: str) -> catalog.Catalog:
    frames = {t: sample.table(spark, sf, t) for t, *_ in sample.LAYOUT}
    return catalog.from_frames(spark, frames, {t: k for t, k, *_ in sample.LAYOUT}, [(t, c, to, rc) for t, _, fks, _ in sample.LAYOUT for c, to, rc in fks])


@query("SELECT * FROM (VALUES ('region', 2, 0, 1, 0), ('nation', 3, 1, 2, 0), ('customer', 5, 1, 1, 0), ('supplier', 4, 1, 0, 0), ('part', 6, 0, 0, 0), ('orders', 6, 1, 0, 0)) t(table_name, n_columns, fk_out, fk_in, n_inferred)")
def catalog_cards(spark, sf):
    return catalog.cards(_catalog(spark, sf))


@query("SELECT * FROM (VALUES ('region', 'r_regionkey'), ('nation', 'n_nationkey'), ('customer', 'c_custkey'), ('supplier', 's_suppkey'), ('part', 'p_partkey'), ('orders', 'o_orderkey')) t(table_name, keys)")
def catalog_keys(spark, sf):
    return catalog.primary_keys(_catalog(spark, sf).columns).select("table_name", F.array_join("keys", ",").alias("keys"))


@query("SELECT * FROM (VALUES ('region', 0), ('nation', 1), ('customer', 2), ('supplier', 2), ('part', 0), ('orders', 3)) t(table_name, level)")
def er_levels(spark, sf):
    c = _catalog(spark, sf)
    return catalog.levels(c.tables, c.foreign)


@query("SELECT * FROM (VALUES ('customer', 'c_nationkey', 'nation'), ('supplier', 's_nationkey', 'nation'), ('nation', 'n_regionkey', 'region')) t(table_name, column_name, referenced_table)")
def schema_filter(spark, sf):
    """Keys that touch a named table at either end, without those that touch an ignored one."""
    return catalog.select_tables(_catalog(spark, sf), ["nation", "orders"], ["orders"]).foreign.select("table_name", "column_name", "referenced_table")


@query("SELECT r_name AS name, CASE WHEN r_regionkey >= 3 THEN 'deleted' WHEN r_regionkey >= 1 THEN 'extracted' END AS status FROM region")
def merge_db_status(spark, sf):
    r = sample.table(spark, sf, "region").select(F.col("r_name").alias("name"), "r_regionkey")
    return catalog.merge_status(r.where("r_regionkey < 3").select("name"), r.where("r_regionkey >= 1").select("name"))


# Document trees: each conversation as a markdown document.
def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    turns = sample.table(spark, sf, "conversations")
    part = F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit(" "), "role", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit(" ")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("t")))), lambda x: x.t), "\n")
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(body.alias("b")).select("doc_id", F.concat(F.lit("# Conversation "), F.col("doc_id").cast("string"), F.lit("\n"), "b").alias("text"))


_TURNS = "t AS (SELECT conv_id AS doc_id, turn, role, replace(text, chr(10), ' ') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)"


@query(f"WITH {_TURNS} SELECT doc_id, lpad(CAST(k + 1 AS VARCHAR), 8, '0') AS node_id, '00000001' AS parent_id, 'Turn ' || turn || ' ' || role AS title, CAST(2 * k AS INTEGER) AS line_num FROM t UNION ALL SELECT DISTINCT doc_id, '00000001', NULL, 'Conversation ' || doc_id, 1 FROM t")
def md_tree(spark, sf):
    return documents.markdown_nodes(_markdown(spark, sf)).select("doc_id", "node_id", "parent_id", "title", F.col("line_num").cast("int").alias("line_num"))


@query(f"WITH {_TURNS} SELECT doc_id, CAST(count(*) AS BIGINT) AS leaves FROM t GROUP BY doc_id")
def md_leaves(spark, sf):
    return documents.leaves(documents.markdown_nodes(_markdown(spark, sf))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("leaves"))


@query("SELECT doc_id, CAST(1 AS BIGINT) AS paragraphs FROM documents")
def txt_tree(spark, sf):
    return documents.text_nodes(sample.table(spark, sf, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"))


@query()
def segment_merge(spark, sf):
    segs = documents.segments(documents.markdown_nodes(_markdown(spark, sf)), most=500)
    return documents.merged_segments(segs, least=300, most=1000).select("doc_id", "part", F.length("text").alias("chars"))


@query()
def extract_offline(spark, sf):
    docs = sample.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("part"), "text")
    entities, _ = extraction.distinct_results(extraction.extract_segments(docs))
    return entities.select("n", "t", "c")


# Further operators of the inventory, by their keys there.
@query(f"WITH {CORE} SELECT id AS entity_id, id, name, type, datasource FROM nodes WHERE name = 'nation:3'")
def pred_eq(spark, sf):
    nodes, _ = sample.core(spark, sf)
    return nodes.where("name = 'nation:3'").select(F.col("id").alias("entity_id"), "id", "name", "type", "datasource")


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END, ''), 'Entity') AS type FROM documents")
def expr_coalesce_labels(spark, sf):
    rows = sample.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("type"))
    return graph.scan_nodes(rows)


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 OR lang <> 'en'")
def pred_not_time(spark, sf):
    docs = sample.table(spark, sf, "documents")
    kind = F.when((F.col("doc_id") % 4 == 0) & (F.col("lang") == "en"), "time").when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("lang"))
    return model.storable(docs.select("doc_id", kind.alias("type"))).select("doc_id")


@query(f"WITH {CORE} SELECT name, degree FROM nodes JOIN degree USING (id) WHERE degree >= 20")
def pred_having(spark, sf):
    return graph.count_having(*sample.core(spark, sf), 20).select("name", "degree")


@query(f"WITH {CORE} SELECT n.type AS type, count(*) AS n FROM edges JOIN nodes n ON n.id = object_id GROUP BY 1")
def join_edge_endpoints(spark, sf):
    nodes, edges = sample.core(spark, sf)
    ends = graph.with_ends(edges.drop("subject", "object"), nodes, "type")
    return ends.groupBy(F.col("object_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CORE} SELECT relationship_id, subject, object FROM edges ORDER BY 1 LIMIT 100")
def list_rels(spark, sf):
    nodes, edges = sample.core(spark, sf)
    return graph.list_relationships(edges.drop("subject", "object"), nodes).select("relationship_id", "subject", "object")


@query(f"WITH {CORE} SELECT object AS name, 'outgoing' AS direction FROM edges WHERE subject = 'nation:3' UNION ALL SELECT subject, 'incoming' FROM edges WHERE object = 'nation:3'")
def join_related_panel(spark, sf):
    nodes, edges = sample.core(spark, sf)
    return graph.related(edges, nodes, "nation:3").select("name", "direction")


@query("SELECT md5(n_name) AS src, md5(r_name) AS dst, 'in' AS type FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0")
def join_ui_endpoint(spark, sf):
    """Ends given by id or by name; those of odd nations are unknown."""
    nation, region = sample.table(spark, sf, "nation"), sample.table(spark, sf, "region")
    nodes = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name")).unionByName(region.select(F.col("r_name").alias("name"))).withColumn("id", model.entity_id("name"))
    links = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.when(F.col("n_nationkey") % 4 == 0, model.entity_id("n_name")).otherwise(F.col("n_name")).alias("source"), F.col("r_name").alias("target"), F.lit("in").alias("type"))
    return graph.links_for_display(links, nodes)


@query(f"WITH {CORE} SELECT relationship_id FROM edges WHERE starts_with(subject, 'supplier') OR starts_with(object, 'supplier')")
def join_source_rels(spark, sf):
    nodes, edges = sample.core(spark, sf)
    return graph.of_document(nodes, edges, f"{sample.DATASOURCE}/supplier").select("relationship_id")


@query("SELECT lang AS n, source AS t, min(doc_id) AS seq FROM documents GROUP BY 1, 2")
def dedup_entities(spark, sf):
    rows = sample.table(spark, sf, "documents").select(F.col("lang").alias("n"), F.col("source").alias("t"), F.col("doc_id").alias("seq"))
    return dedup.dedup_entities(rows)


@query("SELECT role AS s, CASE WHEN turn % 2 = 0 THEN 'even' ELSE 'odd' END AS p, CAST(conv_id % 5 AS VARCHAR) AS o, min(conv_id * 100 + turn) AS seq FROM conversations GROUP BY 1, 2, 3")
def dedup_edges_spo(spark, sf):
    rows = sample.table(spark, sf, "conversations").select(F.col("role").alias("s"), F.when(F.col("turn") % 2 == 0, "even").otherwise("odd").alias("p"), (F.col("conv_id") % 5).cast("string").alias("o"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"))
    return dedup.dedup_triples(rows)


@query("SELECT o_orderstatus AS src, o_orderpriority AS dst, CAST(o_custkey % 3 AS VARCHAR) AS type, min(o_orderkey) AS k FROM orders GROUP BY 1, 2, 3")
def dedup_links_ui(spark, sf):
    rows = sample.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("src"), F.col("o_orderpriority").alias("dst"), (F.col("o_custkey") % 3).cast("string").alias("type"), F.col("o_orderkey").alias("k"))
    return dedup.dedup_links(rows, "k")


@query("SELECT min(event_id) AS event_id FROM events WHERE event_id % 10 <> 0 GROUP BY user_id UNION ALL SELECT event_id FROM events WHERE event_id % 10 = 0")
def dedup_rel_id(spark, sf):
    rows = sample.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("user_id").cast("string")).alias("relationship_id"))
    return dedup.dedup_relations(rows, "event_id").select("event_id")


@query("SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey")
def agg_last_wins(spark, sf):
    return dedup.last_per(sample.table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT d AS \"offset\" FROM (SELECT p_size - p_partkey % 5 AS d, count(*) AS n, min(p_partkey) AS s FROM part GROUP BY 1) ORDER BY n DESC, s LIMIT 1")
def agg_mode_offset(spark, sf):
    rows = sample.table(spark, sf, "part").withColumn("m", F.col("p_partkey") % 5)
    return dedup.mode_offset(rows, "m", "p_size", "p_partkey")


@query("SELECT n_name AS name, n_regionkey FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) AS r FROM nation) WHERE r <= 3")
def topk_per_group(spark, sf):
    return dedup.top_per(sample.table(spark, sf, "nation"), ["n_regionkey"], 3, F.desc("n_name")).select(F.col("n_name").alias("name"), "n_regionkey")


@query()
def sample_random_n(spark, sf):
    return dedup.sample_rows(sample.table(spark, sf, "documents").select("doc_id", "lang"), 25, "doc_id")


@query(f"""WITH {TRADE}, s AS (SELECT 'degree' AS measure, n_name AS name, coalesce(d, 0) / 24.0 AS score FROM nation LEFT JOIN (SELECT name, count(*) AS d FROM (SELECT src AS name FROM strong UNION ALL SELECT dst FROM strong) GROUP BY name) ON name = n_name)
SELECT measure, name, round(score, 8) AS score FROM s ORDER BY s.score DESC, name LIMIT 10""")
def topk_centrality(spark, sf):
    scores = centrality.table(*sample.strong_trade(spark, sf), ["degree"])
    return centrality.top(scores).select("measure", "name", F.round("score", 8).alias("score"))


@query("SELECT count(*) AS partitions, CAST(avg(n) AS DOUBLE) AS mean_size, max(n) AS largest, min(n) AS smallest FROM (SELECT count(*) AS n FROM nation GROUP BY n_regionkey)")
def agg_partition_stats(spark, sf):
    nodes, edges = sample.trade(spark, sf)
    return community.partition_stats(community.undirected(edges), _regions(nodes)).drop("modularity")


@query("SELECT CAST(n_regionkey AS BIGINT) AS partition_id, count(*) AS size FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 7) GROUP BY 1")
def partition_of(spark, sf):
    nodes, _ = sample.trade(spark, sf)
    name = sample.table(spark, sf, "nation").where("n_nationkey = 7").first().n_name
    return community.partition_of(_regions(nodes), name)


@query(f"WITH {TRADE} SELECT src, dst, round(strength, 10) AS strength FROM trade")
def g_build(spark, sf):
    """Parallel edges collapse to the last one by id."""
    _, edges = sample.trade(spark, sf)
    twice = edges.withColumn("relationship_id", F.lit("b")).unionByName(edges.withColumns({"relationship_id": F.lit("a"), "strength": F.lit(0.0)}))
    return paths.build(twice).select("src", "dst", F.round("strength", 10).alias("strength"))


@query(f"""WITH {TRADE}, st AS (SELECT src, list(dst ORDER BY dst) AS o FROM strong GROUP BY src) SELECT a.src || '>' || a.dst || '>' || b.dst AS path FROM strong a JOIN strong b ON a.dst = b.src""")
def match_two_hops(spark, sf):
    from .query import match

    _, edges = sample.strong_trade(spark, sf)
    e = edges.select(F.col("src").alias("subject"), F.lit("trades").alias("predicate"), F.col("dst").alias("object"))
    return match(e, 2).select(F.concat_ws(">", "n0", "n1", "n2").alias("path"))


@query(f"WITH {CORE} SELECT md5(lower(s)) AS k FROM (SELECT name AS s FROM nodes WHERE type = 'location') WHERE s LIKE 'nation%'")
def save_edges_only(spark, sf):
    """Nation to itself by upper-cased names; relations of parts wait."""
    nodes, _ = sample.core(spark, sf)
    places = nodes.where("type = 'location'")
    rels = nodes.where("name LIKE 'nation%' OR name LIKE 'part:1%'").select(F.upper("name").alias("s"), F.lit("same as").alias("p"), F.col("name").alias("o"))
    return store.save_edges_only(rels, places)[0].select(F.col("subject_id").alias("k"))


@query("SELECT 'nation:' || n_nationkey AS name, n_name AS description FROM nation")
def upsert_entity(spark, sf):
    """An upsert overwrites all properties of the rows it names."""
    rows = sample.table(spark, sf, "nation")
    name = F.concat(F.lit("nation:"), "n_nationkey")
    old = rows.select(model.entity_id(name).alias("id"), name.alias("name"), F.lit("old").alias("description"))
    return store.merge(old, rows.select(model.entity_id(name).alias("id"), name.alias("name"), F.col("n_name").alias("description")), "id").drop("id")


@query("SELECT r_name, CASE WHEN r_regionkey = 2 THEN 'seen' ELSE 'new' END AS state FROM region")
def update_entity(spark, sf):
    rows = sample.table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("id"), "r_name", F.lit("new").alias("state"))
    return store.update_entity(rows, "2", {"state": "seen"}).drop("id")


@query(f"WITH {CORE} SELECT id FROM nodes WHERE name <> 'nation:3'")
def delete_entity(spark, sf):
    nodes, edges = sample.core(spark, sf)
    return store.detach_delete(nodes, edges, nodes.where("name = 'nation:3'"))[0].select("id")


@query("SELECT CASE WHEN r_regionkey = 0 THEN 'repeated name' ELSE 'type is not stored' END AS reason, CASE WHEN r_regionkey = 0 THEN (SELECT count(*) - count(DISTINCT n_regionkey) FROM nation WHERE n_nationkey % 2 = 0) ELSE (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 1) END AS count FROM region WHERE r_regionkey < 2")
def batch_rejects(spark, sf):
    rows = sample.table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("name"), F.when(F.col("n_nationkey") % 2 == 1, "time").otherwise("place").alias("type"))
    return store.rejected(rows)


@query("SELECT name FROM (SELECT 'database_' || r_regionkey AS name FROM region UNION ALL SELECT 'app')")
def list_databases(spark, sf):
    own = sample.table(spark, sf, "region").select(F.concat(F.lit("database_"), "r_regionkey").alias("name"))
    return catalog.user_databases(own.unionByName(spark.createDataFrame([("app",), ("mysql",), ("sys",)], "name string")), "mysql")


@query("SELECT CAST(r_regionkey AS BIGINT) AS id, r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 10) AS has_schema FROM region")
def conn_list(spark, sf):
    conns = sample.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"))
    tables = sample.table(spark, sf, "nation").where("n_nationkey < 10").select(F.col("n_regionkey").cast("long").alias("connection_id"))
    return catalog.with_schema_flag(conns, tables)


@query("SELECT * FROM (VALUES ('nation', 'n_regionkey', 0), ('customer', 'c_nationkey', 0), ('supplier', 's_nationkey', 0), ('orders', 'o_custkey', 0)) t(table_name, column_name, lane)")
def win_lane_index(spark, sf):
    return catalog.lanes(_catalog(spark, sf).foreign).select("table_name", "column_name", "lane")


# Paged documents: a conversation's turns as pages, its user turns as sections.
def _paged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    turns = sample.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.dense_rank().over(Window.partitionBy("conv_id").orderBy("turn")).alias("page"), "role", "text")
    entries = turns.where("role = 'user'").withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    outline = entries.select("doc_id", "ord", F.col("ord").cast("string").alias("structure"), F.substring("text", 1, 10).alias("title"), F.col("page").alias("physical_index"), F.lit("yes").alias("appear_start"))
    return outline, turns.select("doc_id", "page", "text")


_PAGED = """p AS (SELECT conv_id AS doc_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS page, role, text FROM conversations),
o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS ord, page FROM p WHERE role = 'user'), l AS (SELECT doc_id, max(page) AS last FROM p GROUP BY 1),
s AS (SELECT o.doc_id, ord, page AS start_index, greatest(coalesce(lead(page) OVER (PARTITION BY o.doc_id ORDER BY ord) - 1, last), page) AS end_index FROM o JOIN l ON o.doc_id = l.doc_id)"""


@query(f"WITH {_PAGED} SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(start_index AS INTEGER) AS start_index, CAST(end_index AS INTEGER) AS end_index FROM s")
def win_end_index(spark, sf):
    return documents.sections(*_paged(spark, sf)).select("doc_id", "ord", "start_index", "end_index")


@query(f"WITH {_PAGED} SELECT s.doc_id, CAST(s.ord AS INTEGER) AS ord, md5(string_agg(text, '' ORDER BY page)) AS hash FROM s JOIN p ON s.doc_id = p.doc_id AND page BETWEEN start_index AND end_index GROUP BY 1, 2")
def node_text(spark, sf):
    outline, pages = _paged(spark, sf)
    return documents.node_text(documents.sections(outline, pages), pages).select("doc_id", "ord", F.md5(F.col("text").cast("binary")).alias("hash"))


@query(f"WITH {_PAGED} SELECT doc_id, min(page) > 1 AS preface FROM o GROUP BY 1")
def pdf_preface(spark, sf):
    outline, _ = _paged(spark, sf)
    return documents.with_preface(outline).groupBy("doc_id").agg(F.bool_or(F.col("title") == "Preface").alias("preface"))


@query(f"WITH {_PAGED}, k AS (SELECT doc_id, ord, CASE WHEN ord % 2 = 1 THEN page END AS known FROM o) SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(last_value(known IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS page_before, CAST(first_value(known IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS INTEGER) AS page_after FROM k")
def win_prev_next_known(spark, sf):
    outline, _ = _paged(spark, sf)
    gaps = outline.withColumn("physical_index", F.when(F.col("ord") % 2 == 1, F.col("physical_index")))
    return documents.known_neighbours(gaps).select("doc_id", "ord", "page_before", "page_after")


@query("SELECT doc_id, CAST(len([x for x in string_split_regex(text, '[\\s,，。！？?!、；;：:\"''（）()的]+') if length(x) >= 2]) AS BIGINT) AS n FROM documents")
def fn_split_tokens(spark, sf):
    return sample.table(spark, sf, "documents").select("doc_id", F.size(fn.keywords("text")).cast("long").alias("n"))


@query("SELECT page_id, 'DOC' AS kind, 'u' || page_id % 10 AS uuid, 'p/' || page_id AS path FROM pages")
def fn_uri_parse(spark, sf):
    uri = model.uri("DOC", F.concat(F.lit("u"), (F.col("page_id") % 10).cast("string")), F.lit("p"), F.col("page_id").cast("string"))
    return sample.table(spark, sf, "pages").select("page_id", uri.alias("u")).select("page_id", *[model.uri_part("u", p).alias(p) for p in ("kind", "uuid", "path")])


@query("SELECT event_id, CAST(event_id AS INTEGER) AS page, CASE WHEN event_id % 2 = 0 THEN '1.' || event_id END AS parent, lpad(CAST(event_id AS VARCHAR), 8, '0') AS node FROM events")
def fn_tags_and_codes(spark, sf):
    code = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("1."), F.col("event_id").cast("string"), F.lit(".3"))).otherwise("7")
    return sample.table(spark, sf, "events").select("event_id", fn.page_of_tag(fn.page_tag("event_id")).alias("page"), fn.parent_code(code).alias("parent"), fn.node_number("event_id").alias("node"))


@query("SELECT count(CASE WHEN n_chars > 2000 THEN 1 END) AS n_document, count(CASE WHEN n_chars <= 2000 THEN 1 END) AS n_entity, CAST(0 AS BIGINT) AS n_relation, CAST(0 AS BIGINT) AS n_database FROM documents")
def agg_summary_counts(spark, sf):
    rows = sample.table(spark, sf, "documents").select(F.when(F.col("n_chars") > 2000, "document").otherwise("entity").alias("source_type"))
    return retrieval.counts(rows)


@query("SELECT lang, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def agg_context_chars(spark, sf):
    return sample.table(spark, sf, "documents").groupBy("lang").agg(F.sum(fn.context_tokens("text")).cast("long").alias("tokens"))


# The same on the whole trade graph, and hops and paths on the core graph from a region down and from an order up.
def _whole(name: str) -> str:
    return ORACLES[name].replace("strong s ", "trade s ").replace("FROM strong", "FROM trade")


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("name", F.round("score", 8).alias("score"))


@query(_whole("bfs_hops"))
def trade_hops(spark, sf):
    nodes, edges = sample.trade(spark, sf)
    return paths.hops(edges.cache(), nodes.agg(F.min("name")).first()[0])


def _distance_sql(rounds: int) -> str:
    steps = ["b0 AS MATERIALIZED (SELECT min(n_name) AS node, CAST(0 AS DOUBLE) AS d FROM nation)"]
    for i in range(1, rounds + 1):
        p = f"b{i - 1}"
        steps.append(f"b{i} AS MATERIALIZED (SELECT node, min(d) AS d FROM (SELECT * FROM {p} UNION ALL SELECT dst, d + strength FROM {p} JOIN trade ON src = node) GROUP BY node)")
    return f"WITH {TRADE}, {', '.join(steps)} SELECT node, round(d, 8) AS distance FROM b{rounds}"


@query(_distance_sql(24))
def trade_distance(spark, sf):
    nodes, edges = sample.trade(spark, sf)
    return paths.distances(edges.cache(), nodes.agg(F.min("name")).first()[0]).select("node", F.round("distance", 8).alias("distance"))


@query(_whole("k_shortest_paths").replace("len(w.path) < 8", "len(w.path) < 4"))
def trade_k_paths(spark, sf):
    nodes, edges = sample.trade(spark, sf)
    ends = nodes.agg(F.min("name"), F.max("name")).first()
    return paths.shortest_paths(edges.cache(), ends[0], ends[1], 5).select(F.array_join("path", ">").alias("path"), F.col("length").cast("int").alias("length"))


@query(f"WITH RECURSIVE {CORE}, walk AS (SELECT 'region:0' AS node, 0 AS hops UNION ALL SELECT e.subject, w.hops + 1 FROM walk w JOIN edges e ON e.object = w.node) SELECT node, hops FROM walk")
def core_hops(spark, sf):
    _, edges = sample.core(spark, sf)
    return paths.hops(edges.select(F.col("object").alias("src"), F.col("subject").alias("dst")).cache(), "region:0")


@query(f"""WITH RECURSIVE {CORE}, walk AS (SELECT ['orders:' || (SELECT min(o_orderkey) FROM orders)] AS path UNION ALL SELECT list_append(w.path, e.object) FROM walk w JOIN edges e ON e.subject = w.path[-1])
SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS length FROM walk WHERE starts_with(path[-1], 'region:')""")
def core_k_paths(spark, sf):
    _, edges = sample.core(spark, sf)
    up = edges.select(F.col("subject").alias("src"), F.col("object").alias("dst")).cache()
    first = f"orders:{sample.table(spark, sf, 'orders').agg(F.min('o_orderkey')).first()[0]}"
    last = paths.hops(up, first).where("startswith(node, 'region:')").first().node
    return paths.shortest_paths(up, first, last, 5).select(F.array_join("path", ">").alias("path"), F.col("length").cast("int").alias("length"))


@query(_whole("degree_centrality"))
def trade_degree(spark, sf):
    return _rounded(centrality.degree(*sample.trade(spark, sf)))


def _unrolled(sql: str) -> str:
    return re.sub(r"\b([reu]\d+) AS \(", r"\1 AS MATERIALIZED (", sql.replace("FROM strong", "FROM trade").replace("JOIN strong", "JOIN trade"))


@query(_unrolled(_pagerank_sql(20)))
def pagerank_20(spark, sf):
    nodes, edges = sample.trade(spark, sf)
    return _rounded(centrality.pagerank(nodes.cache(), edges.cache(), iterations=20))


@query(_unrolled(_eigen_sql(20)))
def eigenvector_20(spark, sf):
    nodes, edges = sample.trade(spark, sf)
    return _rounded(centrality.eigenvector(nodes.cache(), edges.cache(), iterations=20))


@query(_whole("closeness"))
def trade_closeness(spark, sf):
    return _rounded(centrality.closeness(*sample.trade(spark, sf)))


@query(_BETWEEN.replace("JOIN strong", "JOIN trade"))
def trade_betweenness(spark, sf):
    return _rounded(centrality.betweenness(*sample.trade(spark, sf)))


@query()
def trade_kmeans_degree(spark, sf):
    return community.kmeans(*sample.trade(spark, sf))


@query(_whole("topk_centrality"))
def trade_topk_centrality(spark, sf):
    scores = centrality.table(*sample.trade(spark, sf), ["degree"])
    return centrality.top(scores).select("measure", "name", F.round("score", 8).alias("score"))
