"""Queries of the stored index, of retrieval over the graph, and of a graph that grows with the tables, with the same in SQL; they are added to those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query as pattern
from .cache import ResultCache
from .operators import centrality, community, paths, retrieval
from .operators.textindex import TextIndex
from .operators.store import GraphStore
from .plans import extraction, sample
from .queries import _USERS, CORE, ORACLES, _messages, query
from .streaming import cdc


# Full text.
@query(ORACLES["full_text_ranked"].replace("SELECT name, type, score", "SELECT name, type, score"))
def fts_index(spark, sf):
    """The ten best of all nodes from a stored index: half of the nodes are built in, the rest and some repeats come as updates."""
    nodes = paths._cut(sample.core(spark, sf)[0].select("id", "name", "type"), rows=sample.table(spark, sf, "orders").count())
    index = TextIndex(spark, paths._folder(spark), fields=("name",))
    later = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    index.build(nodes.where(~later).unionByName(nodes.where(later).withColumn("name", F.lit("nation 7 7"))))
    index.update(nodes.where(later))
    return index.search("nation 7").withColumnRenamed("key", "id").join(nodes, "id").select("name", "type", F.round("score", 6).alias("score"))


_WORDS = r"""w AS (SELECT id, unnest([x for x in regexp_split_to_array(lower(name || ' ' || datasource), '[^\p{L}\p{N}]+') if x <> '']) AS term FROM nodes),
sz AS (SELECT id, count(*) AS size FROM w GROUP BY 1), tf AS (SELECT id, term, count(*) AS tf FROM w WHERE term IN ('nation', '7') GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), f AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT sum(size) FROM sz) / (SELECT count(*) FROM nodes) AS mean),
hit AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM tf JOIN df USING (term) JOIN sz USING (id), f GROUP BY id)"""


@query(f"WITH {CORE}, {_WORDS} SELECT name, round(score, 6) AS score, count(*) OVER () AS total FROM hit JOIN nodes USING (id) WHERE type = 'location' ORDER BY hit.score DESC, id LIMIT 10 OFFSET 3")
def fts_page(spark, sf):
    """Ten of the places that a text finds, after the first three; rarity is that of all nodes."""
    nodes = sample.core(spark, sf)[0].select("id", "name", "type", "datasource", F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("byname"))
    page, total = retrieval.full_text_page(nodes, "nation 7", 10, 3, "location")
    return page.select("name", F.round("score", 6).alias("score"), F.lit(total).cast("long").alias("total"))


# Retrieval over the graph.
_URIS = ", ".join(f"('{sample.DATASOURCE}/{t}')" for t, *_ in sample.LAYOUT)


@query(f"""WITH {CORE}, u(uri) AS (VALUES {_URIS}, ('{sample.DATASOURCE}/n')),
under AS (SELECT id, name FROM (SELECT id, name, row_number() OVER (PARTITION BY uri ORDER BY id) AS r FROM nodes JOIN u ON starts_with(datasource, uri)) WHERE r <= 100),
found AS (SELECT DISTINCT id, name FROM under), chosen AS (SELECT DISTINCT name FROM found ORDER BY name LIMIT 50),
ways AS (SELECT subject AS a, relationship_id FROM edges UNION ALL SELECT object, relationship_id FROM edges),
near AS (SELECT a, relationship_id FROM ways WHERE a IN (SELECT name FROM chosen) ORDER BY relationship_id, a LIMIT 200)
SELECT 'entity' AS source_type, id AS source_id, CAST(0.9 AS DOUBLE) AS score FROM found UNION ALL SELECT DISTINCT 'relation', relationship_id, CAST(0.7 AS DOUBLE) FROM near""")
def ret_graph_doc(spark, sf):
    """Entities under many addresses, of which one begins others, and their relations."""
    nodes, edges = sample.core(spark, sf)
    uris = spark.createDataFrame([(f"{sample.DATASOURCE}/{t}",) for t, *_ in sample.LAYOUT] + [(f"{sample.DATASOURCE}/n",)], "uri string")
    return retrieval.from_graph(nodes, edges, uris, "", []).select("source_type", "source_id", "score")


@query(f"""WITH {CORE}, {_WORDS}, found AS (SELECT id, name, hit.score FROM hit JOIN nodes USING (id) ORDER BY hit.score DESC, id LIMIT 15),
chosen AS (SELECT DISTINCT name FROM found ORDER BY name LIMIT 5), ways AS (SELECT subject AS a, relationship_id FROM edges UNION ALL SELECT object, relationship_id FROM edges),
near AS (SELECT a, relationship_id FROM ways WHERE a IN (SELECT name FROM chosen) ORDER BY relationship_id, a LIMIT 200)
SELECT 'entity' AS source_type, id AS source_id, round(CASE WHEN name = 'nation:7' THEN 1.0 ELSE least(1.0, least(1.0, score) + 0.5) END, 6) AS score FROM found
UNION ALL SELECT DISTINCT 'relation', relationship_id, CAST(0.7 AS DOUBLE) FROM near""")
def ret_graph(spark, sf):
    """Without addresses: entities by full text, a named one for certain, and their relations."""
    nodes, edges = sample.core(spark, sf)
    nodes = nodes.select("id", "name", "type", "datasource", F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("byname"))
    return retrieval.from_graph(nodes, edges, None, "nation 7", ["Nation:7"]).select("source_type", "source_id", F.round("score", 6).alias("score"))


@query(f"""WITH {CORE}, asked AS (SELECT 'nation:' || n_nationkey AS name FROM nation UNION SELECT 'nation:1' UNION SELECT 'suppl' UNION SELECT 'part:' UNION SELECT 'customer:none' UNION SELECT 'nobody'),
exact AS (SELECT a.name, n.name AS node FROM asked a JOIN nodes n ON n.name = a.name), rest AS (SELECT name FROM asked WHERE name NOT IN (SELECT name FROM exact)),
begun AS (SELECT r.name, n.name AS node FROM rest r JOIN nodes n ON starts_with(n.name, r.name)),
last AS (SELECT r.name, n.name AS node FROM rest r JOIN nodes n ON contains(r.name, ':') AND starts_with(n.name, split_part(r.name, ':', 1) || ':') WHERE r.name NOT IN (SELECT name FROM begun)),
chosen AS (FROM exact UNION ALL FROM begun UNION ALL FROM last),
ways AS (SELECT subject AS a, object AS b, relationship_id FROM edges UNION ALL SELECT object, subject, relationship_id FROM edges)
SELECT name, source, target, relationship_id FROM (SELECT name, a AS source, b AS target, relationship_id, row_number() OVER (PARTITION BY name ORDER BY relationship_id, a) AS r FROM chosen JOIN ways ON a = node) WHERE r <= 30""")
def ret_graph_legacy(spark, sf):
    """Relations of names: the node's own, else those of nodes that the name begins, else those of its table."""
    nodes, edges = sample.core(spark, sf)
    asked = sample.table(spark, sf, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("name"))
    asked = asked.unionByName(spark.createDataFrame([("nation:1",), ("suppl",), ("part:",), ("customer:none",), ("nobody",)], "name string"))
    return retrieval.expand_cascade(nodes, edges, asked).select("name", "source", "target", "relationship_id")


@query("""WITH e AS (SELECT 'document_' || (row_number() OVER (ORDER BY least(1.0, n_chars / 10000.0 + 0.05) DESC, 'd' || doc_id) - 1) AS evidence_id, 'about ' || doc_id AS summary, least(1.0, n_chars / 10000.0 + 0.05) AS score FROM documents),
t AS (SELECT *, length('{"evidence_id":"' || evidence_id || '","summary":"' || summary || '","score":}') + 16 AS size FROM e),
s AS (SELECT *, sum(size) OVER (ORDER BY score DESC, evidence_id) AS used FROM t) SELECT evidence_id, summary FROM s WHERE used <= 20000""")
def ctx_prompt(spark, sf):
    """Evidence that fits a prompt's budget, best first; scores are set to a fixed width, so that lines have one length in every engine."""
    docs = sample.table(spark, sf, "documents")
    content = F.map_from_arrays(F.array(F.lit("summary")), F.array(F.concat(F.lit("about "), "doc_id")))
    ev = docs.select(F.lit("document").alias("source_type"), F.concat(F.lit("d"), "doc_id").alias("source_id"), content.alias("content"), (F.col("n_chars") / 10000.0).alias("score"))
    fused = retrieval.fuse(ev, ["no such entity"]).withColumn("score", F.rpad(F.col("score").cast("decimal(12,10)").cast("string"), 14, "0"))
    rows = retrieval.prompt_rows(fused, 20_000)
    return rows.select("evidence_id", F.get_json_object("line", "$.summary").alias("summary"))


# Patterns of variable length.
_WALKS = "walk AS (SELECT subject AS n0, object AS n1, 1 AS hops FROM edges UNION ALL SELECT w.n0, e.object, w.hops + 1 FROM walk w JOIN edges e ON e.subject = w.n1)"


@query(f"WITH RECURSIVE {CORE}, {_WALKS} SELECT n0, n1, hops FROM walk")
def match_any_hops(spark, sf):
    """All paths of the core graph, of any length."""
    return pattern.match_paths(sample.core(spark, sf)[1]).select("n0", "n1", "hops")


@query(f"WITH RECURSIVE {CORE}, {_WALKS} SELECT n0, n1, hops FROM walk WHERE hops BETWEEN 2 AND 3 AND starts_with(n0, 'orders:')")
def match_two_to_three(spark, sf):
    """Paths of two or three hops from the orders."""
    nodes, edges = sample.core(spark, sf)
    return pattern.match_paths(edges, 2, 3, start=nodes.where("startswith(name, 'orders:')")).select("n0", "n1", "hops")


# A graph that grows with the tables.
SUPPLY = """half AS MATERIALIZED (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, count(*)::DOUBLE AS strength FROM lineitem GROUP BY 1, 2),
edges AS MATERIALIZED (FROM half UNION ALL SELECT dst, src, strength FROM half),
nodes AS MATERIALIZED (SELECT 's' || s_suppkey AS name, 'supplier' AS type, s_nationkey::BIGINT AS partition_id FROM supplier UNION ALL SELECT 'p' || p_partkey, 'part', (p_partkey % 25)::BIGINT FROM part)"""


def _supply_rank(rounds: int) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT name, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS score FROM nodes)", "o AS MATERIALIZED (SELECT src, count(*) AS n FROM edges GROUP BY 1)"]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        steps.append(f"d{i} AS MATERIALIZED (SELECT coalesce(sum(score), 0) AS v FROM {p} WHERE name NOT IN (SELECT src FROM o))")
        steps.append(f"f{i} AS MATERIALIZED (SELECT dst, sum(score / n) AS v FROM {p} JOIN edges ON src = name JOIN o USING (src) GROUP BY 1)")
        steps.append(f"r{i} AS MATERIALIZED (SELECT name, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (coalesce(f.v, 0) + d.v / (SELECT count(*) FROM nodes)) AS score FROM {p} LEFT JOIN f{i} f ON dst = name, d{i} d)")
    return f"WITH {SUPPLY}, {', '.join(steps)} SELECT name, round(score, 9) AS score FROM r{rounds}"


@query(_supply_rank(5))
def supply_pagerank(spark, sf):
    return centrality.pagerank(*sample.supply(spark, sf), iterations=5).select("name", F.round("score", 9).alias("score"))


@query(f"WITH {SUPPLY} SELECT name, round(coalesce(d, 0) / ((SELECT count(*) FROM nodes) - 1), 9) AS score FROM nodes LEFT JOIN (SELECT name, count(*) AS d FROM (SELECT src AS name FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) USING (name)")
def supply_degree(spark, sf):
    return centrality.degree(*sample.supply(spark, sf)).select("name", F.round("score", 9).alias("score"))


def _supply_parts(spark, sf):
    nodes, edges = sample.supply(spark, sf)
    return community.undirected(edges), nodes.select("name", F.col("group").alias("partition_id"))


@query(f"""WITH {SUPPLY}, p AS (SELECT strength AS w, a.partition_id AS pa, b.partition_id AS pb FROM half JOIN nodes a ON a.name = src JOIN nodes b ON b.name = dst), m AS (SELECT 2 * sum(w) AS m2 FROM p),
i AS (SELECT pa AS c, sum(2 * w) AS v FROM p WHERE pa = pb GROUP BY 1), t AS (SELECT c, sum(w) AS v FROM (SELECT pa AS c, w FROM p UNION ALL SELECT pb, w FROM p) GROUP BY 1)
SELECT round(sum(coalesce(i.v, 0) / m2 - (t.v / m2) * (t.v / m2)), 9) AS modularity FROM t LEFT JOIN i USING (c), m""")
def supply_modularity(spark, sf):
    return community.modularity(*_supply_parts(spark, sf)).select(F.round("modularity", 9).alias("modularity"))


@query(f"""WITH {SUPPLY} SELECT least(a.partition_id, b.partition_id) AS a, greatest(a.partition_id, b.partition_id) AS b, sum(strength) AS weight
FROM half JOIN nodes a ON a.name = src JOIN nodes b ON b.name = dst WHERE a.partition_id <> b.partition_id GROUP BY 1, 2""")
def supply_meta_graph(spark, sf):
    return community.meta_graph(*_supply_parts(spark, sf))[1]


@query("""WITH home AS (SELECT 'nation:' || n_nationkey AS name, n_nationkey AS r FROM nation UNION ALL SELECT 'customer:' || c_custkey, c_nationkey FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, s_nationkey FROM supplier),
size AS (SELECT r, CAST(row_number() OVER (ORDER BY count(*) DESC, min(name)) - 1 AS BIGINT) AS partition_id FROM home GROUP BY r)
SELECT name, partition_id FROM home JOIN size USING (r) UNION ALL SELECT name, (SELECT count(*) FROM size) FROM (SELECT 'part:' || p_partkey AS name FROM part UNION ALL SELECT 'region:' || r_regionkey FROM region)""")
def core_spectral(spark, sf):
    """Partitions of all customers, suppliers and nations by where they live: one a nation, and one of the parts and regions, which have no such edges."""
    return community.spectral(*_homes(spark, sf), 26)


def _homes(spark, sf):
    """Written once, as the loops read them again and again."""
    nodes, edges = sample.core(spark, sf)
    links = edges.select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.lit(1.0).alias("weight")).where("startswith(dst, 'nation:')")
    rows = sample.table(spark, sf, "orders").count()
    return paths._cut(nodes.where("type <> 'event'").select("name"), rows=rows), paths._cut(links, rows=rows)


_HOMES = """home AS (SELECT 'nation:' || n_nationkey AS name, n_nationkey AS r FROM nation UNION ALL SELECT 'customer:' || c_custkey, c_nationkey FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, s_nationkey FROM supplier), alone AS (SELECT 'part:' || p_partkey AS name FROM part UNION ALL SELECT 'region:' || r_regionkey FROM region)"""


@query(f"""WITH {_HOMES}, all_nodes AS (SELECT name, 'n' || r AS c FROM home UNION ALL SELECT name, name FROM alone),
size AS (SELECT c, CAST(row_number() OVER (ORDER BY count(*) DESC, min(name)) - 1 AS BIGINT) AS partition_id FROM all_nodes GROUP BY c) SELECT name, partition_id FROM all_nodes JOIN size USING (c)""")
def core_louvain(spark, sf):
    """Louvain as joins over all customers, suppliers and nations: a star a nation, whose union no move betters; nodes without edges are partitions of their own."""
    return community.label_rounds(*_homes(spark, sf))


@query(f"""WITH {_HOMES}, d AS (SELECT name, CASE WHEN starts_with(name, 'nation:') THEN 'hub' ELSE 'other' END AS c FROM (SELECT name FROM home UNION ALL FROM alone))
SELECT name, min(name) OVER (PARTITION BY c) AS least FROM d""")
def core_kmeans(spark, sf):
    """Two partitions by degree: nations, and what has one edge or none; each named by its least node."""
    parts = community.kmeans(*_homes(spark, sf), k=2)
    least = parts.groupBy("partition_id").agg(F.min("name").alias("least"))
    return parts.join(least, "partition_id").select("name", "least")


@query()
def supply_closeness(spark, sf):
    """Closeness by sketches; the error is bounded in the tests."""
    return centrality.closeness_sketched(*sample.supply(spark, sf), bits=10)


# The store, the stream and the cache at work.
@query(ORACLES["cdc_merge"])
def cdc_follow(spark, sf):
    """The follower's store after three batches, of which later ones bring older events as well: as if all had come in order."""
    folder = paths._folder(spark)
    follower = cdc.Follower(GraphStore(spark, folder), _USERS, "DBS://bench/app", f"{folder}/checkpoint")
    messages = _messages(spark, sf).withColumn("batch", F.pmod(F.xxhash64("seq"), F.lit(3)))
    for i in range(3):
        follower.batch(messages.where(F.col("batch") == i).drop("batch"), i)
    return follower.store.nodes.select("id", "description")


@query(ORACLES["import_nodes"])
def export_graph(spark, sf):
    """The core graph stored, a part of it taken away and put back, exported as JSON and read again."""
    folder = paths._folder(spark)
    store = GraphStore(spark, f"{folder}/graph")
    nodes, edges = sample.core(spark, sf)
    store.write_all({"nodes": nodes, "edges": edges.drop("subject", "object")})
    some = paths._cut(store.nodes.where("type = 'location'"))  # as stored, not derived from the tables again
    store.delete(some)
    store.upsert("nodes", some)
    store.export(f"{folder}/export")
    return spark.read.schema(nodes.schema).json(f"{folder}/export/nodes").select("id", "name", "type", "datasource")


@query(f"WITH {CORE} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def cached_counts(spark, sf):
    """Counts by type, asked twice; the second answer comes from the kept result and reads none of the tables."""
    nodes, _ = sample.core(spark, sf)
    kept = ResultCache(spark, paths._folder(spark))
    ask = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    kept.get(ask, "1")
    return kept.get(ask, "1")


def _inner(name: str) -> str:
    return f"(SELECT * FROM ({ORACLES[name]}))"


@query(f"SELECT name, a.score AS degree, b.score AS closeness, c.score AS betweenness FROM {_inner('degree_centrality')} a JOIN {_inner('closeness')} b USING (name) JOIN {_inner('betweenness')} c USING (name)")
def g_centrality_table(spark, sf):
    nodes, edges = sample.strong_trade(spark, sf)
    got = centrality.table(nodes.cache(), edges.cache(), ["degree", "closeness", "betweenness"])
    return got.select("name", *[F.round(c, 8).alias(c) for c in ("degree", "closeness", "betweenness")])


# Extraction from recorded answers.
@query("""SELECT o_orderkey AS doc_id, 'entity' AS kind, 'o' || o_orderkey AS n, NULL AS s FROM orders WHERE o_orderkey % 5 <> 4 UNION ALL
SELECT o_orderkey, 'relation', NULL, 'o' || o_orderkey FROM orders WHERE o_orderkey % 5 <> 4 UNION ALL SELECT o_orderkey, 'error', 'an answer that is no JSON object', NULL FROM orders WHERE o_orderkey % 5 = 4""")
def fn_json_aliases(spark, sf):
    """Answers under all names that the lists may have, in fences, broken off or no JSON at all."""
    name = F.concat(F.lit("o"), "o_orderkey")
    entity, relation = F.concat(F.lit('[{"n": "'), name, F.lit('", "t": "order", "c": 1}]')), F.concat(F.lit('[{"s": "'), name, F.lit('", "p": "of", "o": "x"}]'))
    forms = [('{"entities": ', ', "relationships": ', "}"), ('```json\n{"entity": ', ', "relations": ', "}\n```"), ('{"relation": ', ', "entity": ', "}"), ('{"entity": ', ', "relation": ', "")]
    text = F.lit("I cannot say")
    for i, (a, b, c) in enumerate(forms):
        first, second = (relation, entity) if "relation" in a else (entity, relation)
        text = F.when(F.col("o_orderkey") % 5 == i, F.concat(F.lit(a), first, F.lit(b), second, F.lit(c))).otherwise(text)
    answers = sample.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("part"), text.alias("text"))
    return extraction.extract_segments(answers, lambda answer: answer).select("doc_id", "kind", "n", "s")


@query(r"SELECT DISTINCT split_part(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), ' ', 1) AS n FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') <> ''")
def ex_entities(spark, sf):
    """The first word of each turn, as a model would answer it; distinct over all turns."""
    turns = sample.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("part"), "text")
    answer = lambda text: {"entities": [{"n": w, "t": "word", "c": 1} for w in text.split()[:1]], "relationships": []}
    return extraction.distinct_results(extraction.extract_segments(turns, answer))[0].select("n")
