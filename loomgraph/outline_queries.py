"""Queries of document outlines, recorded descriptions of schemas, and communities, with the same in SQL; they are added to those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import catalog
from .functions import text as fn
from .index_queries import SUPPLY
from .operators import community, paths
from .plans import annotate, documents, sample
from .queries import _TURNS, _markdown, query


# Books of a region: a chapter a nation, a block every five of its customers, a page a customer.
_BOOK = """c AS (SELECT n_regionkey::BIGINT AS doc_id, n_nationkey AS nation, 'Chapter ' || n_name AS chapter, c_custkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS i,
row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, c_custkey) AS page FROM customer JOIN nation ON c_nationkey = n_nationkey),
b AS (SELECT *, (i - 1) // 5 + 1 AS b, (i - 1) % 5 + 1 AS j, 'Block ' || nation || ' ' || ((i - 1) // 5 + 1) AS block, 'Customer ' || lpad(c_custkey::VARCHAR, 9, '0') AS title FROM c),
p AS (SELECT *, floor((length(CASE WHEN j = 1 THEN nation || '.' || b || ' ' || block || chr(10) ELSE '' END || nation || '.' || b || '.' || j || ' ' || title || chr(10)) + 5 * (20 + c_custkey % 40)) / 4)::BIGINT AS tokens FROM b)"""


def _book(spark, sf) -> DataFrame:
    rows = sample.table(spark, sf, "customer").join(sample.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    i = F.row_number().over(Window.partitionBy("n_nationkey").orderBy("c_custkey"))
    page = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name", "c_custkey"))
    rows = rows.select(F.col("n_regionkey").cast("long").alias("doc_id"), "n_nationkey", "n_name", "c_custkey", i.alias("i"), page.alias("page"))
    number = F.concat_ws(".", "n_nationkey", F.floor((F.col("i") - 1) / 5) + 1)
    place = (F.col("i") - 1) % 5 + 1
    block = F.concat(number, F.lit(" Block "), "n_nationkey", F.lit(" "), F.floor((F.col("i") - 1) / 5) + 1, F.lit("\n"))
    own = F.concat(number, F.lit("."), place, F.lit(" Customer "), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("\n"))
    text = F.concat(F.when(place == 1, block).otherwise(""), own, F.repeat(F.lit("word "), F.lit(20) + F.col("c_custkey").cast("int") % 40))
    return rows.withColumn("text", text)


@query(f"""WITH {_BOOK}, ch AS (SELECT doc_id, nation, chapter, min(page) AS s, max(page) AS e, sum(tokens) AS t FROM p GROUP BY ALL),
cl AS (SELECT *, e - s > 4 AND t >= 250 AS large FROM ch),
bl AS (SELECT doc_id, nation, block, b, min(page) AS s FROM p GROUP BY ALL),
be AS (SELECT bl.*, cl.e AS ce, coalesce(lead(bl.s) OVER (PARTITION BY nation ORDER BY bl.b), cl.e) AS e FROM bl JOIN cl USING (doc_id, nation) WHERE large),
bt AS (SELECT be.doc_id, be.nation, be.block, be.b, be.s, be.e, sum(p.tokens) AS t FROM be JOIN p ON p.doc_id = be.doc_id AND p.page BETWEEN be.s AND be.e GROUP BY ALL),
bk AS (SELECT *, e - s > 4 AND t >= 250 AS large FROM bt),
cu AS (SELECT p.doc_id, p.title, p.page AS s, coalesce(lead(p.page) OVER (PARTITION BY p.nation, p.b ORDER BY p.j), bk.e) AS next, p.page, bk.block, p.b, p.j FROM p JOIN bk ON p.nation = bk.nation AND p.b = bk.b WHERE bk.large)
SELECT doc_id, chapter AS title, NULL AS above, s::INTEGER AS start_index, (CASE WHEN large THEN s ELSE e END)::INTEGER AS end_index FROM cl
UNION ALL SELECT bk.doc_id, block, chapter, bk.s::INTEGER, (CASE WHEN bk.large THEN bk.s ELSE bk.e END)::INTEGER FROM bk JOIN cl USING (doc_id, nation)
UNION ALL SELECT doc_id, title, block, s::INTEGER, next::INTEGER FROM cu""")
def pdf_split_large(spark, sf):
    """Chapters that are long in pages and tokens are split into blocks, long blocks into customers; all others stay whole."""
    pages = _book(spark, sf)
    tree = pages.groupBy("doc_id", "n_nationkey", "n_name").agg(F.min("page").alias("start_index"), F.max("page").alias("end_index"))
    tree = tree.select("doc_id", F.concat(F.lit("c"), fn.node_number("n_nationkey")).alias("node"), F.lit(None).cast("string").alias("parent"), F.concat(F.lit("Chapter "), "n_name").alias("title"), "start_index", "end_index")
    split = documents.split_large(tree, pages.select("doc_id", "page", "text"), 4, 250, all_levels=False)
    above = split.select("doc_id", F.col("node").alias("parent"), F.col("title").alias("above"))
    return split.join(above, ["doc_id", "parent"], "left").select("doc_id", "title", "above", "start_index", "end_index")


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\n\s*\n')) AS body FROM documents), n AS (SELECT doc_id, regexp_replace(body, '^\s+|\s+$', '', 'g') AS text FROM t),
k AS (SELECT doc_id, text, length(text) - length(regexp_replace(text, '[\x{4E00}-\x{9FFF}]', '', 'g')) AS cjk FROM n)
SELECT doc_id, count(*) AS n, max(length(text)) AS longest FROM k WHERE floor(cjk / 1.5 + (length(text) - cjk) / 4.0) > 150 GROUP BY doc_id""")
def tree_token_limit(spark, sf):
    """Nodes beyond a limit of tokens, over the paragraphs of all documents."""
    nodes = documents.text_nodes(sample.table(spark, sf, "documents"))
    return documents.over_limit(nodes, 150).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).cast("long").alias("longest"))


@query(f"""WITH {_TURNS}, n AS (SELECT doc_id, k AS p, lpad((k + 1)::VARCHAR, 8, '0') AS node_id, '00000001' AS parent_id, 'Turn ' || turn || ' ' || role AS title FROM t
UNION ALL SELECT DISTINCT doc_id, 0, '00000001', NULL, 'Conversation ' || doc_id FROM t) SELECT doc_id, doc_id::VARCHAR AS doc_name, p::INTEGER AS p, node_id, parent_id, title FROM n""")
def doc_summary_json(spark, sf):
    """Each conversation's outline as one JSON text, read again and flattened: nodes in pre-order, without their texts."""
    nodes = documents.markdown_nodes(_markdown(spark, sf)).withColumn("text", F.lit(None).cast("string"))
    shape = "doc_name string, structure array<struct<node_id: string, parent_id: string, title: string>>"
    back = documents.tree_json(nodes).select("doc_id", F.from_json("document", shape).alias("d"))
    flat = back.select("doc_id", "d.doc_name", F.posexplode("d.structure").alias("p", "n"))
    return documents.project(flat.select("doc_id", "doc_name", "p", "n.*"), first=("doc_id", "node_id"))


@query(r"""SELECT conv_id, turn, array_to_string(list_slice([x for x in regexp_split_to_array(text, '[\s,，。！？?!、；;：:"''（）()]+') if length(x) > 1], 1, 5), '|') AS names FROM conversations WHERE text IS NOT NULL""")
def names_extract(spark, sf):
    """The first five names that a question may hold, of each turn."""
    turns = sample.table(spark, sf, "conversations").where("text IS NOT NULL")
    return turns.select("conv_id", "turn", F.array_join(fn.names("text"), "|").alias("names"))


@query("""WITH k AS (SELECT 'c' || o_custkey AS table_name, o_custkey AS c, coalesce(list('o' || o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderstatus IN ('F', 'P')), [min_by('o' || o_orderkey, o_orderkey)]) AS keys FROM orders GROUP BY o_custkey)
SELECT table_name, array_to_string(CASE WHEN len(keys) = 1 AND c % 3 = 0 THEN ['id', table_name] ELSE keys END, ',') AS keys FROM k""")
def pk_refine(spark, sf):
    """Keys of many tables (a customer each, its orders as columns) by marks in any case, else the first column; single ones as an inspection says, where it says anything."""
    orders = sample.table(spark, sf, "orders")
    name, mark = F.concat(F.lit("c"), "o_custkey"), F.when(F.col("o_orderstatus") == "F", "pri").when(F.col("o_orderstatus") == "P", "Primary Key").when(F.col("o_orderkey") % 2 == 0, "")
    columns = orders.select(name.alias("table_name"), F.concat(F.lit("o"), "o_orderkey").alias("column_name"), F.col("o_orderkey").alias("ordinal"), mark.alias("column_key"))
    seen = orders.where("o_custkey % 3 <> 1").select(name.alias("table_name"), F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("id"), name)).otherwise(F.array().cast("array<string>")).alias("keys")).distinct()
    return catalog.refine_keys(catalog.primary_keys(columns), seen).select("table_name", F.array_join("keys", ",").alias("keys"))


# Descriptions from recorded answers: a database a customer, a table an order.
_FENCE = "```"


def _answers(spark, sf) -> DataFrame:
    """One answer a customer with orders: short keys, in upper case for every second, fenced for every third; for one in seven no JSON at all. Of every order twice, the last counts."""
    orders = sample.table(spark, sf, "orders")
    table = lambda d: F.concat(F.lit('{"t": "o'), "o_orderkey", F.lit(f'", "d": "{d}'), "o_orderstatus", F.lit('", "et": "order", "cols": [{"c": "total", "d": "of o'), "o_orderkey", F.lit('"}, {"d": "nameless"}]}'))
    both = F.concat(table("draft "), F.lit(", "), table("order "))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", both.alias("t")))), lambda x: x.t), ", ")
    rows = orders.groupBy(F.col("o_custkey").alias("key")).agg(listed.alias("t"), F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    rel = F.concat(F.lit('[{"s": "o'), "a", F.lit('", "sc": "k", "t": "o'), "b", F.lit('", "tc": "k", "r": "first_last", "d": "x"}, {"s": "", "t": "o"}]'))
    text = F.concat(F.lit('{"db": {"ov": "of '), "key", F.lit('", "dom": "trade"}, "tables": ['), "t", F.lit('], "rels": '), rel, F.lit("}"))
    shouted = F.replace(F.replace(text, F.lit('"t": '), F.lit('"T": ')), F.lit('"et": '), F.lit('"ET": '))
    text = F.when(F.col("key") % 2 == 0, shouted).otherwise(text)
    text = F.when(F.col("key") % 3 == 0, F.concat(F.lit(f"{_FENCE}json\n"), text, F.lit(f"\n{_FENCE}"))).otherwise(text)
    return rows.select("key", F.when(F.col("key") % 7 == 0, "I cannot describe this").otherwise(text).alias("answer"))


@query("""WITH k AS (SELECT o_custkey AS key, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY 1)
SELECT key::VARCHAR AS key, 'error' AS kind, NULL AS table_name, NULL AS column_name, 'an answer that is no JSON object' AS description, NULL AS target_table, 1::BIGINT AS n FROM k WHERE key % 7 = 0
UNION ALL SELECT key::VARCHAR, 'db', NULL, NULL, 'of ' || key, NULL, 1 FROM k WHERE key % 7 <> 0
UNION ALL SELECT key::VARCHAR, 'relation', 'o' || a, 'k', 'x', 'o' || b, 1 FROM k WHERE key % 7 <> 0
UNION ALL SELECT o_custkey::VARCHAR, 'table', 'o' || o_orderkey, NULL, unnest(['draft ', 'order ']) || o_orderstatus, NULL, 1 FROM orders WHERE o_custkey % 7 <> 0
UNION ALL SELECT o_custkey::VARCHAR, 'column', 'o' || o_orderkey, 'total', 'of o' || o_orderkey, NULL, 2 FROM orders WHERE o_custkey % 7 <> 0""")
def ann_parse(spark, sf):
    """Recorded answers as rows, under all forms that their keys and wrapping may have."""
    parsed = annotate.parse_answers(_answers(spark, sf))
    return parsed.groupBy("key", "kind", "table_name", "column_name", "description", "target_table").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'table' AS kind, o_custkey::VARCHAR AS key, 'o' || o_orderkey AS table_name, NULL AS column_name, CASE WHEN o_custkey % 7 <> 0 THEN 'order ' || o_orderstatus ELSE 'unknown' END AS business_description, CASE WHEN o_custkey % 7 <> 0 THEN 'order' END AS entity_type FROM orders
UNION ALL SELECT 'column', o_custkey::VARCHAR, 'o' || o_orderkey, c, CASE WHEN o_custkey % 7 <> 0 AND c = 'total' THEN 'of o' || o_orderkey END, NULL FROM orders, (VALUES ('total'), ('date')) t(c)""")
def ann_merge(spark, sf):
    """Tables and columns of all databases with what the answers say; what they do not name stays as it was."""
    tables = sample.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.concat(F.lit("o"), "o_orderkey").alias("table_name"), F.lit("unknown").alias("business_description"))
    columns = tables.select("key", "table_name", F.explode(F.array(F.lit("total"), F.lit("date"))).alias("column_name"))
    t, c = annotate.merge_answers(tables, columns, annotate.parse_answers(_answers(spark, sf)))
    t = t.select(F.lit("table").alias("kind"), "key", "table_name", F.lit(None).cast("string").alias("column_name"), "business_description", "entity_type")
    return t.unionByName(c.select(F.lit("column").alias("kind"), "key", "table_name", "column_name", "business_description", F.lit(None).cast("string").alias("entity_type")))


# Graphs.
@query("""WITH RECURSIVE f AS (SELECT 'nation:' || c_nationkey AS n, 'segment:' || c_mktsegment AS s, count(*)::DOUBLE AS v FROM customer GROUP BY 1, 2),
a AS (SELECT n, sum(v) AS v FROM f GROUP BY 1), z AS (SELECT s, sum(v) AS v FROM f GROUP BY 1), w AS (SELECT n, s, a.v + f.v + z.v AS cost FROM f JOIN a USING (n) JOIN z USING (s)),
pick AS (SELECT 0 AS number, []::VARCHAR[] AS used, NULL::VARCHAR AS path, NULL::DOUBLE AS distance UNION ALL
SELECT number + 1, list_concat(used, [n, s]), 'all > ' || n || ' > ' || s || ' > end', cost FROM (SELECT p.number, p.used, w.*, row_number() OVER (ORDER BY cost, n, s) AS r FROM pick p, w WHERE number < 4 AND NOT list_contains(used, n) AND NOT list_contains(used, s)) WHERE r = 1)
SELECT number, path, distance FROM pick WHERE number > 0""")
def g_k_paths_disjoint(spark, sf):
    """The four cheapest ways through nation and market segment to the end, none with an edge of another; customers are the lengths."""
    flows = sample.table(spark, sf, "customer").groupBy(F.concat(F.lit("nation:"), "c_nationkey").alias("src"), F.concat(F.lit("segment:"), "c_mktsegment").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("strength"))
    first = flows.groupBy(F.lit("all").alias("src"), F.col("src").alias("dst")).agg(F.sum("strength").alias("strength"))
    last = flows.groupBy(F.col("dst").alias("src"), F.lit("end").alias("dst")).agg(F.sum("strength").alias("strength"))
    found = paths.disjoint_paths(first.unionByName(flows).unionByName(last), "all", "end", 4)
    return spark.createDataFrame([(i, " > ".join(p), d) for i, (p, d) in enumerate(found, 1)], "number int, path string, distance double")


@query(f"""WITH {SUPPLY}, d AS (SELECT name, count(*) AS d FROM (SELECT src AS name FROM half UNION ALL SELECT dst FROM half) GROUP BY 1),
best AS (SELECT partition_id, name, row_number() OVER (PARTITION BY partition_id ORDER BY coalesce(d, 0) DESC, name) AS r FROM nodes LEFT JOIN d USING (name))
SELECT partition_id, 'type' AS kind, type AS item, count(*)::INTEGER AS value FROM nodes GROUP BY ALL UNION ALL SELECT partition_id, 'node', name, r::INTEGER FROM best WHERE r <= 3""")
def agg_community_types(spark, sf):
    """What the communities of suppliers and parts consist of, and the three nodes of each with most edges."""
    nodes, edges = sample.supply(spark, sf)
    stats = community.community_stats(nodes, community.undirected(edges), nodes.select("name", F.col("group").alias("partition_id")))
    kinds = stats.select("partition_id", F.explode("types").alias("item", "value")).select("partition_id", F.lit("type").alias("kind"), "item", F.col("value").cast("int").alias("value"))
    best = stats.select("partition_id", F.posexplode("key_nodes").alias("p", "item"))
    return kinds.unionByName(best.select("partition_id", F.lit("node").alias("kind"), "item", (F.col("p") + 1).alias("value")))
