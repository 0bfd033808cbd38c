"""Queries of writes, evidence, outlines, text and JSON functions, with the same in SQL; they are added to those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import model
from .functions import folds
from .functions import text as fn
from .operators import graph, retrieval, store
from .plans import documents, sample
from .queries import CORE, query

# Writes: customers as entities, their nations as the other ends of relations.
_HOME = "'customer:' || c_custkey AS s, 'lives in' AS p, 'nation:' || c_nationkey AS o"
_EDGE = "md5(s || '_' || p || '_' || o) AS relationship_id, md5(s) AS subject_id, md5(o) AS object_id, p AS predicate"


def _homes(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(s, p, o) of every customer, and the nodes of all customers and nations."""
    customers = sample.table(spark, sf, "customer")
    rels = customers.select(F.concat(F.lit("customer:"), "c_custkey").alias("s"), F.lit("lives in").alias("p"), F.concat(F.lit("nation:"), "c_nationkey").alias("o"))
    return rels, sample.core(spark, sf)[0]


@query(f"SELECT {_EDGE}, 0.5::DOUBLE AS confidence FROM (SELECT {_HOME} FROM customer)")
def insert_edges(spark, sf):
    rels, nodes = _homes(spark, sf)
    return store.save_edges_only(rels, nodes)[0].select("relationship_id", "subject_id", "object_id", "predicate", "confidence")


@query(f"SELECT {_EDGE}, CAST(CASE WHEN k % 3 = 0 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence FROM (SELECT c_custkey AS k, {_HOME} FROM customer)")
def upsert_edge(spark, sf):
    """Every third edge is put again with another confidence; a name in another case and an unknown end write nothing."""
    rels, nodes = _homes(spark, sf)
    edges = store.save_edges_only(rels, nodes)[0]
    again = rels.where(F.regexp_extract("s", r"(\d+)", 1).cast("long") % 3 == 0).withColumn("confidence", F.lit(0.9))
    lost = rels.select(F.upper("s").alias("s"), "p", "o", F.lit(0.1).alias("confidence")).unionByName(rels.select("s", "p", F.lit("nowhere").alias("o"), F.lit(0.1).alias("confidence")))
    return store.upsert_edges_by_name(edges, nodes, again.unionByName(lost)).select("relationship_id", "subject_id", "object_id", "predicate", "confidence")


@query(f"""WITH r AS (SELECT {_HOME} FROM customer)
SELECT 'node' AS kind, md5(name) AS key, 'batch' AS datasource FROM (SELECT s AS name FROM r UNION SELECT o FROM r) UNION ALL SELECT 'edge', md5(s || '_' || p || '_' || o), NULL FROM r""")
def save_all(spark, sf):
    """Nodes and edges of one batch; ends are looked up in the batch, entities repeat."""
    rels, _ = _homes(spark, sf)
    entities = rels.select(F.col("s").alias("name"), F.lit("person").alias("type")).unionByName(rels.select(F.col("o").alias("name"), F.lit("location").alias("type")))
    nodes, edges = store.save_all(entities, rels, "batch")
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("key"), "datasource").unionByName(edges.select(F.lit("edge").alias("kind"), F.col("relationship_id").alias("key"), F.col("source").alias("datasource")))


@query("SELECT md5('customer:' || c_custkey) AS id, 1 AS count, 0.5::DOUBLE AS confidence, 'batch' AS datasource FROM customer")
def save_entities_only(spark, sf):
    rels, _ = _homes(spark, sf)
    return store.save_entities_only(rels.select(F.col("s").alias("name"), F.lit("person").alias("type")), "batch").select("id", "count", "confidence", "datasource")


# Reads of the whole core graph.
@query(f"WITH {CORE} SELECT id, name FROM nodes WHERE type = 'organization' ORDER BY id LIMIT 100")
def list_entities(spark, sf):
    return graph.list_entities(sample.core(spark, sf)[0], "organization").select("id", "name")


@query(f"WITH {CORE} SELECT id, name FROM nodes WHERE type = 'person' ORDER BY id LIMIT 50 OFFSET 100")
def page_skip_limit(spark, sf):
    return graph.list_page(sample.core(spark, sf)[0], kind="person", limit=50, offset=100)[0].select("id", "name")


@query(f"WITH {CORE} SELECT id FROM nodes WHERE type IN ('location', 'concept')")
def pred_in(spark, sf):
    nodes, _ = sample.core(spark, sf)
    return nodes.where(F.col("type").isin("location", "concept")).select("id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 > 1 THEN 'customer:' || c_custkey END AS name FROM customer")
def pred_blank_pk(spark, sf):
    """Keys that are empty, blank or the word None name no node in the strict form."""
    key = F.element_at(F.array(F.lit(" "), F.lit("None"), F.col("c_custkey").cast("string"), F.col("c_custkey").cast("string")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return sample.table(spark, sf, "customer").select("c_custkey", model.entity_name("customer", key, strict=True).alias("name"))


# Evidence: documents as outline nodes, nations as tables, the core graph.
_WORDS = ["the", "und", "rights"]
_SHARE = "(contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT + contains(lower(text), 'rights')::INT) / 3.0"


def _outline(spark, sf) -> DataFrame:
    docs = sample.table(spark, sf, "documents")
    return docs.select(F.concat(F.lit("DOC://d/"), "doc_id").alias("doc_uri"), F.lit("1").alias("node_id"), F.lit(1).alias("depth"), F.col("source").alias("title"), F.col("text").alias("summary"), F.col("lang").alias("doc_description"))


@query(f"SELECT 'DOC://d/' || doc_id || '#1' AS source_id, CAST({_SHARE} AS DOUBLE) AS score FROM (SELECT doc_id, concat_ws(' ', source, text, lang) AS text FROM documents) WHERE {_SHARE} > 0")
def ret_documents(spark, sf):
    return retrieval.from_documents(_outline(spark, sf), _WORDS).select("source_id", "score")


def _cards(spark, sf) -> DataFrame:
    nations, regions = sample.table(spark, sf, "nation"), sample.table(spark, sf, "region")
    rows = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.concat(F.lit("DBS://r"), "r_regionkey").alias("db_uri"), F.col("r_name").alias("business_domain"), F.col("n_name").alias("table_name"), F.concat(F.lit("people of "), "n_name").alias("summary"), F.lit("location").alias("entity_type"))


@query("""WITH c AS (SELECT 'DBS://r' || r_regionkey AS uri, r_name, n_name, lower(concat_ws(' ', n_name, 'people of ' || n_name, 'location')) AS t FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT *, (contains(t, 'an')::INT + contains(t, 'asia')::INT + contains(t, 'query')::INT) / 3.0 AS score FROM c)
SELECT uri || '/' || n_name AS source_id, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 UNION ALL SELECT DISTINCT uri, 0.8::DOUBLE FROM s WHERE contains(r_name, 'ASIA')""")
def ret_databases(spark, sf):
    return retrieval.from_tables(_cards(spark, sf), ["an"], "ASIA", "query").select("source_id", "score")


@query(f"WITH {CORE} SELECT id AS source_id, name AS citation, CAST(0.5 AS DOUBLE) AS score FROM nodes WHERE type = 'person'")
def ev_entity(spark, sf):
    nodes, _ = sample.core(spark, sf)
    ev = retrieval.entity_evidence(nodes.where("type = 'person'"), F.lit(0.5))
    return ev.select("source_id", retrieval.citation().alias("citation"), "score")


@query(f"WITH {CORE} SELECT relationship_id AS source_id, subject || ' Foreign key ' || object AS citation, subject || ' → ' || object || '（Foreign key）' AS summary, CAST(0.7 AS DOUBLE) AS score FROM edges")
def ev_relation(spark, sf):
    _, edges = sample.core(spark, sf)
    rels = edges.select(F.col("subject").alias("source"), F.col("object").alias("target"), "predicate", "relationship_id")
    ev = retrieval.relation_evidence(rels.unionByName(rels))
    return ev.select("source_id", retrieval.citation().alias("citation"), retrieval.summary().alias("summary"), "score")


@query(f"""WITH {CORE}, found AS (SELECT id, name FROM nodes WHERE starts_with(datasource, 'DBS://bench/tpch/supplier') ORDER BY id LIMIT 100),
chosen AS (SELECT name FROM found ORDER BY name LIMIT 50), ways AS (SELECT subject AS a, relationship_id FROM edges UNION ALL SELECT object, relationship_id FROM edges),
near AS (SELECT a, relationship_id FROM ways WHERE a IN (SELECT name FROM chosen) ORDER BY relationship_id, a LIMIT 200)
SELECT 'entity' AS source_type, id AS source_id, CAST(0.9 AS DOUBLE) AS score FROM found UNION ALL SELECT DISTINCT 'relation', relationship_id, CAST(0.7 AS DOUBLE) FROM near""")
def ret_graph_db(spark, sf):
    """Entities under the URI of the suppliers' table and their relations."""
    nodes, edges = sample.core(spark, sf)
    uris = spark.createDataFrame([(f"{sample.DATASOURCE}/supplier",)], "uri string")
    return retrieval.from_graph(nodes, edges, uris, "", []).select("source_type", "source_id", "score")


_FUSED = "SELECT doc_id, least(1.0, score + 0.05) AS score FROM (SELECT doc_id, n_chars / 10000.0 AS score FROM documents)"


def _fused(spark, sf) -> DataFrame:
    docs = sample.table(spark, sf, "documents")
    content = F.map_from_arrays(F.array(*map(F.lit, ("summary", "uri", "title"))), F.array(F.concat(F.lit("about "), "doc_id"), F.concat(F.lit("DOC://d/"), F.col("doc_id") % 50), F.col("source")))
    ev = docs.select(F.lit("document").alias("source_type"), F.concat(F.lit("d"), "doc_id").alias("source_id"), content.alias("content"), (F.col("n_chars") / 10000.0).alias("score"))
    return retrieval.fuse(ev, ["no such entity"])


@query("SELECT DISTINCT 'document' AS source_type, 'DOC://d/' || (doc_id % 50) || ' · ' || source AS citation FROM documents")
def dedup_citations(spark, sf):
    return retrieval.citations(_fused(spark, sf))


@query(f"WITH f AS ({_FUSED}) SELECT count(*) AS n, CAST(floor(sum(length('about ' || doc_id)) / 4) AS BIGINT) AS tokens, (SELECT 'about ' || doc_id FROM f ORDER BY score DESC, 'd' || doc_id LIMIT 1) AS best FROM f")
def ctx_build(spark, sf):
    """All pieces are listed, in parts; counted from the lists."""
    parts = retrieval.context_parts(_fused(spark, sf))
    return parts.agg(F.sum(F.size("pieces")).alias("n"), F.floor(F.sum("chars") / 4).alias("tokens"), F.min_by(F.col("pieces")[0].summary, "part").alias("best"))


# Paged documents: a nation is a document, its customers are entries of its contents page, each on a page of its own after that.
_ENTRY = "SELECT c_nationkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, 'Customer ' || lpad(c_custkey::VARCHAR, 9, '0') AS title FROM customer"


def _pages(spark, sf) -> DataFrame:
    """(doc_id, page, text): page 1 lists the entries with printed pages, page k + 1 opens with entry k; every fifth has a line above its title."""
    number = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = sample.table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), number.alias("k"), F.concat(F.lit("Customer "), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("title"))
    above = F.when(F.col("k") % 5 == 0, "see above\n").otherwise("")
    own = rows.select("doc_id", (F.col("k") + 1).alias("page"), F.concat(above, F.col("k").cast("string"), F.lit(" "), "title", F.lit("\nbody")).alias("text"))
    line = F.concat(F.col("k").cast("string"), F.lit(". "), "title", F.lit(" ........ "), F.col("k").cast("string"))
    toc = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("t")))), lambda x: x.t), "\n").alias("text"))
    return own.unionByName(toc.select("doc_id", F.lit(1).alias("page"), F.concat(F.lit("Contents\n"), "text").alias("text")))


def _entries(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    toc = documents.toc_pages(pages, F.col("text").startswith("Contents"))
    return documents.toc_entries(documents.toc_text(pages, toc)), toc


@query("SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS doc_id, 1 AS page FROM customer")
def pdf_toc_find(spark, sf):
    return documents.toc_pages(_pages(spark, sf), F.col("text").startswith("Contents"))


@query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(k + 1 AS INTEGER) AS ord, k::VARCHAR AS structure, title, CAST(k AS INTEGER) AS page FROM ({_ENTRY})")
def pdf_toc_extract(spark, sf):
    """Contents pages found, joined, leader dots turned to colons, lines read as entries."""
    return _entries(_pages(spark, sf))[0].select("doc_id", "ord", "structure", "title", "page")


@query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, title, CAST(k + 1 AS INTEGER) AS physical_index, CAST(k + 1 AS INTEGER) AS placed FROM ({_ENTRY})")
def pdf_toc_offset(spark, sf):
    """Entries located by their titles, and placed by printed page plus the commonest offset."""
    pages = _pages(spark, sf)
    entries, toc = _entries(pages)
    found = documents.locate(entries, pages, toc)
    placed = documents.apply_offset(entries, documents.page_offset(entries, found))
    return found.select("doc_id", "ord", "title", "physical_index").join(placed.select("doc_id", "ord", F.col("physical_index").alias("placed")), ["doc_id", "ord"]).drop("ord")


@query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, k::VARCHAR AS structure, title, CAST(k + 1 AS INTEGER) AS physical_index FROM ({_ENTRY}) UNION ALL SELECT doc_id, k::VARCHAR, title || ': ' || k, 1 FROM ({_ENTRY})")
def pdf_no_toc(spark, sf):
    """Numbered lines of all pages, those of the contents pages too."""
    pages = _pages(spark, sf).withColumn("text", fn.leader_dots("text"))
    out = documents.outline_of_pages(pages)
    return out.select("doc_id", "structure", F.regexp_replace("title", r"\s*:\s+", ": ").alias("title"), "physical_index")


@query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(k AS INTEGER) AS ord, CASE WHEN k % 5 = 0 THEN 'no' ELSE 'yes' END AS appear_start FROM ({_ENTRY})")
def pdf_title_start(spark, sf):
    pages = _pages(spark, sf)
    outline = pages.where("page > 1").select("doc_id", (F.col("page") - 1).alias("ord"), F.regexp_extract("text", r"(\d+ Customer \d+)", 1).alias("title"), F.col("page").alias("physical_index"))
    return documents.title_opens_page(outline, pages).select("doc_id", "ord", "appear_start")


def _guessed(pages: DataFrame) -> DataFrame:
    """Entries with every third page wrong by one and every fourth unknown."""
    k = F.col("page") - 1
    guess = F.when(k % 4 == 0, F.lit(None)).when(k % 3 == 0, F.col("page") + 1).otherwise(F.col("page"))
    return pages.where("page > 1").select("doc_id", k.alias("ord"), F.regexp_extract("text", r"(Customer \d+)", 1).alias("title"), guess.cast("int").alias("physical_index"))


@query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, avg(CASE WHEN k % 4 = 0 OR k % 3 = 0 THEN 0.0 ELSE 1.0 END) AS accuracy FROM ({_ENTRY}) GROUP BY doc_id")
def pdf_verify(spark, sf):
    pages = _pages(spark, sf)
    return documents.accuracy(documents.checked(_guessed(pages), pages))


@query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(k AS INTEGER) AS ord, CAST(CASE WHEN k % 4 > 0 AND k % 3 = 0 THEN k + 2 ELSE k + 1 END AS INTEGER) AS physical_index FROM ({_ENTRY})")
def pdf_fill_none(spark, sf):
    """Unknown pages looked for between their neighbours; those beside a neighbour that is wrong by one are found all the same."""
    pages = _pages(spark, sf).where("page > 1")
    return documents.fill_missing(_guessed(pages), pages).select("doc_id", "ord", "physical_index")


@query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(k AS INTEGER) AS ord, CAST(k + 1 AS INTEGER) AS physical_index FROM ({_ENTRY})")
def pdf_fix(spark, sf):
    pages = _pages(spark, sf).where("page > 1")
    return documents.repaired(_guessed(pages), pages).select("doc_id", "ord", "physical_index")


@query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(k AS INTEGER) AS ord, CASE WHEN k % 2 = 1 THEN CAST(k + 1 AS INTEGER) END AS physical_index FROM ({_ENTRY})")
def pdf_validate(spark, sf):
    """Pages past the end are unknown."""
    pages = _pages(spark, sf)
    outline = pages.where("page > 1").select("doc_id", (F.col("page") - 1).alias("ord"), F.when(F.col("page") % 2 == 1, 1_000_000).otherwise(F.col("page")).cast("int").alias("physical_index"))
    return documents.in_range(outline, pages).select("doc_id", "ord", "physical_index")


@query(f"""WITH e AS ({_ENTRY}), n AS (SELECT doc_id, max(k) AS n FROM e GROUP BY 1)
SELECT CAST(doc_id AS BIGINT) AS doc_id, title, CAST(k + 1 AS INTEGER) AS start_index, CAST(CASE WHEN k = n THEN k + 1 WHEN (k + 1) % 5 = 0 THEN k + 2 ELSE k + 1 END AS INTEGER) AS end_index FROM e JOIN n USING (doc_id)
UNION ALL SELECT DISTINCT doc_id, 'Preface', 1, 1 FROM e""")
def pdf_tree(spark, sf):
    """From pages to sections: contents page, offsets, starts, ends, preface."""
    pages = _pages(spark, sf).withColumn("text", F.regexp_replace("text", r"(?m)^\d+ (?=Customer)", ""))
    return documents.paged_tree(pages, F.col("text").startswith("Contents")).select("doc_id", "title", "start_index", "end_index")


# Markdown outlines: a nation is a section of its region, its customers are subsections.
def _markdown(spark, sf) -> DataFrame:
    rows = sample.table(spark, sf, "customer").join(sample.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = rows.groupBy(F.col("n_regionkey").alias("doc_id"), "n_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c_custkey")), lambda k: F.concat(F.lit("## c"), k.cast("string"), F.lit("\nabcd"))), "\n").alias("t"))
    body = F.transform(F.sort_array(F.collect_list(F.struct("n_name", "t"))), lambda x: F.concat(F.lit("# "), x.n_name, F.lit("\n"), x.t))
    return parts.groupBy("doc_id").agg(F.array_join(body, "\n").alias("text"))


_MD = "SELECT n_regionkey AS doc_id, n_name, 'c' || c_custkey AS c, length('## c' || c_custkey || chr(10) || 'abcd') AS n FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(f"""SELECT CAST(doc_id AS BIGINT) AS doc_id, c AS title, CAST(trunc(n / 4.0) AS BIGINT) AS tokens FROM ({_MD})
UNION ALL SELECT doc_id, n_name, CAST(sum(trunc(n / 4.0)) + trunc(max(length('# ' || n_name)) / 4.0) AS BIGINT) FROM ({_MD}) GROUP BY doc_id, n_name""")
def md_tokens(spark, sf):
    """Tokens of each heading with all below it."""
    nodes = documents.markdown_nodes(_markdown(spark, sf))
    sizes = documents.subtree_tokens(nodes).join(nodes.select("doc_id", "ord", "title"), ["doc_id", "ord"])
    return sizes.select(F.col("doc_id").cast("long").alias("doc_id"), "title", "tokens")


@query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, n_name AS title, count(*) AS joined FROM ({_MD}) GROUP BY doc_id, n_name")
def md_thin(spark, sf):
    """Every subtree is below the bound, so each section takes in its subsections."""
    thin = documents.thin(documents.markdown_nodes(_markdown(spark, sf)), 1 << 30)
    return thin.select(F.col("doc_id").cast("long").alias("doc_id"), "title", F.size(F.split("text", "\n\n## ")).cast("long").alias("joined")).withColumn("joined", F.col("joined") - 1)


@query(f"""SELECT CAST(doc_id AS BIGINT) AS doc_id, c AS title, '## ' || c || chr(10) || 'abcd' AS summary, NULL AS prefix_summary FROM ({_MD})
UNION ALL SELECT DISTINCT doc_id, n_name, NULL, '# ' || n_name FROM ({_MD})""")
def summary_short(spark, sf):
    """Short texts are their own summaries: of leaves one kind, of inner nodes the other."""
    return documents.summaries(documents.markdown_nodes(_markdown(spark, sf))).select(F.col("doc_id").cast("long").alias("doc_id"), "title", "summary", "prefix_summary")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE length(text) > 0")
def seg_split(spark, sf):
    """Long texts cut at sentence ends; the parts of a text have its length together and none is longer than the bound but for one sentence."""
    nodes = sample.table(spark, sf, "documents").select("doc_id", F.lit(1).alias("ord"), F.lit("t").alias("title"), "text")
    segs = documents.segments(nodes, 2000)
    return segs.groupBy("doc_id").agg(F.sum(F.length("text")).cast("long").alias("chars"))


# Text and JSON functions over whole columns.
@query(r"""SELECT doc_id, lower(text) AS low, upper(replace(text, 'ß', 'ss')) AS up, trim(text, ' ') AS bare, CAST(floor(length(text) / 4) AS BIGINT) AS ctx,
least(1.0, n_chars / 1000.0)::DOUBLE AS capped, replace(source || '/' || doc_id, '/', '-') AS safe FROM documents""")
def fn_text_basics(spark, sf):
    docs = sample.table(spark, sf, "documents")
    return docs.select("doc_id", F.lower("text").alias("low"), F.upper("text").alias("up"), F.trim("text").alias("bare"), fn.context_tokens("text").alias("ctx"), fn.capped(F.col("n_chars") / 1000.0).alias("capped"), fn.file_safe(F.concat("source", F.lit("/"), "doc_id")).alias("safe"))


@query(r"SELECT doc_id, len([x for x in regexp_split_to_array(text, '\n\s*\n') if trim(x, ' ') <> '']) AS paragraphs FROM (SELECT doc_id, replace(text, '. ', '.' || chr(10) || ' ' || chr(10)) AS text FROM documents)")
def fn_split_paragraphs(spark, sf):
    docs = sample.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n \n")).alias("text"))
    return docs.select("doc_id", F.size(fn.paragraphs("text")).cast("long").alias("paragraphs"))


@query("SELECT o_orderkey, CAST(o_orderkey % 9 + 1 AS BIGINT) AS chapters FROM orders")
def fn_split_chapters(spark, sf):
    text = F.concat(F.lit("序\n"), F.array_join(F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 9).cast("int")), lambda i: F.concat(F.lit("第"), i.cast("string"), F.lit("章 x\n第一节"))), "\n"))
    text = F.when(F.col("o_orderkey") % 9 == 0, "序\n第一节").otherwise(text)
    return sample.table(spark, sf, "orders").select("o_orderkey", F.size(fn.chapters(text)).cast("long").alias("chapters"))


@query("""SELECT o_orderkey, CASE WHEN k BETWEEN 1 AND 6 THEN CAST(k AS INTEGER) END AS level, CASE WHEN k BETWEEN 1 AND 6 THEN 'Order ' || o_orderkey ELSE '' END AS title, 'Chapter: ' || o_orderkey AS entry,
CAST(o_orderkey AS INTEGER) AS page, CAST(o_orderkey AS INTEGER) AS first, CAST(o_orderkey + 1 AS INTEGER) AS last, 'rest' AS body FROM (SELECT o_orderkey, o_orderkey % 8 AS k FROM orders)""")
def fn_marks(spark, sf):
    """Headings, leader dots, page and start tags, first tagged section."""
    key, k = F.col("o_orderkey"), (F.col("o_orderkey") % 8).cast("int")
    line = F.concat(F.repeat(F.lit("#"), k), F.lit(" Order "), key)
    starts = F.concat(F.lit("a <start_index_"), key, F.lit("> b <start_index_"), key + 1, F.lit(">"))
    tagged = F.concat(fn.page_tag(key), F.lit("page\n"), fn.page_tag(key), F.lit("rest"))
    return sample.table(spark, sf, "orders").select(
        "o_orderkey", fn.heading_level(line).alias("level"), fn.heading_title(line).alias("title"), fn.leader_dots(F.concat(F.lit("Chapter........"), key)).alias("entry"),
        fn.page_of_tag(fn.page_tag(key)).alias("page"), fn.first_start_tag(starts).alias("first"), fn.last_start_tag(starts).alias("last"), fn.without_first_section(tagged).alias("body"),
    )


@query("SELECT o_orderkey, 'u' || o_orderkey AS uuid FROM orders")
def fn_uuid_from_path(spark, sf):
    path = F.concat(F.lit("/data/"), F.when(F.col("o_orderkey") % 2 == 0, "DOC").otherwise("DBS"), F.lit("/u"), "o_orderkey", F.lit("/file.md"))
    return sample.table(spark, sf, "orders").select("o_orderkey", model.uuid_from_path(path).alias("uuid"))


@query("""SELECT o_orderkey, '{"entities": [{"name": "o' || o_orderkey || '"}], "relationships": []}' AS repaired FROM orders""")
def fn_json_repair(spark, sf):
    """Answers in fences that break off inside their second entity, after texts of up to several thousand characters."""
    tail = F.repeat(F.lit("x"), ((F.col("o_orderkey") % 100) * 50).cast("int"))
    text = F.concat(F.lit('```json\n{"entities": [{"name": "o'), "o_orderkey", F.lit('"}, {"name": "'), tail)
    return sample.table(spark, sf, "orders").select("o_orderkey", folds.repair_json_udf(text).alias("repaired"))

