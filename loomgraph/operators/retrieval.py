"""Search and evidence: keyword scores, BM25 full text, retrievers, fusion, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import text as fn
from .community import numbered
from .dedup import budget_prefix, content_hash, first_per, top_per
from .graph import both_ways

# Source priorities of evidence, bonus of each, bonus of a named entity.
PRIORITY = {"entity": 4, "relation": 3, "database": 2, "document": 1}
PRIORITY_STEP, ENTITY_BONUS, RELATION_SCORE = 0.05, 0.2, 0.7
#: Characters that a line of a prompt has at least: its keys and a score.
LEAST_LINE = 20
EVIDENCE = "source_type string, source_id string, content map<string,string>, score double"


def terms(c: Column | str) -> Column:
    """Search terms: lower-cased runs of letters and digits; each Chinese character by itself."""
    spaced = F.regexp_replace(F.lower(F.coalesce(model.as_column(c), F.lit(""))), r"([\x{4E00}-\x{9FFF}])", " $1 ")
    return F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def index(docs: DataFrame, key: str, *fields: str, only: list[str] | None = None) -> DataFrame:
    """Inverted list (term, key, tf, size) over the joined fields; with *only*, the lists of these terms and no others."""
    words = docs.select(key, terms(F.concat_ws(" ", *fields)).alias("w"))
    wanted = F.filter("w", lambda x: x.isin(only)) if only is not None else F.col("w")
    long = words.select(key, F.size("w").alias("size"), F.explode(wanted).alias("term"))
    return long.groupBy("term", key, "size").agg(F.count(F.lit(1)).alias("tf"))


def bm25(lists: DataFrame, query: list[str], key: str, total: int, mean: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the rows that hold any query term; only the query's lists are read."""
    hit = lists.where(F.col("term").isin(sorted(set(query))))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / mean))
    return hit.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(part).alias("score"))  # one row a query term


def full_text(nodes: DataFrame, query: str, limit: int = 10, prefixes: list[str] | None = None, types: list[str] | None = None, fields: tuple[str, ...] = ("name", "description", "byname", "datasource")) -> DataFrame:
    """Nodes by BM25 with ``similarity`` = min(1, score); where nothing matches, those that contain the text, without one."""
    rows = nodes
    if prefixes:
        rows = rows.where(model.under_any("datasource", prefixes))
    if types:
        rows = rows.where(F.col("type").isin(types))
    words = rows.sparkSession.range(1).select(terms(F.lit(query)).alias("t")).first().t
    text = terms(F.concat_ws(" ", *fields))
    hit = F.arrays_overlap(text, F.array(*map(F.lit, words))) if words else F.lit(False)
    if rows.where(hit).isEmpty():  # a scan that ends at the first hit
        plain = rows.where(F.coalesce(F.col("name").contains(query), F.lit(False)) | F.coalesce(F.col("description").contains(query), F.lit(False)))
        return plain.withColumns({"score": F.lit(None).cast("double"), "similarity": F.lit(None).cast("double")}).orderBy("id").limit(limit)
    facts = nodes.select(F.size(text).alias("n")).agg(F.count(F.lit(1)).alias("total"), F.avg("n").alias("mean")).first()
    # How rare a term is follows from all nodes, whatever part of them is asked for.
    scores = bm25(index(nodes, "id", *fields, only=sorted(set(words))), words, "id", facts.total, facts.mean or 1.0)
    return rows.join(scores, "id").withColumn("similarity", fn.capped("score")).orderBy(F.desc("score"), "id").limit(limit)


def full_text_page(nodes: DataFrame, query: str, limit: int = 10, offset: int = 0, kind: str | None = None) -> tuple[DataFrame, int]:
    """One page of full-text hits and their number; where nothing matches, of nodes that contain the text in any case."""
    rows = nodes.where(F.col("type") == kind) if kind else nodes
    found = full_text(nodes, query, 1 << 30, types=[kind] if kind else None).where("score IS NOT NULL")
    total = found.count()
    if not total:
        low = query.lower()
        hit = [F.coalesce(F.lower(c).contains(low), F.lit(False)) for c in ("name", "description", "datasource")]
        found = rows.where(hit[0] | hit[1] | hit[2]).withColumn("score", F.lit(0.0))
        total = found.count()
    return found.orderBy(F.desc("score"), "id").offset(offset).limit(limit), total


def prefix_join(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Rows with each of the *prefixes* that their *text* begins with, by equality: a text is cut to every length that a prefix has.

    Only the distinct lengths come to the driver; a row is repeated once a length, and no pair is tried that is none.
    """
    lengths = sorted(r.n for r in prefixes.select(F.length(prefix).alias("n")).distinct().where("n IS NOT NULL").collect())
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(text))
    cut = rows.withColumn("__begin", F.explode(F.transform(fitting, lambda n: F.substring(F.col(text), F.lit(1), n))))
    return cut.join(prefixes, F.col("__begin") == F.col(prefix)).drop("__begin")


def expand_cascade(nodes: DataFrame, edges: DataFrame, names: DataFrame, limit: int = 30) -> DataFrame:
    """Relations of each name: of the node of that name, else of nodes whose name it begins, else of its table (what comes before a colon)."""
    keyed = names.select("name").distinct().withColumn("__t", F.regexp_extract("name", r"^([^:]+):", 1))
    exact = keyed.join(nodes.select("name"), "name", "left_semi").select("name", F.col("name").alias("node"))
    rest = keyed.join(exact.select("name"), "name", "left_anti")
    all_nodes = nodes.select(F.col("name").alias("node"))
    begun = prefix_join(all_nodes, "node", rest.select("name"), "name").select("name", "node")
    tables = rest.join(begun.select("name"), "name", "left_anti").where("__t <> ''").select("name", F.concat("__t", F.lit(":")).alias("begin"))
    last = prefix_join(all_nodes, "node", tables, "begin").select("name", "node")
    chosen = exact.unionByName(begun).unionByName(last)
    ways = both_ways(edges.select("subject", "object", "predicate", "relationship_id"))
    hit = ways.join(chosen, F.col("subject") == F.col("node")).select("name", F.col("subject").alias("source"), F.col("object").alias("target"), "predicate", "relationship_id")
    return top_per(hit, ["name"], limit, F.asc("relationship_id"), F.asc("source"))


def expand_keywords(entities: list[str], words: list[str], questions: list[str], least: int = 2) -> list[str]:
    return list(dict.fromkeys([*entities, *words, *(q for q in questions if len(q) > least)]))


def from_documents(tree: DataFrame, words: list[str]) -> DataFrame:
    """Evidence of document nodes (doc_uri, node_id, title, summary, doc_description): those whose text has any keyword."""
    score = fn.keyword_score(F.concat_ws(" ", "title", "summary", "doc_description"), words)
    content = F.map_from_arrays(F.array(*map(F.lit, ("title", "summary", "uri"))), F.array("title", "summary", "doc_uri"))
    return tree.where("depth <= 10").select(F.lit("document").alias("source_type"), F.concat_ws("#", "doc_uri", "node_id").alias("source_id"), content.alias("content"), score.alias("score")).where("score > 0")


def from_tables(cards: DataFrame, words: list[str], domain: str, intent: str) -> DataFrame:
    """Evidence of tables (db_uri, business_domain, table_name, summary, entity_type), and of databases whose domain holds the asked one."""
    keys = [w for w in [*words, domain, intent] if w]
    uri = F.concat_ws("/", "db_uri", "table_name")
    score = fn.keyword_score(F.concat_ws(" ", "table_name", "summary", "entity_type"), keys)
    of = lambda *pairs: F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[F.col(c) if isinstance(c, str) else c for _, c in pairs]))
    tables = cards.select(F.lit("database").alias("source_type"), uri.alias("source_id"), of(("table", "table_name"), ("summary", "summary"), ("uri", uri)).alias("content"), score.alias("score")).where("score > 0")
    whole = cards.select("db_uri", "business_domain").distinct().where(F.col("business_domain").contains(domain)) if domain else cards.limit(0).select("db_uri", "business_domain")
    return tables.unionByName(whole.select(F.lit("database").alias("source_type"), F.col("db_uri").alias("source_id"), of(("summary", "business_domain"), ("uri", "db_uri")).alias("content"), F.lit(0.8).alias("score")))


def entity_evidence(nodes: DataFrame, score: Column) -> DataFrame:
    content = F.map_from_arrays(F.array(*map(F.lit, ("name", "type", "description", "datasource"))), F.array("name", "type", "description", "datasource"))
    return nodes.select(F.lit("entity").alias("source_type"), F.col("id").alias("source_id"), content.alias("content"), score.cast("double").alias("score"))


def relation_evidence(relations: DataFrame) -> DataFrame:
    """Relations (source, target, predicate, relationship_id), one for each id."""
    content = F.map_from_arrays(F.array(*map(F.lit, ("source", "target", "predicate"))), F.array("source", "target", "predicate"))
    return relations.dropDuplicates(["relationship_id"]).select(F.lit("relation").alias("source_type"), F.col("relationship_id").alias("source_id"), content.alias("content"), F.lit(RELATION_SCORE).alias("score"))


def from_graph(nodes: DataFrame, edges: DataFrame, uris: DataFrame | None, question: str, entities: list[str], per_uri: int = 100, names: int = 50, relations: int = 200, score: float = 0.9) -> DataFrame:
    """Evidence of the graph: entities under each URI and their relations; without URIs, entities by full text."""
    if uris is not None and not uris.isEmpty():
        hit = prefix_join(nodes, "datasource", uris.select("uri").distinct(), "uri")
        found = top_per(hit, ["uri"], per_uri, F.asc("id")).dropDuplicates(["id"])
        value = F.lit(score)
    else:
        found = full_text(nodes, question, 15)
        value = F.when(F.lower("name").isin([e.lower() for e in entities]), 1.0).otherwise(fn.capped(F.coalesce("similarity", F.lit(0.0)) + 0.5))
        names = 5
    chosen = found.select("name").distinct().orderBy("name").limit(names)
    ways = both_ways(edges.select("subject", "object", "predicate", "relationship_id"))
    near = ways.join(chosen.withColumnRenamed("name", "subject"), "subject", "left_semi").orderBy("relationship_id", "subject").limit(relations)
    rels = near.select(F.col("subject").alias("source"), F.col("object").alias("target"), "predicate", "relationship_id")
    return entity_evidence(found, value).unionByName(relation_evidence(rels))


def fuse(evidence: DataFrame, entities: list[str]) -> DataFrame:
    """Evidence without repeats, scores raised by source and by named entities, capped at 1, ranked within each source."""
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("content"))))
    rows = evidence.withColumns({"text": text, "hash": F.md5(text.cast("binary"))})
    one = first_per(rows, ["hash"], -F.col("score"), "source_type", "source_id")
    rank = F.coalesce(*[F.when(F.col("source_type") == k, v) for k, v in PRIORITY.items()], F.lit(0))
    named = F.lit(False)
    for e in entities:
        named = named | F.col("text").contains(e)
    total = fn.capped(F.col("score") + PRIORITY_STEP * rank + F.when(named, ENTITY_BONUS).otherwise(0.0))
    placed = numbered(one.withColumn("score", total), "source_type", F.desc("score"), "source_id", to="place")
    first = placed.groupBy("source_type").agg(F.min("place").alias("first")).withColumnRenamed("source_type", "kind")
    out = placed.join(F.broadcast(first), F.col("source_type").eqNullSafe(F.col("kind"))).withColumn("n", F.col("place") - F.col("first"))  # a row a kind of source
    return out.select(F.concat_ws("_", "source_type", F.col("n").cast("string")).alias("evidence_id"), "source_type", "source_id", "content", "score", summary().alias("summary"), citation().alias("citation"))


def summary() -> Column:
    c = lambda k: F.nullif(F.col("content")[k], F.lit(""))
    arrow = F.concat(c("source"), F.lit(" → "), c("target"), F.lit("（"), F.coalesce(c("predicate"), F.lit("")), F.lit("）"))
    return F.coalesce(c("summary"), c("description"), c("title"), c("name"), arrow)


def citation() -> Column:
    c = lambda k: F.col("content")[k]
    kind = F.col("source_type")
    return F.when(kind == "document", F.concat_ws(" · ", c("uri"), c("title"))).when(kind == "database", c("uri")).when(kind == "entity", c("name")).otherwise(F.concat_ws(" ", c("source"), c("predicate"), c("target")))


def citations(fused: DataFrame) -> DataFrame:
    """Distinct citations of documents and of tables."""
    table_level = (F.col("source_type") == "database") & F.col("content")["table"].isNotNull()
    return fused.where((F.col("source_type") == "document") | table_level).select("source_type", "citation").distinct()


def context(fused: DataFrame) -> DataFrame:
    """One row: for each source all pieces of evidence, best first, and their number; and an estimate of the tokens. ``context_parts`` holds the same in rows."""
    item = F.struct((-F.col("score")).alias("o"), "evidence_id", "summary", "score")
    lists = [F.sort_array(F.collect_list(F.when(F.col("source_type") == k, item))).alias(k) for k in PRIORITY]
    return fused.agg(*lists, *[F.count_if(F.col("source_type") == k).alias(f"n_{k}") for k in PRIORITY], F.floor(F.coalesce(F.sum(F.length("summary")), F.lit(0)) / 4).alias("tokens"))


def context_parts(fused: DataFrame, size: int = 1000) -> DataFrame:
    """(source_type, part, pieces, chars): the lists of a context in parts of *size* pieces, best first, so that no task holds a whole list; none is left out."""
    place = F.element_at(F.split("evidence_id", "_"), -1).cast("long")  # ranks are part of the ids
    item = F.struct(place.alias("place"), "evidence_id", "summary", "score")
    return fused.groupBy("source_type", F.floor(place / size).alias("part")).agg(F.sort_array(F.collect_list(item)).alias("pieces"), F.sum(F.length("summary")).alias("chars"))


def counts(evidence: DataFrame) -> DataFrame:
    return evidence.agg(*[F.count_if(F.col("source_type") == k).alias(f"n_{k}") for k in PRIORITY])


def prompt_rows(fused: DataFrame, budget: int = 20_000) -> DataFrame:
    """What goes into a prompt: all entities and relations, then tables, then documents, as long as they fit."""
    line = F.to_json(F.struct("evidence_id", "summary", "score"))
    rows = fused.withColumns({"line": line, "place": F.when(F.col("source_type").isin("entity", "relation"), 0).when(F.col("source_type") == "database", 1).otherwise(2)})
    always = rows.where("place = 0")
    used = always.agg(F.coalesce(F.sum(F.length("line")), F.lit(0))).first()[0]
    # A line has LEAST_LINE characters at least, so no more than this many of the first can fit.
    order = [F.asc("place"), F.desc("score"), F.asc("evidence_id")]
    first = rows.where("place > 0").orderBy(*order).limit(max(0, budget - used) // LEAST_LINE + 1)
    rest = budget_prefix(first.withColumn("g", F.lit(1)), ["g"], [F.asc("place"), F.desc("score"), F.asc("evidence_id")], F.length("line"), max(0, budget - used))
    return always.select("evidence_id", "line").unionByName(rest.select("evidence_id", "line"))


def content_dedup(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    return first_per(df.withColumn("hash", content_hash(*columns)), ["hash"], order)
