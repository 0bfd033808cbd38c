"""Graph reads: scans, pages, neighbours, degrees, samples and the subgraph for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions.text import clamp
from .paths import _cut


def scan_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("type", F.coalesce("type", F.lit("Entity")))


def with_ends(edges: DataFrame, nodes: DataFrame, *extra: str) -> DataFrame:
    """Edges joined to the names (and *extra* columns) of both ends."""
    side = lambda p: nodes.select(F.col("id").alias(f"{p}_id"), F.col("name").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in extra])
    return edges.join(side("subject"), "subject_id").join(side("object"), "object_id")


def scan_edges(edges: DataFrame, nodes: DataFrame, limit: int = 5000) -> DataFrame:
    """The first edges by id, with both names; *limit* is held between 1 and 50 000."""
    return with_ends(edges, nodes).orderBy("relationship_id").limit(clamp(limit, 1, 50_000))


def page(df: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def pages(total: int, limit: int) -> int:
    return -(-total // limit) if limit else 0


def keyset_page(df: DataFrame, keys: list[str], last: tuple | None, limit: int) -> DataFrame:
    """The *limit* rows that follow key *last*: structs compare part by part."""
    if last is not None:
        df = df.where(F.struct(*keys) > F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, last)]))
    return df.orderBy(*keys).limit(limit)


def contains(c: Column | str, text: str, ignore_case: bool = False) -> Column:
    c = model.as_column(c)
    return F.lower(c).contains(text.lower()) if ignore_case else c.contains(text)


def search_names(nodes: DataFrame, text: str, ignore_case: bool = False, fields: tuple[str, ...] = ("name", "description")) -> DataFrame:
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(contains(f, text, ignore_case), F.lit(False))
    return nodes.where(hit)


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch any of *ids*: two equi-joins, not one join on an OR."""
    left = edges.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi")
    right = edges.join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi")
    return left.unionByName(right).dropDuplicates(["relationship_id"])


def incident_to(edges: DataFrame, entity: str) -> DataFrame:
    """Edges of one node, with the direction seen from it."""
    s, o = F.col("subject_id") == entity, F.col("object_id") == entity
    return edges.where(s | o).withColumn("direction", F.when(s, "outgoing").otherwise("incoming"))


def both_ways(edges: DataFrame, a: str = "subject", b: str = "object") -> DataFrame:
    """Each edge once from either end; a loop once."""
    back = edges.where(F.col(a) != F.col(b)).withColumns({a: F.col(b), b: F.col(a)})
    return edges.unionByName(back)


def expand(edges: DataFrame, names: DataFrame, limit: int = 200) -> DataFrame:
    """Edges of the named nodes in either direction, as (source, target, predicate, relationship_id); source is the node asked for."""
    ways = both_ways(edges.select("subject", "object", "predicate", "relationship_id"))
    hit = ways.join(names.select(F.col("name").alias("subject")).distinct(), "subject", "left_semi")
    return hit.select(F.col("subject").alias("source"), F.col("object").alias("target"), "predicate", "relationship_id").orderBy("relationship_id", "source").limit(limit)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among *ids*."""
    a = edges.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi")
    return a.join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi")


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids one step from *ids* and not among them."""
    ways = both_ways(edges.select("subject_id", "object_id"), "subject_id", "object_id")
    out = ways.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").select(F.col("object_id").alias("id"))
    return out.join(ids, "id", "left_anti").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): every incident edge counts, a loop twice, nodes without edges 0."""
    ends = edges.select(F.explode(F.array("subject_id", "object_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def type_counts(nodes: DataFrame) -> DataFrame:
    return scan_nodes(nodes).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def quotas(counts: DataFrame, limit: int) -> DataFrame:
    """(type, n, quota): a fifth of the limit dealt evenly, at least 1 a type, the rest in proportion."""
    facts = counts.agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total"))
    base = F.greatest(F.lit(1), F.floor(F.lit(limit) / (F.lit(5) * F.col("kinds"))))
    rest = F.greatest(F.lit(0), F.lit(limit) - base * F.col("kinds"))
    share = F.floor(rest * F.col("n") / F.col("total"))
    return counts.join(F.broadcast(facts)).select("type", "n", F.least(base + share, F.col("n")).cast("long").alias("quota"))  # one row of facts


def stratified(nodes: DataFrame, limit: int, order: str = "id") -> DataFrame:
    """Up to *limit* nodes with every type present: first each type's quota, then others in *order*."""
    typed = scan_nodes(nodes)
    rank = F.row_number().over(Window.partitionBy("type").orderBy(order))
    ranked = typed.withColumn("__r", rank).where(F.col("__r") <= limit).join(quotas(type_counts(nodes), limit), "type")
    first = F.when(F.col("__r") <= F.col("quota"), 0).otherwise(1)
    return ranked.withColumn("__late", first).orderBy("__late", order).limit(limit).drop("__r", "__late", "n", "quota")


def list_page(nodes: DataFrame, kind: str | None = None, text: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, int]:
    """One page and the total: plain, by type, by text, or stratified where the page is large and the table larger."""
    found = scan_nodes(nodes)
    if kind:
        found = found.where(F.col("type") == kind)
    if text:
        found = search_names(found, text, True, ("name", "description", "datasource"))
    total = found.count()
    if not kind and not text and offset == 0 and limit >= 1000 and total > limit:
        return stratified(nodes, limit), total
    return page(found, ["id"], offset, limit), total


def subgraph(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, min_edges: int = 1, max_nodes: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges to show: core nodes by type and degree, sampled by type, then their neighbours, then the edges among all."""
    min_edges = clamp(min_edges, 0, 20)
    typed = scan_nodes(nodes)
    chosen = typed.where(F.col("type").isin(types)) if types is not None else typed
    # Read three times below: the types that the sample is taken by, its rows, its size.
    core = _cut(chosen.join(degrees(chosen, edges).where(F.col("degree") >= min_edges), "id").select("id", "type"))
    ids = _cut(stratified(core, max_nodes).select("id"), core)  # at most max_nodes rows
    if min_edges > 0:
        near = neighbours(edges, ids).join(typed.select("id"), "id", "left_semi")
        ids = _cut(ids.withColumn("__late", F.lit(0)).unionByName(near.withColumn("__late", F.lit(1))).orderBy("__late", "id").limit(max_nodes).drop("__late"), ids)
    return typed.join(ids, "id", "left_semi"), induced(edges, ids)


def list_entities(nodes: DataFrame, kind: str | None = None, limit: int = 100) -> DataFrame:
    found = scan_nodes(nodes)
    return (found.where(F.col("type") == kind) if kind else found).orderBy("id").limit(limit)


def by_datasource(nodes: DataFrame, datasource: str) -> DataFrame:
    return nodes.where(model.exact_or_under("datasource", datasource))


def of_document(nodes: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    """Edges that touch the entities of one source."""
    return incident(edges, nodes.where(model.under("datasource", prefix)).select("id"))


def cross_if_small(a: DataFrame, b: DataFrame, most: int = 50) -> DataFrame:
    """All pairs, if there are no more than *most*; else none."""
    n = a.limit(most + 1).count() * b.limit(most + 1).count()
    pairs = a.limit(most + 1).crossJoin(b.limit(most + 1))
    return pairs if n <= most else pairs.limit(0)


def list_relationships(edges: DataFrame, nodes: DataFrame, limit: int = 100) -> DataFrame:
    return with_ends(edges, nodes, "type").orderBy("relationship_id").limit(limit)


def links_for_display(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, type) with node ids: an end is an id, else a name, else unknown; links with an unknown end go."""
    out = edges
    for end in ("source", "target"):
        by_id = nodes.select(F.col("id").alias(f"__i_{end}"))
        by_name = nodes.groupBy(F.col("name").alias(f"__n_{end}")).agg(F.min("id").alias(f"__v_{end}"))
        out = out.join(by_id, F.col(end) == F.col(f"__i_{end}"), "left").join(by_name, F.col(end) == F.col(f"__n_{end}"), "left")
        out = out.withColumn(f"{end}_id", F.coalesce(f"__i_{end}", f"__v_{end}")).drop(f"__i_{end}", f"__n_{end}", f"__v_{end}")
    return out.where("source_id IS NOT NULL AND target_id IS NOT NULL").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "type")


def related(edges: DataFrame, nodes: DataFrame, entity: str) -> DataFrame:
    """Neighbours of one node, given by id or name: (id, name, predicate, direction)."""
    me = nodes.where((F.col("id") == entity) | (F.col("name") == entity)).select(F.col("id").alias("me"))
    out = edges.join(me, F.col("subject_id") == F.col("me")).select(F.col("object_id").alias("id"), "predicate", F.lit("outgoing").alias("direction"))
    into = edges.join(me, F.col("object_id") == F.col("me")).where("subject_id <> object_id").select(F.col("subject_id").alias("id"), "predicate", F.lit("incoming").alias("direction"))
    return out.unionByName(into).join(nodes.select("id", "name"), "id").select("id", "name", "predicate", "direction")


def count_having(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """Nodes with at least *least* edges, and how many."""
    return nodes.join(degrees(nodes, edges).where(F.col("degree") >= least), "id")
