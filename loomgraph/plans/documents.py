"""Document trees as flat node tables: (doc_id, node_id, parent_id, depth, ord, title, text, ...).

Markdown outlines come from windows over exploded lines, paged outlines from windows over their entries; only folds that
depend on order in a way that windows can't express run in Python, a document at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import text as fn
from ..operators.paths import _cut, drop


def numbered_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n, line): lines from 1."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("n"), "line")


def headings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n, line, level): level is null off headings and inside code fences. An indented heading is none."""
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    fence = F.trim("line").startswith("```")
    fenced = F.coalesce(F.sum(fence.cast("int")).over(w), F.lit(0)) % 2 == 1
    return numbered_lines(docs, text).withColumn("level", F.when(~fence & ~fenced, fn.heading_level("line")))


def markdown_nodes(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a heading, in pre-order: node_id, parent_id, level, title, text (to the next heading), line number. Text before the first heading is lost."""
    lines = headings(docs, text)
    so_far = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = lines.withColumn("ord", F.count("level").over(so_far)).where("ord > 0")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x.line), "\n")
    nodes = numbered.groupBy("doc_id", "ord").agg(F.max("level").alias("level"), F.min("n").alias("line_num"), fn_trim(body).alias("text"), F.min_by("line", "n").alias("first"))
    return with_parents(nodes.withColumn("title", fn.heading_title("first")).drop("first"))


def fn_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def with_parents(nodes: DataFrame) -> DataFrame:
    """Parent: the nearest earlier node of smaller level. One conditional ``last`` for each of the six levels."""
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = [F.last(F.when(F.col("level") == k, F.col("ord")), ignorenulls=True).over(before) for k in range(1, 6)]
    out = nodes.withColumn("__seen", F.array(*seen))
    parent = F.array_max(F.slice("__seen", 1, F.greatest(F.col("level") - 1, F.lit(0))))
    out = out.withColumn("parent", parent).drop("__seen")
    return out.withColumns({"node_id": fn.node_number("ord"), "parent_id": fn.node_number("parent")}).drop("parent")


def _following() -> WindowSpec:
    """The rows after one of a document, nearest last: a frame that grows, where one to the end of the document would be read anew for every row."""
    return Window.partitionBy("doc_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)


def _subtrees(nodes: DataFrame) -> DataFrame:
    """Nodes with ``tokens``, their own and their descendants', and ``__next``, the first later node of no greater level (null: none)."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    own = nodes.withColumn("__t", fn.tokens("text").cast("long"))
    own = own.withColumns({"__before": F.sum("__t").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__t"), "__all": F.sum("__t").over(Window.partitionBy("doc_id"))})
    # What is counted before the next node of level k or less, and that node, for each of the six levels.
    ends = F.array(*[F.last(F.when(F.col("level") <= k, F.struct(F.col("__before").alias("t"), F.col("ord").alias("n"))), ignorenulls=True).over(_following()) for k in range(1, 7)])
    own = own.withColumn("__end", F.try_element_at(ends, F.col("level").cast("int")))
    tokens = F.coalesce(F.col("__end.t"), F.col("__all")) - F.col("__before")
    return own.select(*nodes.columns, tokens.alias("tokens"), F.col("__end.n").alias("__next"))


def subtree_tokens(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, tokens): a node's own and its descendants', which run to the next node of no greater level."""
    return _subtrees(nodes).select("doc_id", "ord", "tokens")


def thin(nodes: DataFrame, least: int) -> DataFrame:
    """Nodes whose subtree has fewer than *least* tokens take in all their descendants."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    # Subtrees lie within each other or apart, so a node is inside a thin one if any thin one before it ends after it.
    end = F.when(F.col("tokens") < least, F.coalesce("__next", F.lit((1 << 63) - 1)))
    inside = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)) > F.col("ord"), F.lit(False))
    head = F.last(F.when(~F.col("__inside"), F.col("ord")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = _subtrees(nodes).withColumn("__inside", inside).withColumn("__head", head)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x.text), "\n\n").alias("text")
    own = F.min_by(F.struct(*[c for c in nodes.columns if c not in ("doc_id", "text")]), "ord").alias("__own")
    joined = placed.groupBy("doc_id", "__head").agg(text, own)
    return with_parents(joined.select(*[c if c in ("doc_id", "text") else F.col(f"__own.{c}") for c in nodes.columns]).drop("node_id", "parent_id"))


def text_nodes(docs: DataFrame, text: str = "text") -> DataFrame:
    """A level-1 node for each paragraph, titled by its number, with its first line; an empty document is one empty node."""
    parts = docs.select("doc_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n")).alias("p", "body"))
    size = F.size(F.split("body", "\n")) + 1
    before = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    found = parts.withColumn("line_num", F.coalesce(F.sum(size).over(before), F.lit(0)) + 1).where((F.trim("body") != "") | (F.col("p") == 0))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("p"))
    return found.select("doc_id", number.alias("ord"), F.lit(1).alias("level"), F.concat(F.lit("段落 "), number.cast("string")).alias("title"), fn_trim(F.col("body")).alias("text"), F.col("line_num").cast("long").alias("line_num"), fn.node_number(number).alias("node_id"), F.lit(None).cast("string").alias("parent_id"))


def leaves(nodes: DataFrame) -> DataFrame:
    parents = nodes.where("parent_id IS NOT NULL").select("doc_id", F.col("parent_id").alias("node_id")).distinct()
    return nodes.join(parents, ["doc_id", "node_id"], "left_anti")


def summaries(nodes: DataFrame, summarize: Callable[[Column], Column] | None = None, short: int = 200) -> DataFrame:
    """Short texts are their own summary; longer ones go to *summarize* (default: their first sentence). Leaves get ``summary``, inner nodes ``prefix_summary``."""
    long = summarize(F.col("text")) if summarize else F.coalesce(F.get(fn.sentences("text"), F.lit(0)), F.lit(""))
    parents = nodes.where("parent_id IS NOT NULL").select("doc_id", F.col("parent_id").alias("node_id")).distinct().withColumn("__inner", F.lit(True))
    s = F.when(fn.tokens("text") < short, F.col("text")).otherwise(long)
    out = nodes.join(parents, ["doc_id", "node_id"], "left")
    return out.withColumns({"summary": F.when(F.col("__inner").isNull(), s), "prefix_summary": F.when(F.col("__inner"), s)}).drop("__inner")


def tree_json(nodes: DataFrame, name: Column | str = "doc_id") -> DataFrame:
    """(doc_id, document): each document's nodes as one JSON text in pre-order, with parents named."""
    item = F.struct("ord", "node_id", "parent_id", "level", "title", "text")
    return nodes.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("structure")).select("doc_id", F.to_json(F.struct(F.col(name).cast("string").alias("doc_name"), "structure")).alias("document"))


def nested(rows: list[dict]) -> list[dict]:
    """The nested form of one document's flat nodes."""
    by_id = {r["node_id"]: {k: v for k, v in r.items() if k != "parent_id"} | {"nodes": []} for r in rows}
    top = []
    for r in rows:
        (by_id[r["parent_id"]]["nodes"] if r.get("parent_id") in by_id else top).append(by_id[r["node_id"]])
    return top


# Paged documents: an outline is (doc_id, ord, structure, title, physical_index, appear_start).


def sections(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Start and end page of each entry: up to the page before the next entry if that opens its page, else up to that page; the last to the end."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    nxt, opens = F.lead("physical_index").over(w), F.lead("appear_start").over(w)
    last = pages.groupBy("doc_id").agg(F.max("page").alias("__last"))
    end = F.when(nxt.isNull(), F.col("__last")).when(opens == "yes", nxt - 1).otherwise(nxt)
    return outline.join(last, "doc_id").withColumns({"start_index": F.col("physical_index"), "end_index": F.greatest(end, F.col("physical_index"))}).drop("__last")


def nest(outline: DataFrame) -> DataFrame:
    """Parents by dotted codes; an entry whose parent is missing is a root."""
    parents = outline.select("doc_id", F.col("structure").alias("__code"), F.col("ord").alias("__parent"))
    own = outline.withColumn("__code", fn.parent_code("structure"))
    out = own.join(parents, ["doc_id", "__code"], "left")
    return out.withColumns({"node_id": fn.node_number("ord"), "parent_id": fn.node_number("__parent")}).drop("__code", "__parent")


def with_preface(outline: DataFrame) -> DataFrame:
    """A first entry ``Preface`` where the first one starts after page 1."""
    first = outline.groupBy("doc_id").agg(F.min_by("physical_index", "ord").alias("at")).where("at > 1")
    rows = first.select("doc_id", F.lit(0).alias("ord"), F.lit("0").alias("structure"), F.lit("Preface").alias("title"), F.lit(1).alias("physical_index"), F.lit("yes").alias("appear_start"))
    return outline.select("doc_id", "ord", "structure", "title", "physical_index", "appear_start").unionByName(rows)


def page_offset(toc: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, offset): most frequent physical minus printed page over equal titles; ties to the one seen first."""
    pairs = toc.join(found.select("doc_id", "title", "physical_index"), ["doc_id", "title"]).where("physical_index >= 1 AND page IS NOT NULL")
    counted = pairs.groupBy("doc_id", (F.col("physical_index") - F.col("page")).alias("offset")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("seen"))
    return counted.groupBy("doc_id").agg(F.max_by("offset", F.struct("n", -F.col("seen"))).alias("offset"))


def apply_offset(toc: DataFrame, offsets: DataFrame) -> DataFrame:
    return toc.join(offsets, "doc_id", "left").withColumn("physical_index", F.col("page") + F.coalesce("offset", F.lit(0))).drop("offset")


def known_neighbours(outline: DataFrame) -> DataFrame:
    """For entries without a page: the nearest known pages before and after."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    prev = F.last("physical_index", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.last("physical_index", ignorenulls=True).over(_following())
    return outline.withColumns({"page_before": prev, "page_after": nxt})


#: Entries with no more pages than this to look through are joined to each of them; the others go by parts of ``GRAM`` characters.
NARROW, GRAM = 64, 8


def _grams(text: str, size: Column | int) -> Column:
    """All parts of *size* characters of a text, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), F.lit(size).cast("string"), F.lit("}))")), F.lit(1)))


def _first_pages(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, ord, found): the first page from ``low`` to ``high`` that holds the title of an entry (doc_id, ord, title, low, high); entries without one are left out.

    No document's entries are paired with all its pages. Where few pages come in question, each is read. Else, of a title's parts of ``GRAM`` characters the one on
    the fewest pages names those to read (a shorter title is such a part itself), and the first of the pages that hold the title follows in one pass over both in page order.
    """
    last = pages.groupBy("doc_id").agg(F.max("page").alias("__last"))
    wanted = wanted.join(last, "doc_id").withColumn("high", F.least("high", "__last")).where("low <= high AND title IS NOT NULL").drop("__last")
    near = wanted.where(F.col("high") - F.col("low") < NARROW).select("doc_id", "ord", "title", F.explode(F.sequence("low", "high")).alias("page"))
    read = near.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"]).where(F.col("text").contains(F.col("title"))).select("doc_id", "ord", "page")

    far = wanted.where(F.col("high") - F.col("low") >= NARROW)
    size = F.least(F.length("title"), F.lit(GRAM))
    asked = far.groupBy("doc_id").agg(F.min("low").alias("__from"), F.max("high").alias("__to"), F.collect_set(size).alias("__sizes"))
    here = pages.select("doc_id", "page", "text").where("text IS NOT NULL").join(asked, "doc_id").where("page BETWEEN __from AND __to")
    parts = here.select("doc_id", "page", F.explode("__sizes").alias("size"), "text").select("doc_id", "page", F.explode(_grams("text", F.col("size"))).alias("gram"))
    titles = far.select("doc_id", "title").distinct()
    own = titles.select("doc_id", "title", F.explode(_grams("title", size)).alias("gram"))
    rare = own.join(parts.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n")), ["doc_id", "gram"], "left").groupBy("doc_id", "title").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    held = rare.join(parts, ["doc_id", "gram"]).select("doc_id", "page", "title").join(pages.select("doc_id", "page", "text"), ["doc_id", "page"]).where(F.col("text").contains(F.col("title")))
    none = lambda kind: F.lit(None).cast(kind)
    line = held.select("doc_id", "title", F.col("page").alias("__at"), F.col("page").alias("__hit"), none(dict(far.dtypes)["ord"]).alias("ord"), none("long").alias("high"))
    line = line.unionByName(far.select("doc_id", "title", F.col("low").alias("__at"), none("int").alias("__hit"), "ord", F.col("high").cast("long").alias("high")))
    after = Window.partitionBy("doc_id", "title").orderBy(F.desc("__at"), F.desc_nulls_last("__hit")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = line.withColumn("page", F.last("__hit", ignorenulls=True).over(after)).where("high IS NOT NULL AND page <= high").select("doc_id", "ord", "page")
    return read.unionByName(passed).groupBy("doc_id", "ord").agg(F.min("page").alias("found"))


def fill_missing(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries without a page get the first page between their neighbours that holds their title."""
    gaps = known_neighbours(outline).where("physical_index IS NULL")
    wanted = gaps.select("doc_id", "ord", "title", F.coalesce("page_before", F.lit(1)).alias("low"), F.coalesce("page_after", F.lit(1 << 30)).alias("high"))
    found = _first_pages(wanted, pages).withColumnRenamed("found", "__page")
    return outline.join(found, ["doc_id", "ord"], "left").withColumn("physical_index", F.coalesce("physical_index", "__page")).drop("__page")


def title_opens_page(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """``appear_start``: whether the page, without blanks and case, starts with the title."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    here = pages.select("doc_id", F.col("page").alias("physical_index"), flat(F.col("text")).alias("__t"))
    return outline.drop("appear_start").join(here, ["doc_id", "physical_index"], "left").withColumn("appear_start", F.when(F.startswith("__t", flat(F.col("title"))), "yes").otherwise("no")).drop("__t")


def in_range(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages past the end become unknown."""
    last = pages.groupBy("doc_id").agg(F.max("page").alias("__last"))
    return outline.join(last, "doc_id", "left").withColumn("physical_index", F.when(F.col("physical_index") <= F.col("__last"), F.col("physical_index"))).drop("__last")


def toc_pages(pages: DataFrame, is_toc: Column, first: int = 20) -> DataFrame:
    """The first unbroken run of contents pages among the first pages: (doc_id, page)."""
    w = Window.partitionBy("doc_id").orderBy("page")
    hit = pages.where(F.col("page") <= first).where(is_toc).withColumn("run", F.col("page") - F.row_number().over(w))
    least = hit.groupBy("doc_id").agg(F.min("run").alias("run"))
    return hit.join(least, ["doc_id", "run"]).select("doc_id", "page")


def accuracy(checked: DataFrame) -> DataFrame:
    return checked.groupBy("doc_id").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))


def node_text(nodes: DataFrame, pages: DataFrame, labels: bool = False) -> DataFrame:
    """Nodes with the joined texts of their pages."""
    body = F.concat(fn.page_tag("p.page"), F.lit("\n"), F.col("p.text"), F.lit("\n"), fn.page_tag("p.page")) if labels else F.col("p.text")
    spans = nodes.join(pages.groupBy("doc_id").agg(F.max("page").alias("__last")), "doc_id").withColumn("__end", F.least("end_index", "__last")).where("start_index <= __end")
    spans = spans.select("doc_id", "ord", F.explode(F.sequence("start_index", "__end")).alias("page"))
    hit = spans.alias("n").join(pages.alias("p"), ["doc_id", "page"])
    joined = hit.groupBy("doc_id", "ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("p.page").alias("page"), body.alias("t")))), lambda x: x.t), "").alias("text"))
    return nodes.drop("text").join(joined, ["doc_id", "ord"], "left")


def too_large(nodes: DataFrame, pages: int = 10, tokens: int = 20_000) -> DataFrame:
    """Nodes that span more pages than *pages* and have at least *tokens* tokens: to be split further."""
    return nodes.where((F.col("end_index") - F.col("start_index") > pages) & (fn.tokens("text") >= tokens))


def span_tokens(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes with ``tokens``, those of their pages: the difference of two sums up to a page, so that no page is joined to more than the nodes that it bounds."""
    size = fn.tokens("text").cast("long")
    sums = pages.select("doc_id", "page", size.alias("__own"), F.sum(size).over(Window.partitionBy("doc_id").orderBy("page")).alias("__sum"))
    before = sums.select("doc_id", F.col("page").alias("start_index"), (F.col("__sum") - F.col("__own")).alias("__before"))
    upto = sums.select("doc_id", F.col("page").alias("end_index"), F.col("__sum").alias("__upto"))
    out = nodes.join(before, ["doc_id", "start_index"], "left").join(upto, ["doc_id", "end_index"], "left")
    return out.withColumn("tokens", F.col("__upto") - F.col("__before")).drop("__upto", "__before")


def _own_entries(entries: DataFrame, large: DataFrame, seen: DataFrame, all_levels: bool) -> DataFrame:
    """Of what was found on the pages of large nodes, what lies between a node's own entry and the next one that is a node already."""
    known = seen.select(F.col("doc_id").alias("__doc"), F.col("title").alias("__name"), F.col("start_index").alias("__at")).distinct().withColumn("__known", F.lit(True))
    same = (F.col("doc_id.doc_id") == F.col("__doc")) & (F.col("title") == F.col("__name")) & (F.col("physical_index") == F.col("__at"))
    own = large.select("doc_id", F.trim("title").alias("__title"), F.col("start_index").alias("__start"))
    rows = entries.where("physical_index IS NOT NULL").join(known, same, "left").drop("__doc", "__name", "__at").join(own, "doc_id")
    group = Window.partitionBy("doc_id")
    here = F.col("physical_index") == F.col("__start")
    after = F.coalesce(F.max(F.when(here & (F.col("title") == F.col("__title")), F.col("ord"))).over(group), F.max(F.when(here & F.col("__known"), F.col("ord"))).over(group), F.lit(0))
    rows = rows.withColumn("__after", after)
    rows = rows.withColumn("__until", F.min(F.when(F.col("__known") & (F.col("ord") > F.col("__after")), F.col("ord"))).over(group))
    rows = rows.where("ord > __after AND (__until IS NULL OR ord < __until)")
    if not all_levels:
        depth = F.size(F.split("structure", r"\."))
        rows = rows.withColumn("__depth", depth).withColumn("__least", F.min("__depth").over(group)).where("__depth = __least").drop("__depth", "__least")
    rows = rows.withColumn("ord", F.row_number().over(group.orderBy("ord")))
    return rows.drop("__known", "__title", "__start", "__after", "__until")


def split_large(tree: DataFrame, pages: DataFrame, most_pages: int = 10, least_tokens: int = 20_000, outline: Callable[[DataFrame], DataFrame] | None = None, all_levels: bool = True) -> DataFrame:
    """Sections (doc_id, node, parent, title, start_index, end_index) with large ones split, and their parts, until none is large or has parts.

    A section is large if it ends more than *most_pages* pages after its start and its pages have *least_tokens* tokens or more. Its parts are
    what *outline* finds on its pages (doc_id, page, text), where doc_id names the section: (doc_id, ord, structure, title, physical_index); without
    one, numbered lines. Parts hang under each other by their codes, else under the section, and the section ends where its first part
    starts. With *all_levels* off only the least deep parts are taken; deeper ones come if those are large. ``node`` of a part is the section's and a number, so that
    the order of ``node`` is that of the document.

    A round a level, all documents at once. Defined results: sections without known pages, or of documents without pages or id, stay as they are; a part on a page that
    two sections share belongs to the one whose entry comes before it; lines that repeat a title on one page are parts each.
    """
    columns = ["doc_id", "node", "parent", "title", "start_index", "end_index"]
    seen = front = _cut(tree.select(*columns))
    while True:
        large = span_tokens(front, pages).where((F.col("end_index") - F.col("start_index") > most_pages) & (F.col("tokens") >= least_tokens))
        large = large.withColumn("doc_id", F.struct("doc_id", "node"))
        numbers = large.select(F.col("doc_id").alias("__key"), F.col("doc_id.doc_id").alias("doc_id"), F.explode(F.sequence("start_index", "end_index")).alias("page"))
        inside = numbers.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"]).select(F.col("__key").alias("doc_id"), "page", "text")
        found = _own_entries((outline or outline_of_pages)(inside), large, seen, all_levels)
        found = sections(title_opens_page(found, inside), large.select("doc_id", F.col("end_index").alias("page")))
        codes = found.groupBy("doc_id", F.col("structure").alias("__code")).agg(F.collect_list("ord").alias("__at"))
        found = found.withColumn("__code", fn.parent_code("structure")).join(codes, ["doc_id", "__code"], "left")
        above = F.array_max(F.filter("__at", lambda x: x < F.col("ord")))
        part = lambda n: F.concat(F.col("doc_id.node"), F.lit("."), fn.node_number(n))
        parts = found.select(F.col("doc_id.doc_id").alias("doc_id"), part(F.col("ord")).alias("node"), F.coalesce(part(above), F.col("doc_id.node")).alias("parent"), "title", "start_index", "end_index", F.col("doc_id.node").alias("__of"))
        parts = _cut(parts)
        last = front if "__of" in front.columns else None
        if parts.isEmpty():
            drop(parts, *([last] if last is not None else []))
            return seen
        first = parts.groupBy("doc_id", F.col("__of").alias("node")).agg(F.min("start_index").alias("__end"))
        cut = seen.join(first, ["doc_id", "node"], "left").withColumn("end_index", F.coalesce("__end", "end_index")).drop("__end")
        seen = _cut(cut.select(*columns).unionByName(parts.select(*columns)), seen)
        if last is not None:
            drop(last)
        front = parts


def page_groups(pages: DataFrame, most: int = 20_000, overlap: int = 1) -> DataFrame:
    """(doc_id, group, first, last): pages in groups of about equal tokens."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("page")
        found = folds.page_groups(f.tokens.tolist(), most, overlap)
        at = f.page.tolist()
        return pd.DataFrame([(f.doc_id.iloc[0], i, at[a], at[b]) for i, (a, b) in enumerate(found)], columns=["doc_id", "group", "first", "last"])

    return pages.select("doc_id", "page", fn.tokens("text").alias("tokens")).groupBy("doc_id").applyInPandas(run, "doc_id long, group int, first int, last int")


def segments(nodes: DataFrame, most: int = 20_000) -> DataFrame:
    """(doc_id, ord, part, title, text): node texts, long ones cut at sentence ends."""
    parts = nodes.where(F.length("text") > most).select("doc_id", "ord", "title", F.posexplode(folds.split_text_udf("text", F.lit(most))).alias("part", "text"))
    short = nodes.where((F.length("text") > 0) & (F.length("text") <= most)).select("doc_id", "ord", "title", F.lit(0).alias("part"), "text")
    return short.unionByName(_cut(parts))  # only long texts go through Python, in small batches


def merged_segments(segs: DataFrame, least: int = 1000, most: int = 20_000) -> DataFrame:
    """(doc_id, part, title, text): short neighbours of a document put together."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["ord", "part"])
        out = folds.merge_segments(list(zip(f.title, f.text)), least, most)
        return pd.DataFrame([(f.doc_id.iloc[0], i, t, s) for i, (t, s) in enumerate(out)], columns=["doc_id", "part", "title", "text"])

    return segs.groupBy("doc_id").applyInPandas(run, "doc_id long, part int, title string, text string")


# Contents pages and outlines by a model. A model is a callable on columns; the defaults need none.

TOC_LINE = r"^\s*((?:\d+\.)*\d+)\.?\s+(.*?)(?:\s*:\s*|\s+)(\d+)\s*$"


def toc_text(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """(doc_id, text, has_pages): the contents pages joined, leader dots as colons, and whether lines end in page numbers."""
    hit = pages.join(toc, ["doc_id", "page"], "left_semi")
    joined = hit.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x.text), "\n").alias("t"))
    return joined.select("doc_id", fn.leader_dots("t").alias("text")).withColumn("has_pages", F.col("text").rlike(r"(?m)\d+\s*$"))


def toc_entries(toc: DataFrame) -> DataFrame:
    """(doc_id, ord, structure, title, page) of contents text, a line an entry: number, title, page."""
    lines = toc.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).where(F.col("line").rlike(TOC_LINE))
    part = lambda k: F.regexp_extract("line", TOC_LINE, k)
    return lines.select("doc_id", (F.col("ord") + 1).alias("ord"), part(1).alias("structure"), F.trim(part(2)).alias("title"), part(3).try_cast("int").alias("page"))


def outline_of_pages(pages: DataFrame) -> DataFrame:
    """An outline without contents pages: page lines that start with a dotted number and are short."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").rlike(r"^\s*(?:\d+\.)*\d+\.?\s+\S") & (F.length("line") <= 120))
    ordered = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "at"))
    code = F.regexp_extract("line", r"^\s*((?:\d+\.)*\d+)\.?\s", 1)
    return lines.select("doc_id", ordered.alias("ord"), code.alias("structure"), F.trim(F.regexp_replace("line", r"^\s*(?:\d+\.)*\d+\.?\s+", "")).alias("title"), F.col("page").alias("physical_index"))


def locate(entries: DataFrame, pages: DataFrame, after: DataFrame) -> DataFrame:
    """Entries with the first page past the contents pages that holds their title; null if none does."""
    last = after.groupBy("doc_id").agg(F.max("page").alias("__toc"))
    wanted = entries.join(last, "doc_id", "left").select("doc_id", "ord", "title", (F.coalesce("__toc", F.lit(0)) + 1).alias("low"), F.lit(1 << 30).alias("high"))
    return entries.join(_first_pages(wanted, pages).withColumnRenamed("found", "physical_index"), ["doc_id", "ord"], "left")


def checked(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """``correct``: whether the page of an entry holds its title."""
    here = pages.select("doc_id", F.col("page").alias("physical_index"), F.col("text").alias("__t"))
    return outline.join(here, ["doc_id", "physical_index"], "left").withColumn("correct", F.coalesce(F.col("__t").contains(F.col("title")), F.lit(False))).drop("__t")


def repaired(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Wrong pages are dropped and looked for again between their neighbours."""
    bad = checked(outline, pages)
    return fill_missing(bad.withColumn("physical_index", F.when(F.col("correct"), F.col("physical_index"))).drop("correct"), pages)


def paged_tree(pages: DataFrame, is_toc: Column) -> DataFrame:
    """From pages (doc_id, page, text) to nested sections: by contents pages where a document has them, else by numbered lines."""
    # Tables that several joins read are written, else each of them would make all before it anew.
    toc = _cut(toc_pages(pages, is_toc))
    pages = _cut(pages)
    entries = _cut(toc_entries(toc_text(pages, toc)))
    found = _cut(locate(entries, pages, toc))
    placed = apply_offset(entries, page_offset(entries, found))
    direct = outline_of_pages(pages.join(entries.select("doc_id").distinct(), "doc_id", "left_anti"))
    rows = placed.select("doc_id", "ord", "structure", "title", "physical_index").unionByName(direct.select("doc_id", "ord", "structure", "title", "physical_index"))
    rows = _cut(fill_missing(_cut(in_range(rows, pages)), pages).where("physical_index IS NOT NULL"))
    return node_text(nest(sections(with_preface(title_opens_page(rows, pages)), pages)), pages)


def markdown_tree(docs: DataFrame, least_tokens: int | None = None, text: str = "text") -> DataFrame:
    """Markdown documents to summarised nodes, small subtrees merged where asked for."""
    nodes = markdown_nodes(docs, text)
    return summaries(thin(nodes, least_tokens) if least_tokens else nodes)


def project(nodes: DataFrame, drop: tuple[str, ...] = (), first: tuple[str, ...] = ("doc_id", "node_id", "title")) -> DataFrame:
    """Nodes without some fields, the named ones first."""
    left = [c for c in nodes.columns if c not in drop]
    return nodes.select(*[c for c in first if c in left], *[c for c in left if c not in first])


def over_limit(nodes: DataFrame, most: int = 110_000) -> DataFrame:
    return nodes.where(fn.tokens("text") > most)


def write_trees(nodes: DataFrame, path: str) -> None:
    """One JSON line a document, in a folder for each."""
    tree_json(nodes).write.mode("overwrite").partitionBy("doc_id").text(path)
