"""Documents with many entries, pages and headings: no frame or join may grow with the square of a document."""

import random
import re

from loomgraph.operators import store
from loomgraph.plans import documents


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_nodes_are_not_broadcast_by_file_size(spark, tmp_path):
    spark.createDataFrame([(f"n{i}", f"id{i}") for i in range(50)], "name string, id string").write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    rels = spark.createDataFrame([("n1", "p", "N2"), ("n1", "p", "lost")], "s string, p string, o string")
    found = store.resolve(rels, nodes)
    assert "Broadcast" not in plan(found)
    assert sorted((r.subject_id, r.object_id) for r in found.collect() if r.object_id) == [("id1", "id2")]


def outline(n: int, seed: int) -> list:
    rnd, level, rows = random.Random(seed), 1, []
    for i in range(1, n + 1):
        level = rnd.randint(1, min(6, level + 1))
        rows.append((1, i, level, i, "t" * (4 * rnd.randint(0, 5)), f"h{i}", "", ""))
    return rows


OUTLINE = "doc_id long, ord int, level int, line_num int, text string, title string, node_id string, parent_id string"


def test_subtree_tokens_have_no_frame_to_the_end(spark):
    nodes = spark.createDataFrame(rows := outline(60, 1), OUTLINE)
    got = documents.subtree_tokens(nodes)
    assert "unboundedfollowing$())" not in plan(got).replace("specifiedwindowframe(RowFrame, unboundedpreceding$(), unboundedfollowing$())", "")
    want = {}
    for at, r in enumerate(rows):
        end = next((k for k in range(at + 1, len(rows)) if rows[k][2] <= r[2]), len(rows))
        want[r[1]] = sum(len(x[4]) // 4 for x in rows[at:end])
    assert {r.ord: r.tokens for r in got.collect()} == want


def test_locate_by_parts_of_titles(spark):
    pages, entries = paged(3)
    p, e = spark.createDataFrame(pages, "doc_id long, page int, text string"), spark.createDataFrame(entries, "doc_id long, ord int, title string")
    toc = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page int")
    found = documents.locate(e, p, toc)
    got = {(r.doc_id, r.ord): r.physical_index for r in found.collect()}
    assert got == {(d, i): first_page(pages, d, t, 3 if d == 1 else 1, 120) for d, i, t in entries}
    keys = re.findall(r"Join \[([^\]]*)\][^\n]*Contains", plan(found))
    assert keys and all("page" in k for k in keys)


def test_thin_sections_join_without_python(spark):
    nodes = spark.createDataFrame(rows := outline(80, 2), OUTLINE)
    got = documents.thin(nodes, 8)
    assert "Pandas" not in plan(got)
    tokens = {r.ord: r.tokens for r in documents.subtree_tokens(nodes).collect()}
    want, inside = [], None
    for _, at, level, _, text, title, _, _ in rows:
        if inside and level > inside[1]:
            inside[2] += "\n\n" + text
            continue
        want.append(row := [title, level, text])
        inside = row if tokens[at] < 8 else None
    assert [[r.title, r.level, r.text] for r in got.orderBy("ord").collect()] == want


def paged(seed: int) -> tuple[list, list]:
    """Pages of random words, some without text, and entries with titles from one letter to several words."""
    rnd = random.Random(seed)
    words = [f"{w}{i}" for w in ("alpha", "béta", "x", "🙂") for i in range(40)]
    pages = [(d, p, None if rnd.random() < 0.05 else " ".join(rnd.choices(words, k=6))) for d in (1, 2) for p in range(1, 121)]
    entries = []
    for d in (1, 2):
        for i in range(1, 61):
            text = rnd.choice([p[2] for p in pages if p[0] == d and p[2]])
            at = rnd.randrange(len(text) - 1)
            entries.append((d, i, rnd.choice([text[at : at + rnd.randint(1, 20)], "", "no such title", None])))
    return pages, entries


def first_page(pages, d, title, low, high):
    return min((p for doc, p, t in pages if doc == d and t is not None and title is not None and low <= p <= high and title in t), default=None)


def test_fill_missing_between_near_and_far_neighbours(spark):
    pages, entries = paged(4)
    rnd = random.Random(5)
    rows = [(d, i, t, 2 * i if rnd.random() < (0.4 if d == 1 else 0.03) else None) for d, i, t in entries]
    got = documents.fill_missing(spark.createDataFrame(rows, "doc_id long, ord int, title string, physical_index int"), spark.createDataFrame(pages, "doc_id long, page int, text string"))
    want = {}
    for d, i, t, at in rows:
        low = next((r[3] for r in reversed(rows) if r[0] == d and r[1] < i and r[3]), 1)
        high = next((r[3] for r in rows if r[0] == d and r[1] > i and r[3]), 1 << 30)
        want[d, i] = at or first_page(pages, d, t, low, high)
    assert {(r.doc_id, r.ord): r.physical_index for r in got.collect()} == want


def test_node_text_joins_pages_by_number(spark):
    pages = spark.createDataFrame([(1, i, f"p{i}.") for i in range(1, 8)], "doc_id long, page int, text string")
    nodes = spark.createDataFrame([(1, 1, 2, 4), (1, 2, 4, 1_000_000_000), (1, 3, 9, 9), (1, 4, None, 3)], "doc_id long, ord int, start_index int, end_index int")
    assert [r.text for r in documents.node_text(nodes, pages).orderBy("ord").collect()] == ["p2.p3.p4.", "p4.p5.p6.p7.", None, None]
