import json

import pytest
from pyspark.sql import functions as F

from loomgraph import catalog, model, query, report
from loomgraph.functions import text as fn
from loomgraph.operators import graph, retrieval
from loomgraph.operators.store import GraphStore
from loomgraph.plans import decision, documents, extraction, importing
from loomgraph.sources import files, jdbc
from loomgraph.streaming import cdc


def employees(spark):
    emp = spark.createDataFrame([(1, "Ann"), (2, "Bo"), (None, "ghost")], "emp_no int, name string")
    dep = spark.createDataFrame([("d1", "Sales")], "dept_no string, title string")
    link = spark.createDataFrame([(1, "d1"), (2, "d1"), (2, None)], "emp_no int, dept_no string")
    return [
        importing.Table("employees", emp, ["emp_no"], type="person"),
        importing.Table("departments", dep, ["dept_no"]),
        importing.Table("dept_emp", link, ["emp_no", "dept_no"], [("emp_no", "employees", "emp_no"), ("dept_no", "departments", "dept_no")]),
    ]


def test_import(spark):
    nodes, edges = importing.import_graph(employees(spark), "DBS://c/db")
    assert sorted(r.name for r in nodes.collect()) == ["departments:d1", "dept_emp:1:d1", "dept_emp:2:d1", "employees:1", "employees:2"]
    assert nodes.where("name = 'employees:1'").first().description == "emp_no=1, name=Ann"
    assert sorted((r.subject, r.object) for r in edges.collect()) == [
        ("dept_emp:1:d1", "departments:d1"), ("dept_emp:1:d1", "employees:1"), ("dept_emp:2:d1", "departments:d1"), ("dept_emp:2:d1", "employees:2"),
    ]
    last = importing.import_graph(employees(spark), "DBS://c/db", "last")[1]
    assert sorted((r.subject, r.object) for r in last.collect()) == [("dept_emp:1:d1", "employees:1"), ("dept_emp:2:d1", "departments:d1"), ("dept_emp:2:d1", "employees:2")]
    with pytest.raises(ValueError):
        importing.import_graph(employees(spark), "x", "other")


SCHEMAS = [cdc.Schema("orders", ["id", "cust"], ["id"], [("cust", "customers")]), cdc.Schema("customers", ["id", "name"], ["id"], [])]


def message(seq, op, table, row, wrap=False, field="payload"):
    body = {"op": op, "before": row if op == "d" else None, "after": None if op == "d" else row, "source": {"table": table}, "ts_ms": 5}
    return {"seq": seq, "payload": None, "value": None, field: json.dumps({"schema": {}, "payload": body} if wrap else body)}


def frame(spark, messages):
    return spark.createDataFrame([(m["seq"], m["payload"], m["value"]) for m in messages], "seq string, payload string, value string")


def state(nodes, edges):
    return sorted(r.name for r in nodes.collect()), sorted(r.subject_id + r.object_id for r in edges.collect())


def pair(spark, a, b):
    r = spark.range(1).select(model.entity_id(F.lit(a)).alias("a"), model.entity_id(F.lit(b)).alias("b")).first()
    return r.a + r.b


def test_changes_follow_the_source(spark):
    nodes, edges = spark.createDataFrame([], model.NODE), spark.createDataFrame([], model.EDGE)
    step = lambda n, e, ms: cdc.apply(n, e, cdc.parse(frame(spark, ms)), SCHEMAS, "DBS://c/db")
    first = [message("1-0", "c", "orders", {"id": "7", "cust": "3"}, wrap=True), message("2-0", "r", "orders", {"id": "8", "cust": None}, field="value")]
    nodes, edges = step(nodes, edges, first + [{"seq": "3-0", "payload": "no json", "value": None}, message("4-0", "x", "orders", {"id": "9"})])
    assert state(nodes, edges) == (["orders:7", "orders:8"], [pair(spark, "orders:7", "customers:3")])
    assert [r.id for r in cdc.placeholders(nodes, edges).collect()] == [pair(spark, "customers:3", "x")[:32]]
    again = step(nodes, edges, first)
    assert state(*again) == state(nodes, edges)
    moved = step(nodes, edges, [message("9-0", "u", "orders", {"id": "7", "cust": "4"}), message("10-0", "c", "customers", {"id": "4", "name": "N"})])
    assert state(*moved) == (["customers:4", "orders:7", "orders:8"], [pair(spark, "orders:7", "customers:4")])
    unlinked = step(*moved, [message("11-0", "u", "orders", {"id": "7", "cust": None})])
    assert state(*unlinked)[1] == []
    gone = step(*moved, [message("20-0", "d", "orders", {"id": "7"}), message("3-0", "u", "orders", {"id": "7", "cust": "4"})])
    assert state(*gone) == (["customers:4", "orders:8"], [])


def test_imported_edges_count_in_the_diff(spark):
    tables = [importing.Table("customers", spark.createDataFrame([(3, "N")], "id int, name string"), ["id"]), importing.Table("orders", spark.createDataFrame([(7, 3)], "id int, cust int"), ["id"], [("cust", "customers", "id")])]
    nodes, edges = importing.import_graph(tables, "DBS://c/db")
    changes = cdc.parse(frame(spark, [message("1-0", "u", "orders", {"id": "7", "cust": "4"})]))
    assert state(*cdc.apply(nodes, edges.drop("subject", "object"), changes, SCHEMAS, "DBS://c/db"))[1] == [pair(spark, "orders:7", "customers:4")]
    both = cdc.apply(nodes, edges.drop("subject", "object"), changes, SCHEMAS, "DBS://c/db", cdc_only=True)
    assert len(state(*both)[1]) == 2


def test_stream_equals_batches_and_keeps_dead_letters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [[message("1-0", "c", "orders", {"id": "1", "cust": "2"})], [message("2-0", "c", "customers", {"id": "2", "name": "x"}), {"seq": "3-0", "payload": "broken", "value": None}]]
    follower = cdc.Follower(GraphStore(spark, str(tmp_path / "g")), SCHEMAS, "DBS://c/db", str(tmp_path / "cp"), str(tmp_path / "dead"))
    for i, b in enumerate(batches):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, b)))
        follower.start(cdc.read_folder(spark, str(tmp_path / "in")), once=True).awaitTermination(60)
    assert state(follower.store.nodes, follower.store.edges) == (["customers:2", "orders:1"], [pair(spark, "orders:1", "customers:2")])
    assert [r.seq for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == ["3-0"]
    assert follower.status()["running"] is False


def test_stream_gaps_compare_as_numbers():
    assert cdc.gap("1000-0", "999-5") and not cdc.gap("999-1", "1000-0") and cdc.gap(None, "5-0") and not cdc.gap("5-0", None)
    assert [cdc.backoff(n) for n in (0, 3, 9)] == [1, 8, 30]


MD = "lost\n# A\ntext a\n## B\n```\n# not a heading\n```\nb\n #indented\n### C\nc\n# D\n"


def test_markdown_tree(spark):
    docs = spark.createDataFrame([(1, MD), (2, None), (3, "no headings")], "doc_id long, text string")
    nodes = documents.markdown_nodes(docs)
    got = [(r.node_id, r.parent_id, r.level, r.title, r.line_num) for r in nodes.orderBy("ord").collect()]
    assert got == [("00000001", None, 1, "A", 2), ("00000002", "00000001", 2, "B", 4), ("00000003", "00000002", 3, "C", 10), ("00000004", None, 1, "D", 12)]
    assert nodes.where("title = 'B'").first().text == "## B\n```\n# not a heading\n```\nb\n #indented"
    assert sorted(r.title for r in documents.leaves(nodes).collect()) == ["C", "D"]
    tokens = {r.ord: r.tokens for r in documents.subtree_tokens(nodes).collect()}
    own = {r.ord: r.t for r in nodes.select("ord", fn.tokens("text").alias("t")).collect()}
    assert tokens == {1: own[1] + own[2] + own[3], 2: own[2] + own[3], 3: own[3], 4: own[4]}
    assert [r.title for r in documents.thin(nodes, 10_000).orderBy("ord").collect()] == ["A", "D"]
    tree = documents.nested([{"node_id": "1", "parent_id": None}, {"node_id": "2", "parent_id": "1"}])
    assert tree[0]["nodes"][0]["node_id"] == "2"
    s = documents.summaries(nodes).where("title IN ('A', 'C')").orderBy("ord").collect()
    assert s[0].summary is None and s[0].prefix_summary and s[1].summary == "### C\nc"
    assert json.loads(documents.tree_json(nodes).first().document)["structure"][1]["title"] == "B"


def test_text_tree_numbers_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb\n\nc\n\n\n\nd"), (2, "")], "doc_id long, text string")
    got = [(r.doc_id, r.title, r.text, r.line_num) for r in documents.text_nodes(docs).orderBy("doc_id", "ord").collect()]
    assert got[:2] == [(1, "段落 1", "a\nb", 1), (1, "段落 2", "c", 4)] and got[-1] == (2, "段落 1", "", 1)


def test_paged_outline(spark):
    pages = spark.createDataFrame([(1, p, t) for p, t in enumerate(["cover", "Intro text", "more", "Methods here", "x", "End"], 1)], "doc_id long, page int, text string")
    toc = spark.createDataFrame([(1, 1, "1", "Intro", 1), (1, 2, "1.1", "Methods", 3), (1, 3, "2", "End", 5), (1, 4, "3.9", "Orphan", None)], "doc_id long, ord int, structure string, title string, page int")
    found = toc.where("ord <= 2").withColumn("physical_index", F.col("page") + 1)
    outline = documents.apply_offset(toc, documents.page_offset(toc, found))
    assert [r.physical_index for r in outline.orderBy("ord").collect()] == [2, 4, 6, None]
    rows = documents.title_opens_page(documents.in_range(outline.where("ord < 4"), pages), pages)
    parts = documents.nest(documents.sections(documents.with_preface(rows), pages)).orderBy("ord").collect()
    assert [(r.title, r.start_index, r.end_index, r.parent_id) for r in parts] == [("Preface", 1, 1, None), ("Intro", 2, 3, None), ("Methods", 4, 5, "00000001"), ("End", 6, 6, None)]
    filled = documents.fill_missing(outline.withColumn("title", F.when(F.col("ord") == 4, "End").otherwise(F.col("title"))), pages)
    assert filled.where("ord = 4").first().physical_index == 6
    text = documents.node_text(documents.sections(rows, pages), pages).where("title = 'Intro'").first().text
    assert text == "Intro textmore"
    assert [r.page for r in documents.toc_pages(pages, F.col("page").isin(2, 3, 5)).orderBy("page").collect()] == [2, 3]
    groups = documents.page_groups(pages.withColumn("text", F.repeat(F.lit("abcd"), 100)), most=250)
    assert groups.count() >= 3


def test_segments_and_extraction(spark):
    nodes = spark.createDataFrame([(1, 1, "t", "One. Two。" * 10), (1, 2, "u", "short")], "doc_id long, ord int, title string, text string")
    segs = documents.segments(nodes, most=20)
    assert all(len(r.text) <= 20 for r in segs.collect())
    assert documents.merged_segments(segs, least=50, most=60).count() < segs.count()
    rows = extraction.extract_segments(spark.createDataFrame([(1, 0, "Ann met Bo Lee. Ann left.")], "doc_id long, part int, text string"))
    entities, relations = extraction.distinct_results(rows)
    assert sorted((r.n, r.c) for r in entities.collect()) == [("Ann", 2), ("Bo Lee", 1)] and relations.count() == 1

    def fails(text):
        raise RuntimeError

    assert extraction.call(fails, "x") == {"entities": [], "relationships": [], "error": "RuntimeError: "}
    calls = []

    def only_short(text):
        calls.append(len(text))
        return {"entities": [{"n": "A", "t": "x"}]} if len(text) < 1500 else {}

    assert extraction.extract(only_short, "word. " * 500)["entities"] == [{"n": "A", "t": "x"}] and len(calls) > 2


def test_evidence_and_decision(spark, tmp_path):
    tables = employees(spark)
    nodes, edges = importing.import_graph(tables, "DBS://c/db")
    docs = spark.createDataFrame([("DOC://u/f", "00000001", "Ann", "Ann works in sales", "handbook", 1)], "doc_uri string, node_id string, title string, summary string, doc_description string, depth int")
    cards = spark.createDataFrame([("DBS://c/db", "workforce data", "employees", "people such as Ann", "person")], "db_uri string, business_domain string, table_name string, summary string, entity_type string")
    registry = decision.Registry()
    registry.register(decision.Plugin())
    memory = decision.Conversations(spark, str(tmp_path / "turns"))
    know = decision.Knowledge(nodes, edges, docs, cards)
    a = registry.ask("no such domain", "Where does Ann work?", know, memory)
    b = registry.ask("workforce", "And Bo?", know, memory, a.session_id)
    assert (a.turn_id, b.turn_id) == ("turn_1", "turn_2") and any(c.startswith("DOC://u/f") for c in a.citations)
    assert [r.turn for r in memory.history(a.session_id).collect()] == [1, 2]
    with pytest.raises(LookupError):
        decision.Registry().get("x")
    fused = retrieval.fuse(decision.retrieve(know, "Ann", decision.analyze("Ann Lee")), ["Ann"])
    assert fused.agg(F.max("score")).first()[0] <= 1.0
    assert retrieval.counts(fused).first().n_database >= 1 and retrieval.context(fused).count() == 1


def test_full_text_falls_back_to_containment(spark):
    nodes = spark.createDataFrame([("1", "Alpha Beta", "DOC://a", "person"), ("2", "Gamma", "DOC://b", "place")], "id string, name string, datasource string, type string").withColumns({"description": F.lit("x-yz"), "byname": F.lit(None).cast("string")})
    hit = retrieval.full_text(nodes, "beta").collect()
    assert [r.id for r in hit] == ["1"] and hit[0].similarity <= 1
    assert [r.id for r in retrieval.full_text(nodes, "amm").collect()] == ["2"]
    assert retrieval.full_text(nodes, "alpha", prefixes=["DOC://b"]).count() == 0
    assert retrieval.full_text(nodes, "alpha", types=["place"]).count() == 0


def test_catalog(spark):
    frames = {t.name: t.rows for t in employees(spark)}
    c = catalog.from_frames(spark, frames, {"employees": ["emp_no"]}, [("dept_emp", "emp_no", "employees", "emp_no"), ("dept_emp", "dept_no", "departments", None)])
    assert {r.table_name: list(r["keys"]) for r in catalog.primary_keys(c.columns).collect()} == {"employees": ["emp_no"], "departments": ["dept_no"], "dept_emp": ["emp_no"]}
    assert c.foreign.count() == 1 and json.loads(catalog.summary(c, "db").first().document)["table_count"] == 3
    for d in ("mysql", "postgresql", "mssql", "oracle", "sqlite"):
        assert set(catalog.metadata_queries(d, "x")) == {"tables", "columns", "foreign"}
    with pytest.raises(ValueError):
        catalog.metadata_queries("dbase", "x")


def test_sqlite_metadata_runs(tmp_path):
    import sqlite3

    con = sqlite3.connect(tmp_path / "x.db")
    con.executescript("CREATE TABLE a(id INTEGER PRIMARY KEY, n TEXT NOT NULL); CREATE TABLE b(id INTEGER PRIMARY KEY, a_id INTEGER REFERENCES a(id));")
    q = catalog.metadata_queries("sqlite", "x")
    assert sorted(con.execute(q["tables"]).fetchall()) == [("a",), ("b",)]
    assert ("b", "a_id", "a", "id") == con.execute(q["foreign"]).fetchall()[0][:4]
    assert [r[5] for r in con.execute(q["columns"]).fetchall() if r[:2] == ("a", "id")] == ["PRI"]


def test_pages(spark):
    df = spark.createDataFrame([(i // 3, i % 3) for i in range(10)], "a int, b int")
    by_key = [tuple(r) for page in jdbc.pages_by_key(df, ["a", "b"], 4) for r in page]
    by_offset = [tuple(r) for page in jdbc.pages_by_offset(df, ["a", "b"], 4, 7) for r in page]
    assert by_key == sorted((i // 3, i % 3) for i in range(10)) and by_offset == by_key[:7]
    assert graph.pages(10, 4) == 3 and jdbc.any_row(df)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"one two\n\xff")
    (tmp_path / "sub" / "b.MD").write_text("# x")
    (tmp_path / "c.bin").write_text("")
    assert [p.rsplit("/", 1)[1] for p in files.list_files(str(tmp_path), True)] == ["a.txt", "b.MD"]
    got = files.read_any(spark, str(tmp_path), True, ("text",)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.word_count) for r in got) == [("a.txt", 3), ("b.MD", 2)]
    assert [e["name"] for e in files.browse(str(tmp_path))] == ["sub", "a.txt", "c.bin"]
    with pytest.raises(ValueError):
        files.browse(str(tmp_path), "../..")
    out = tmp_path / "summaries" / "DOC" / "u1"
    out.mkdir(parents=True)
    (out / "f.json").write_text('{"doc_name": "n"}')
    row = files.read_summaries(spark, str(tmp_path / "summaries")).selectExpr("uuid", "variant_get(document, '$.doc_name', 'string') AS n").first()
    assert tuple(row) == ("u1", "n")


def test_queries_and_reports(spark):
    nodes, edges = importing.import_graph(employees(spark), "DBS://c/db")
    assert query.run(spark, "SELECT * FROM nodes", nodes, edges, default_limit=2).count() == 2
    assert query.has_limit("select 1 limit 5") and not query.has_limit("select 'limit 5'") and not query.has_limit("select 1 -- limit 5")
    assert query.match(edges, 2).count() == 0 and query.match(edges, 1).count() == 4
    assert query.profile(nodes)["rows"] == 5
    data = {"scores": [{"measure": "degree", "name": "<a>", "score": 0.5}]}
    assert "0.5000" in report.render("centrality", data, "md") and "&lt;a&gt;" in report.render("centrality", data)
    assert "a → b" in report.render("path", {"paths": [["a", "b"]], "path_lengths": [1]}, "md")
    with pytest.raises(ValueError):
        report.render("path", {}, "pdf")


def test_paged_tree(spark):
    toc = "Contents\n1 Intro ........ 1\n1.1 Aims ........ 2\n2 End ........ 3"
    pages = [(1, p, t) for p, t in enumerate([toc, "Intro\nx", "Aims y", "End z"], 1)] + [(2, 1, "1 First\nbody"), (2, 2, "2 Second")]
    tree = documents.paged_tree(spark.createDataFrame(pages, "doc_id long, page int, text string"), F.col("text").startswith("Contents"))
    got = sorted((r.doc_id, r.title, r.start_index, r.end_index, r.parent_id) for r in tree.collect())
    assert got == [(1, "Aims", 3, 3, "00000002"), (1, "End", 4, 4, None), (1, "Intro", 2, 2, None), (1, "Preface", 1, 1, None), (2, "First", 1, 2, None), (2, "Second", 2, 2, None)]
    rows = spark.createDataFrame([(1, 1, "1", "Intro", 4), (1, 2, "2", "End", 4)], "doc_id long, ord int, structure string, title string, physical_index int")
    p = spark.createDataFrame(pages[:4], "doc_id long, page int, text string").where("page > 1")
    assert documents.accuracy(documents.checked(rows, p)).first().accuracy == 0.5
    assert [r.physical_index for r in documents.repaired(rows, p).orderBy("ord").collect()] == [2, 4]


def test_small_helpers(spark, tmp_path):
    from loomgraph.operators import dedup, store

    nodes, edges = importing.import_graph(employees(spark), "DBS://c/db")
    got = {(r.name, r.direction) for r in graph.related(edges, nodes, "employees:1").collect()}
    assert got == {("dept_emp:1:d1", "incoming")}
    links = spark.createDataFrame([("employees:1", "departments:d1", "x"), ("nobody", "employees:1", "x")], "source string, target string, type string")
    assert graph.links_for_display(links, nodes).count() == 1
    cascade = retrieval.expand_cascade(nodes, edges, spark.createDataFrame([("employees:1",), ("dept_emp:2",), ("departments:zz",)], "name string")).collect()
    assert {r.name for r in cascade} == {"employees:1", "dept_emp:2", "departments:zz"}
    saved, waiting = store.save_edges_only(spark.createDataFrame([("employees:1", "p", "EMPLOYEES:2"), ("a", "p", "b")], "s string, p string, o string"), nodes)
    assert saved.count() == 1 and waiting.first().subject_id == ""
    assert store.upsert_edges_by_name(saved, nodes, spark.createDataFrame([("employees:1", "p", "EMPLOYEES:2"), ("employees:1", "q", "employees:2")], "s string, p string, o string")).count() == 2
    assert dedup.sample_rows(nodes, 2, "id").count() == 2
    page, total = retrieval.full_text_page(nodes, "Ann", 1)
    assert total == 1 and page.count() == 1
    assert retrieval.full_text_page(nodes, "eMp_n")[1] > 0
    c = catalog.from_frames(spark, {"t": nodes.select("id")})
    catalog.save(c, str(tmp_path / "cat"))
    assert catalog.load(spark, str(tmp_path / "cat")).tables.count() == 1
    documents.write_trees(documents.markdown_tree(spark.createDataFrame([(1, MD)], "doc_id long, text string"), 1), str(tmp_path / "trees"))
    assert documents.over_limit(documents.markdown_nodes(spark.createDataFrame([(1, MD)], "doc_id long, text string"))).count() == 0


def test_handoff_from_import_to_stream(spark, tmp_path):
    tables = [importing.Table("customers", spark.createDataFrame([(3, "N")], "id int, name string"), ["id"]), importing.Table("orders", spark.createDataFrame([(7, 3)], "id int, cust int"), ["id"], [("cust", "customers", "id")])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(json.dumps(message("1-0", "d", "customers", {"id": "3", "name": "N"})))
    follower = cdc.Follower(GraphStore(spark, str(tmp_path / "g")), SCHEMAS, "DBS://c/db", str(tmp_path / "cp"))
    cdc.handoff(follower, *importing.import_graph(tables, "DBS://c/db"), cdc.read_folder(spark, str(tmp_path / "in")), once=True).awaitTermination(60)
    assert state(follower.store.nodes, follower.store.edges) == (["orders:7"], [])
