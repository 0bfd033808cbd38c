"""Stored index, SQLite files, result cache, stream source and its supervision, commits of several tables, patterns of any length."""

import json
import random
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from loomgraph import cache, catalog, model, query
from loomgraph.operators import retrieval, store
from loomgraph.operators.textindex import TextIndex
from loomgraph.sources import redis, sqlite
from loomgraph.streaming import cdc
from loomgraph.streaming.supervisor import Supervisor
from tests.fake_redis import Fake


def nodes_of(spark, rows):
    return spark.createDataFrame([(f"k{i:04}", n, None, None, None, t) for i, n, t in rows], "id string, name string, description string, byname string, datasource string, type string")


def test_text_index_equals_a_scan(spark, tmp_path, monkeypatch):
    import loomgraph.operators.textindex as module

    rng = random.Random(1)
    words = ["tax", "tax", "form", "form", "the", "the", "the", "office", "rare", "x1"]
    name = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 30)))
    rows = {i: name() for i in range(400)}
    rows[7] = "rare rare rare rare"
    index = TextIndex(spark, str(tmp_path / "index"))

    def check(text):
        all_nodes = nodes_of(spark, [(i, n, "t") for i, n in rows.items()])
        want = [(r.id, round(r.score, 9)) for r in retrieval.full_text(all_nodes, text).where("score IS NOT NULL").collect()]
        assert [(r.key, round(r.score, 9)) for r in index.search(text).collect()] == want

    index.build(nodes_of(spark, [(i, n, "t") for i, n in rows.items()]))
    check("rare tax office")
    check("rare")
    assert index.last["lowest_tier"] > 0  # tiers below were not read
    changed = {i: name() for i in (*range(0, 40), 500, 501)}
    gone = [5, 7, 90]
    rows |= changed
    for i in gone:
        rows.pop(i)
    index.update(nodes_of(spark, [(i, n, "t") for i, n in changed.items() if i not in gone]), nodes_of(spark, [(i, "", "t") for i in gone]))
    check("rare tax office")
    monkeypatch.setattr(module, "SEGMENTS", 2)
    rows[600] = "rare tax"
    index.update(nodes_of(spark, [(600, "rare tax", "t")]))
    assert len(index._state()[1]["segments"]) == 1
    check("Tax the")
    assert index.search("nothing").collect() == [] and index.search("").collect() == []


def test_text_index_does_its_work_once(spark, tmp_path, monkeypatch):
    """Words are counted within their rows, after one dealing of the rows; a search reads each tier once and no empty one (F22)."""
    names = ["", "b a b", "x " * 50 + "y"] + [f"form {'tax ' * (i % 7)}{i}" for i in range(60)]
    rows = nodes_of(spark, [(i, n, "t") for i, n in enumerate(names)])
    index = TextIndex(spark, str(tmp_path / "index"), fields=("name",))
    words = index._words(rows)
    assert {r.key: (r.size, r.counts) for r in words.collect()} == {f"k{i:04}": (len(n.split()), {w: n.split().count(w) for w in n.split()}) for i, n in enumerate(names)}
    assert words._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange rangepartitioning") == 1
    assert "Exchange hashpartitioning" not in words._jdf.queryExecution().executedPlan().toString()
    index.build(rows)
    index.update(nodes_of(spark, [(i, f"other {i}", "t") for i in range(40, 60)]))
    seen, plain = [], index._live_postings
    monkeypatch.setattr(index, "_live_postings", lambda segments, found, lowest, above: seen.append((lowest, above)) or plain(segments, found, lowest, above))
    got = [(r.key, round(r.score, 9)) for r in index.search("tax form", 40).collect()]
    now = nodes_of(spark, [(i, f"other {i}" if 40 <= i < 60 else n, "t") for i, n in enumerate(names)])
    assert got == [(r.id, round(r.score, 9)) for r in retrieval.full_text(now, "tax form", 40, fields=("name",)).where("score IS NOT NULL").collect()]
    full = {t for tiers in index.last["tiers_of_terms"].values() for t in tiers}
    assert seen and all(a[0] >= b[1] for a, b in zip(seen, seen[1:])) and all(any(lo <= t < hi for t in full) for lo, hi in seen)


def test_pages_know_how_rare_a_word_is_among_all(spark):
    nodes = nodes_of(spark, [(i, "tax form" if i % 5 == 0 else "form", "t1" if i % 2 else "t2") for i in range(40)])
    page, total = retrieval.full_text_page(nodes, "tax", kind="t1")
    whole = {r.id: r.score for r in retrieval.full_text(nodes, "tax", 40).collect()}
    assert total == 4 and all(r.score == whole[r.id] for r in page.collect())


def test_prefix_join_has_no_nested_loop(spark):
    rows = spark.createDataFrame([("abc",), ("ab",), ("b",), (None,), ("",)], "t string")
    prefixes = spark.createDataFrame([("a",), ("ab",), ("",), ("abcd",), (None,)], "p string")
    got = retrieval.prefix_join(rows, "t", prefixes, "p")
    assert sorted(map(tuple, got.collect())) == [("", ""), ("ab", ""), ("ab", "a"), ("ab", "ab"), ("abc", ""), ("abc", "a"), ("abc", "ab"), ("b", "")]
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "shop.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE customers (id INTEGER PRIMARY KEY, name TEXT NOT NULL, score REAL)")
        db.execute("CREATE TABLE orders (a INTEGER, b INTEGER, cust INTEGER REFERENCES customers(id), note TEXT COLLATE NOCASE, PRIMARY KEY (a, b)) WITHOUT ROWID")
        db.executemany("INSERT INTO customers VALUES (?, ?, ?)", [(i, f"n{i}", None if i % 7 == 0 else i / 2) for i in range(1, 1001)])
        db.executemany("INSERT INTO orders VALUES (?, ?, ?, ?)", [(i, i % 3, i % 1000 + 1, "Ab" if i % 2 else "ab") for i in range(50)])
        db.execute("INSERT INTO customers VALUES (5000, 'odd', 'text in a number')".replace("'text in a number'", "12.5"))
    return path


def test_sqlite_scan(spark, database):
    df = sqlite.scan(spark, database, "customers", rows=300)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("score", "double")]
    assert df.count() == 1001 and df.rdd.getNumPartitions() == 17
    few = df.where("id BETWEEN 10 AND 12 AND name <> 'n11' AND score IS NOT NULL")
    assert sorted(map(tuple, few.select("name", "id").collect())) == [("n10", 10), ("n12", 12)]
    orders = sqlite.scan(spark, database, "orders")
    assert orders.where("note = 'ab'").count() == 25 and orders.where("note > 'B'").count() == 25 and orders.where(F.col("a").isin(3, 4)).count() == 2
    reader = sqlite.SqliteReader({"path": database, "table": "customers"}, df.schema)
    from pyspark.sql.datasource import GreaterThan

    list(reader.pushFilters([GreaterThan(("id",), 990)]))
    assert reader.where and sum(len(list(reader.read(p))) for p in reader.partitions()) == 11


def test_sqlite_catalog(spark, database):
    cat = catalog.read_sqlite(spark, database)
    assert {r.table_name: r.keys for r in catalog.primary_keys(cat.columns).collect()} == {"customers": ["id"], "orders": ["a", "b"]}
    assert [tuple(r)[:4] for r in cat.foreign.collect()] == [("orders", "cust", "customers", "id")]
    kinds = {(r.table_name, r.column_name): (r.ordinal, r.data_type, r.is_nullable) for r in cat.columns.collect()}
    assert kinds["customers", "name"] == (2, "TEXT", "NO") and kinds["orders", "note"] == (4, "TEXT", "YES")
    refined = catalog.refine_keys(spark.createDataFrame([("orders", ["a"])], "table_name string, keys array<string>"), catalog.primary_keys(cat.columns))
    assert refined.first()["keys"] == ["a", "b"]


def test_result_cache(spark, tmp_path):
    now = [1000.0]
    kept = cache.ResultCache(spark, str(tmp_path / "cache"), 60, clock=lambda: now[0])
    graph = store.GraphStore(spark, str(tmp_path / "graph"))
    put = lambda names: graph.upsert("nodes", model.with_defaults(spark.createDataFrame([(n, "a", n, "t") for n in names], "name string, datasource string, id string, type string")))
    ask = lambda: kept.get(graph.nodes.groupBy("type").count(), graph.version("nodes"))
    put(["x", "y"])
    assert [tuple(r) for r in ask().collect()] == [("t", 2)] and (kept.hits, kept.misses) == (0, 1)
    hit = ask()
    assert [tuple(r) for r in hit.collect()] == [("t", 2)] and (kept.hits, kept.misses) == (1, 1)
    assert all("/cache/" in f for f in hit.inputFiles())
    put(["z"])  # a write makes another version
    assert [tuple(r) for r in ask().collect()] == [("t", 3)] and kept.misses == 2
    now[0] += 61
    assert [tuple(r) for r in ask().collect()] == [("t", 3)] and kept.misses == 3
    assert kept.purge() == 2
    kept.invalidate()
    ask()
    assert kept.misses == 4


def test_tables_are_committed_together(spark, tmp_path, monkeypatch):
    graph = store.GraphStore(spark, str(tmp_path / "graph"))
    nodes = lambda *n: model.with_defaults(spark.createDataFrame([(x, "a", x, "t") for x in n], "name string, datasource string, id string, type string"))
    edges = lambda *p: spark.createDataFrame([(a + b, a, b) for a, b in p], "relationship_id string, subject_id string, object_id string")
    graph.write_all({"nodes": nodes("x", "y"), "edges": edges(("x", "y"))})
    written = []
    with monkeypatch.context() as m:
        put = graph._written
        m.setattr(graph, "_written", lambda t, df: written.append(t) or (put(t, df) if len(written) < 2 else (_ for _ in ()).throw(RuntimeError("killed"))))
        with pytest.raises(RuntimeError):
            graph.write_all({"edges": graph.edges.limit(0), "nodes": nodes("y")})
    assert written == ["edges", "nodes"] and graph.nodes.count() == 2 and graph.edges.count() == 1
    graph.delete(nodes("x"))
    assert len(graph._parts("nodes")) == 2  # a small change beside the whole table
    assert [r.id for r in graph.nodes.collect()] == ["y"] and graph.edges.count() == 0
    with pytest.raises(RuntimeError, match="another writer"):
        graph._point(graph._state()[0] - 1, {})


SCHEMAS = [cdc.Schema("users", ["id", "v"], ["id"], [])]


def message(seq, op, key, value):
    row = {"id": str(key), "v": value}
    return seq, json.dumps({"op": op, "before": row if op == "d" else None, "after": None if op == "d" else row, "source": {"table": "users"}, "ts_ms": 5})


def test_older_events_of_later_batches_change_nothing(spark, tmp_path):
    rng = random.Random(3)
    events = [message(f"{i}-0", rng.choice("cud"), rng.randrange(6), f"v{i}") for i in range(40)]
    frame = lambda part: spark.createDataFrame(part, "seq string, payload string")
    shuffled = rng.sample(events, len(events))
    states = []
    for name, batches in (("sorted", [events]), ("shuffled", [shuffled[:15], shuffled[15:25], shuffled[25:], shuffled[:15]])):
        follower = cdc.Follower(store.GraphStore(spark, str(tmp_path / name)), SCHEMAS, "DBS://c/db", str(tmp_path / "cp"))
        for n, b in enumerate(batches):
            follower.batch(frame(b), n)
        states.append(sorted((r.name, r.description) for r in follower.store.nodes.collect()))
    assert states[0] == states[1] and states[0]


def test_messages_are_parsed_once(spark):
    frame = spark.createDataFrame([message("1-0", "c", 1, "a")], "seq string, payload string")
    changes = cdc.parse(frame)
    for df in (cdc.latest(changes, SCHEMAS), changes.where("table = 'users' AND op <> 'd'").select("row", "ts_ms")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    nodes, edges = spark.createDataFrame([], model.NODE), spark.createDataFrame([], model.EDGE)
    assert "from_json" not in cdc.apply(nodes, edges, changes, SCHEMAS, "d")[0]._jdf.queryExecution().optimizedPlan().toString()


def test_redis_batches_are_bounded_and_acknowledged(spark, tmp_path):
    path = str(tmp_path / "redis.json")
    fake = Fake(path)
    rows = [(f"{1000 + i // 3}-{i % 3}", {"payload": f"p{i}"}) for i in range(100)]
    fake.add("s1", rows[:70])
    fake.add("s2", [("5-0", {"value": "only"})])
    spark.dataSource.register(redis.RedisStream)
    out, sizes = [], []

    def take(df, n):
        got = [(r.stream, r.seq, r.payload or r.value) for r in df.collect()]
        out.extend(got)
        sizes.append(len(got))

    def run():
        reader = spark.readStream.format("redis_stream").options(url=path, client="tests.fake_redis:client", streams="s1,s2", group="g", start="earliest", rows="20", parts="3").load()
        q = reader.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
        end, want = time.time() + 90, len(fake._load()["streams"]["s1"]) + 1
        while len(out) < want and time.time() < end and q.isActive:
            time.sleep(0.3)
        time.sleep(1)
        q.stop()

    run()
    assert sorted(out) == sorted([("s1", s, f["payload"]) for s, f in rows[:70]] + [("s2", "5-0", "only")]) and max(sizes) <= 40
    fake.add("s1", rows[70:])
    run()
    assert sorted(p for s, _, p in out if s == "s1") == sorted(f["payload"] for _, f in rows)  # nothing lost, nothing twice
    assert number_of(fake, "s1") >= (1000 + 69 // 3, 0)
    parts = redis.RedisReader({"url": path, "client": "tests.fake_redis:client", "streams": "s1"}).partitions({"s1": "0-0"}, {"s1": rows[-1][0]})
    assert len(parts) > 1 and (parts[0].start, parts[-1].end) == ("0-0", rows[-1][0]) and all(a.end == b.start for a, b in zip(parts, parts[1:]))


def number_of(fake, key):
    return redis.number(fake.xinfo_groups(key)[0]["last-delivered-id"])


def test_supervisor_restarts_with_delays(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("seq", "payload"), message(f"{i}-0", "c", i, "v")))) for i in range(5)))
    follower = cdc.Follower(store.GraphStore(spark, str(tmp_path / "g")), SCHEMAS, "DBS://c/db", str(tmp_path / "cp"))
    kills, work, lost = [2], follower.batch, [True, False, False]

    def batch(df, n):
        if kills[0]:
            kills[0] -= 1
            raise RuntimeError("killed")
        work(df, n)

    follower.batch = batch
    waits, reloads = [], []
    s = Supervisor(spark, lambda: follower.start(cdc.read_folder(spark, str(tmp_path / "in")), once=True), lost=lambda: lost.pop(0), reload=lambda: reloads.append(1), sleep=waits.append)
    s.run()
    assert waits == s.delays == [1, 2] and s.gaps == 1 and reloads == [1]
    assert sorted(r.name for r in follower.store.nodes.collect()) == [f"users:{i}" for i in range(5)]
    s.pause()
    assert s.state == "paused"
    s.resume()
    s.stop()
    assert s.state == "stopped"


def test_paths_of_any_length_end_on_cycles(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    edges = spark.createDataFrame([(x, y, "p", x + y) for x, y in pairs], "subject string, object string, predicate string, relationship_id string")
    want = set()

    def walk(start, at, used):
        for x, y in pairs:
            if x == at and (x, y) not in used:
                want.add((start, y, len(used) + 1))
                walk(start, y, [*used, (x, y)])

    for n in "abcd":
        walk(n, n, [])
    got = [(r.n0, r.n1, r.hops) for r in query.match_paths(edges).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {r.hops for r in query.match_paths(edges, 2, 3).collect()} == {2, 3} and query.match_paths(edges, 5, 9).collect() == []
    only = query.match_paths(edges, 1, 1, start=spark.createDataFrame([("a",)], "name string")).collect()
    assert [(r.n0, r.n1) for r in only] == [("a", "b")]
