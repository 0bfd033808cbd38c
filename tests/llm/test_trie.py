import hashlib
import math
import random
import re
import zlib

from loomgraph.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: (y[0], y[1], y[2].encode(), y[3].encode()))] for c, x in own.items()}
    built = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + said[h:]
    members = {}
    for c, said in built.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    children, out = {}, []
    for path in members:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    words = lambda path: len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, m in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(m) - 1) * words(path)
            leaves[path[:d]] += path not in children
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(m), len(path), parent, len(m), children.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(n, seed=1):
    rng = random.Random(seed)
    turns = [("user", "a b"), ("user", "a  b c"), ("assistant", "a b"), (None, None), ("", "x"), ("user", "é 日本 😀")]
    rows = [(c, i, *turns[min(len(turns) - 1, int(rng.expovariate(0.8)))]) for c in rng.sample(range(-50, 900), n) for i in range(rng.choice([0, 1, 1, 2, 3, 5, 7]))]
    return rows


def run(spark, rows, **options):
    return sorted(map(tuple, trie.trie(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=repr)


def test_equals_brute_force(spark):
    rows = made(300)
    rows += [(40, None, "user", "first"), (40, None, "user", "first"), (40, 3, "b", "z"), (40, 3, "a", "z"), (None, 1, "user", "of none"), (20, 1, "u", "v"), (21, 0, "u", "w")]
    rows += [(c, i, "user", f"copy {i}") for c in range(2000, 2200) for i in range(3)]
    assert run(spark, rows) == brute(rows)


def test_collisions_are_split(spark):
    rows = made(120, 2)
    for primes in (((11, 13), *trie.PRIMES[:2]), ((2, 3), (101, 103), *trie.PRIMES[:1])):
        assert run(spark, rows, primes=primes) == brute(rows)


def test_conversations_over_several_ranges(spark):
    rng = random.Random(6)
    rows = [(7, rng.choice([None, i]), "user", f"turn {i % 50}") for i in range(200)] + [(27, i, "user", f"turn {i}") for i in range(60)]
    rows += [(20, i, "system", "s") for i in range(5)] + [(0, 0, "system", "s")] + [(c, i, "user", "t") for c in range(21, 25) for i in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = trie._turns(trie.only(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text"), 0, trie.PRIMES[0])
        assert turns.where("conv_id = 7").agg({"at": "max"}).first()[0] == 200 and turns.select("conv_id", "at").distinct().count() == len(rows)
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_texts_empty_tables_and_names_that_clash(spark):
    rows = [(1, 0, "user", "w " * 200_000 + "x"), (2, 0, "user", "w " * 200_000 + "y"), (3, 0, "user", "w " * 200_000 + "x")]
    assert run(spark, rows) == brute(rows)
    assert trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, 0, "u", "a b", "T", 5, 6), (21, 0, "u", "a b", "T", 5, 6)], SCHEMA + ", Text string, depth int, hash int")
    assert sorted(map(tuple, trie.trie(df).collect()), key=repr) == brute([(1, 0, "u", "a b"), (21, 0, "u", "a b")])
