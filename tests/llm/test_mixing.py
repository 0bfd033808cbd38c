import hashlib
import random
import re
from fractions import Fraction

from loomgraph.llm import mixing
from loomgraph.llm.common import only


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute(docs, weights=(3, 1, 2)):
    """(id, source, size, target, taken) by clamping one source after another and one running sum a source."""
    rows = [(d, s, n_words(t)) for d, t, s in docs]
    names = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    size = {s: sum(n for _, x, n in rows if x == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, free, target = Fraction(3, 2) * sum(size.values()), set(names), {}
    while free:
        level = Fraction(budget, sum(weight[s] for s in free))
        above = {s for s in free if level * weight[s] > 2 * size[s]}
        if not above:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: Fraction(2 * size[s]) for s in above}
        budget -= sum(2 * size[s] for s in above)
        free -= above
    out = []
    for s in names:
        quota = int(target[s] + Fraction(1, 2))
        whole, left = divmod(quota, size[s]) if size[s] else (0, 0)
        mine = sorted((hashlib.md5(f"11:{'' if d is None else d}".encode()).hexdigest(), n, d) for d, x, n in rows if x == s)
        for _, n, d in mine:
            extra = max(0, min(n, left))
            left -= extra
            out.append((d, s, n, float(target[s]), whole * n + extra))
    return out


def check(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = sorted(map(repr, map(tuple, mixing.mix(df, keep=("doc_id", "source"), **options).select("doc_id", "source", "size", "target", "taken").collect())))
    assert got == sorted(map(repr, brute(docs)))


def test_equals_brute_force(spark):
    rng = random.Random(3)
    names = ["b", "a", "", None, "é", "z", "hot"]
    docs = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 40]))), "hot" if rng.random() < 0.4 else rng.choice(names)) for i in range(300)]
    docs += [(None, "x y", "a"), (None, "x y", "a"), (7, docs[7][1], docs[7][2]), (301, None, "only null"), (302, "one\n\x0btwo three", "z"), (303, "w " * 20_000, "long")]
    check(spark, docs)


def test_narrowing_goes_down_to_rows_that_are_alike(spark):
    docs = [(5, "a b c", "s")] * 200 + [(None, None, "s"), (6, "a", "s")] + [(i, "x " * 9, "t") for i in range(10)] + [(i, "u", None) for i in range(3)]
    check(spark, docs, few=1)


def test_targets_and_bounds(spark, sf):
    got = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), keep=("doc_id", "source")).toPandas()
    sums = got.groupby("source", dropna=False).agg({"taken": "sum", "target": "first", "size": "sum"})
    assert ((sums["taken"] - sums["target"]).abs() <= 0.5).all() and (sums["target"] <= 2 * sums["size"]).all()
    assert (got["taken"] <= 2 * got["size"]).all()
    assert abs(sums["target"].sum() - 1.5 * got["size"].sum()) < 1e-3


def test_copies_hold_the_words_taken(spark):
    docs = [(1, "a  b\nc", "s", 1), (2, "d e", "s", 2), (3, "f g h i j k l m n o", "t", 3), (4, "", "t", 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, copy_of int")
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    seen = {}
    for r in mixing.copies(df).collect():
        assert n_words(r.text) == r.words
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.words
    assert seen == {k: v for k, v in taken.items() if v}


def test_empty_tables_and_names_that_clash(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    df = spark.createDataFrame([(1, "a b", "s", "Other", 9, 8)], "doc_id long, text string, source string, Text string, size int, id int")
    got = mixing.mix(df).collect()[0]
    assert (got["size"], got["taken"], got["Text"], got["id"]) == (2, 3, "Other", 8)
    assert only(df, "text").collect() == [("a b",)]
