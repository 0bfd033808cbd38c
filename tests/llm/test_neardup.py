import random
from pathlib import Path

import numpy as np
import pytest

from loomgraph.llm import common, neardup


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopq") + str(rng.randrange(60))
    rows = [(1, ""), (2, "  \n"), (3, "One two"), (4, "one  TWO"), (5, "é É one")]
    for k in range(60):
        text = [word() for _ in range(rng.choice([3, 8, 40, 200]))]
        rows.append((100 * k + 50, " ".join(text)))
        for v in range(rng.randrange(4)):
            for _ in range(max(1, len(text) // rng.choice([15, 40, 80]))):
                text[rng.randrange(len(text))] = word()
            rows.append((100 * k + 49 - v, " ".join(text)))
    shared = [word() for _ in range(60)]
    rows += [(9000 + k, " ".join(shared + [word() for _ in range(k)])) for k in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(spark, seed):
    rows = corpus(seed)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(7, None, 1), (7, None, 1), (8, long, 2), (9, long + " x", 3), (None, "a b c", 4), (None, "a b c", 4), (10, "a b c", 5)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, rep long")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == [
        (0, 1, 0, True), (0, 1, 0, True), (7, 0, 7, True), (7, 0, 7, True), (8, 59_996, 8, True), (9, 59_997, 8, False), (10, 1, 10, True),
    ]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).collect() == []


def test_ids_with_several_texts(spark):
    """Each row is linked by its own text; equal ids alone link nothing; a text that only differs in case repeats its class."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (1, b.upper()), (6, b + " z"), (7, a + " z"), (3, a + " y"), (9, " ".join(f"c{i}" for i in range(40))), (9, "c")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 3: 1, 6: 1, 7: 1, 9: 9}


def test_one_row_of_each_component_is_kept(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [
        (None, a, "x"), (None, a, "x"), (None, None, "y"),  # no id: all stay
        (1, a, "n"), (1, a, "m"), (1, b, "n"), (1, b.upper() + " z", "n"), (6, b, "n"), (7, a + " y", "n"),  # two components of one id
        (2, "", "x"), (2, "", "x"), (2, None, "x"),  # no words: all stay
        (8, "only one here", "x"), (9, "some other words", "x"), (9, a, "q"),  # one of the two rows of 9 goes
    ]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, component string"))
    assert got.columns == ["doc_id", "text", "component"]
    key = lambda r: tuple((x is None, x) for x in r)
    want = [*rows[:3], (1, a, "m"), (1, b.upper() + " z", "n"), *rows[9:12], (8, "only one here", "x"), (9, "some other words", "x")]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert neardup.keep_one(got.limit(0)).collect() == []


def test_parts_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 3)
    rows = corpus(4)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_staged_tables_go(spark, tmp_path):
    """What a result still reads is all that stays in the shared folder, until it is dropped."""
    before = {p.name for p in Path(common.work_dir(spark).removeprefix("file:")).iterdir()}
    got = neardup.near_duplicates(spark.createDataFrame(corpus(5), "doc_id long, text string"))
    names = lambda: sorted(p.name.split("-")[1] for p in Path(common.work_dir(spark).removeprefix("file:")).iterdir() if p.name not in before)
    assert names() == ["classes", "edges", "sketches"]
    assert got.count() > 0
    common.drop_staged(got)
    assert names() == []


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 200)]
    got = {r.node: r.component for r in neardup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 50)}, 201: 200}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    for n in (1, 7, 300, 5000):
        u = rng.integers(0, 1 << 63, size=n, dtype=np.uint64)
        kept = u[: max(1, int(n * 0.75))]
        s = neardup.sketch(np.concatenate([u, kept]), np.array([n, len(kept)]))
        assert (s < np.iinfo(np.uint64).max).all()
        assert abs((s[0] == s[1]).mean() - len(kept) / n) < 0.2


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """Variants of one text, most of them too far from each other; blocks and enumeration find the same links."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(160):
        text = list(base)
        for _ in range(rng.randrange(1, 9)):
            text[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "STARS", 0)
    monkeypatch.setattr(neardup, "FEW", 2)
    monkeypatch.setattr(neardup, "BLOCK", 3000)
    got = neardup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
