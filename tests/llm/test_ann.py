import numpy as np
import pytest

from loomgraph.llm import ann

DDL = "vec_id long, embedding array<float>, label int"


def answer(df, **options):
    out = {}
    for r in sorted(ann.search(df, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in zip(ids, vectors)], DDL)


def test_a_large_budget_gives_the_exact_answer(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype(np.float32).astype(float)
    got = answer(frame(spark, x), budget=10**6)
    want = ann.brute_force(np.arange(300), x)
    assert {q: [v for _, v, _ in rows] for q, rows in got.items()} == want
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert all(s == pytest.approx(float((x[q] * x[v]).sum()), abs=1e-12) for _, v, s in rows)


def recall(got, want):
    return np.mean([len({v for _, v, _ in got[q]} & set(want[q])) / len(want[q]) for q in want])


def test_recall_of_the_forest(spark):
    """With clusters, by a given budget of 1 600 visits in 4 trees of 6000 vectors each, and by the budget that the data ask for."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(40, size=6000)] + 0.3 * rng.normal(size=(6000, 32))).astype(np.float32).astype(float)
    x *= rng.uniform(0.8, 1.2, size=(6000, 1))
    want = ann.brute_force(np.arange(6000), x)
    assert recall(answer(frame(spark, x), budget=1600), want) >= 0.9
    assert recall(answer(frame(spark, x)), want) >= 0.9


def test_the_query_against_brute_force(spark):
    """The registered query on a whole table: every list is complete, scores are exact, recall is what the budget was set by."""
    from loomgraph.llm import queries

    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = table.vec_id.to_numpy(), np.array(table.embedding.tolist(), np.float32).astype(float)
    at = {int(v): k for k, v in enumerate(ids)}
    got = {}
    for r in sorted(queries.op6_nearest_neighbours(spark, sf).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = ann.brute_force(ids, x)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21)) and q not in {v for _, v, _ in rows}
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        assert all(s == (x[at[q]] * x[at[v]]).cumsum()[-1] for _, v, s in rows)


def test_leaves_keep_their_size(monkeypatch):
    """While the sample is a share of the table, the largest leaf of 200 000 vectors is no larger than that of 20 000."""
    monkeypatch.setattr(ann, "SAMPLE", 1000)
    largest = []
    for n in (20_000, 200_000):
        x = np.random.default_rng(9).normal(size=(n, 8))
        tree = ann.grow(x[: ann.sample_size(n, 8)], np.random.default_rng(1))
        largest.append(np.bincount(ann.leaf_of(tree, x)).max())
    assert max(largest) <= 4 * ann.NODE * ann.SHARE and largest[1] <= 1.5 * largest[0]
    assert [ann.sample_size(n, 64) for n in (0, 10_000, 10**6, 10**12)] == [1000, 2500, 250_000, 262_144] and ann.sample_size(10**12, 10**6) == 1000


def test_a_cell_is_searched_exactly():
    """Ties of quantised vectors included, against a plain search of the leaves that each query takes."""
    rng = np.random.default_rng(7)
    x, q = rng.integers(-1, 2, size=(500, 6)).astype(float), rng.integers(-1, 2, size=(40, 6)).astype(float)
    leaf, least = rng.integers(0, 9, size=500), rng.permutation(500)
    taken = [rng.choice(9, size=rng.integers(1, 9), replace=False) for _ in q]
    at, hit, score = ann.search_cell(q, taken, x, leaf, least, 5)
    for i in range(40):
        inside = np.flatnonzero(np.isin(leaf, taken[i]))
        s = x[inside] @ q[i]
        order = np.lexsort((least[inside], -s))[:5]
        assert hit[at == i].tolist() == inside[order].tolist() and score[at == i].tolist() == s[order].tolist()


def test_copies_nulls_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [[1.0, 0.0]] * 60 + [[0.0, 1.0], [0.5, 0.5], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 2.0, 3.0], []]
    got = answer(frame(spark, v), budget=100)
    assert set(got) == {0, 20, 40, 60}
    # the longer vector counts against the others by the components that they have
    assert [x for _, x, _ in got[0]] == list(range(1, 21)) and [x for _, x, _ in got[20]] == [*range(20)]
    assert [x for _, x, _ in got[60]] == [67, 61, *range(18)]
    twice = spark.createDataFrame([(0, [1.0], 0), (0, [1.0], 1), (1, [2.0], 0), (None, [1.0], 0)], DDL)
    assert [x for _, x, _ in answer(twice)[0]] == [1]
    assert ann.search(twice.limit(0)).collect() == []


def test_cells_of_many_vectors_and_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 16)
    monkeypatch.setattr(ann, "QUERIES", 3)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).astype(np.float32).astype(float)
    got = answer(frame(spark, x), trees=2, sample=150, budget=10_000)
    assert {q: [v for _, v, _ in r] for q, r in got.items()} == ann.brute_force(np.arange(400), x)


def test_cells_hold_what_they_should():
    sizes = [np.array([5, 9, 0, 40, 3, 3]), np.array([100, 1])]
    original, ann.CELL = ann.CELL, 16
    try:
        cells = ann.Cells(sizes)
    finally:
        ann.CELL = original
    assert cells.first[0].tolist() == [0, 0, 0, 1, 4, 4] and cells.parts[0].tolist() == [1, 1, 1, 3, 1, 1]
    assert cells.first[1].tolist() == [5, 12] and cells.parts[1].tolist() == [7, 1]
