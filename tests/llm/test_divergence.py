import random
import re
from collections import Counter
from itertools import product

from loomgraph.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(docs, least=10):
    docs = [(d, t or "", g or "", s or "") for d, t, g, s in docs]
    out = []
    for lang in {g for _, _, g, _ in docs}:
        counts, seen = {s: Counter() for _, _, g, s in docs if g == lang}, Counter()
        for _, text, g, s in docs:
            if g == lang:
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
                found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
                counts[s].update(found)
                seen.update(set(found))
        kept = [t for t, n in seen.items() if n >= least]
        v = len(kept)

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, top in (("pair", pairs, len(pairs)), ("term", terms, 10)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "The", "THE", "été", "É", "日本", "a1b", "x_y", "don't", "\x00z", "\x7f", "😀"] + [f"w{c}" for c in "abcdefghij"]
    cases = product(["en", "de", None, "", "one"], ["s1", "s2", "é", "z", None])
    groups = [x for x in cases if x[0] != "one" or x[1] == "s1"]
    docs = [(i, rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(40)))]), *rng.choice(groups)) for i in range(400)]
    docs += [(1, "rare", "xx", "a"), (2, "rare", "xx", "b"), (2, "rare", "xx", "b"), (3, None, "en", "silent"), (4, "The é " * 30_000, "en", "long")]
    got = divergence.audit(spark.createDataFrame(docs, SCHEMA))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs))


def test_large_counts_stay_exact(spark):
    vectors = spark.createDataFrame([("en", "a", [10**13 + 7, 3]), ("en", "b", [5, 9_000_000_001])], "lang string, term string, counts array<long>")
    langs = spark.createDataFrame([("en", ["x", "y"], 2)], "lang string, sources array<string>, n_sources int")
    for r in divergence.shares(vectors, langs).collect():
        ns, v = [10**13 + 12, 9_000_000_004], 2
        assert r.p == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n in zip(r.counts, ns)]
        assert r.q == 1 + 10**9 * (sum(r.counts) + 2) // (sum(ns) + 2 * v)


def test_empty_tables_and_names_that_clash(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = [(i, "some word", "en", s, "no", 1, "x") for i in range(12) for s in ("a", "b")]
    got = divergence.audit(spark.createDataFrame(docs, SCHEMA + ", Text string, n int, term string")).collect()
    assert sorted(map(tuple, got)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
