import random
import re

from loomgraph.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in grams.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in rules.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_measurements_match_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "a", "a b", "a b c", "a a a a", "a a a", "x\ny\nx\n\n", "\x0b\x0ca\x1cb c d", "#* | <x>", "a b c a b c a b c", "😀 é"]
    texts += ["".join(rng.choice(["a", "b", "ab", " ", "  ", "\n", "\t", "#"]) for _ in range(rng.randrange(400))) for _ in range(60)]
    texts.append(" ".join(rng.choice("abcdefgh") for _ in range(50_000)))
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(0, None, 1), (None, "a b", 2)]
    got = rules.ledger(spark.createDataFrame(rows, "doc_id long, text string, failed long")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(
        (i if i is not None else -1, *brute(t)) for i, t, _ in rows
    )


def test_policies_and_ablation_are_bit_operations(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good), (2, "few words"), (3, " ".join(f"word{i}###" for i in range(80))), (4, "same old line " * 60), (5, "# # #")]
    led = rules.ledger(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    v1 = {r.doc_id: r.kept for r in rules.apply_policy(led, "v1").collect()}
    v3 = {r.doc_id: (r.base_failed, r.kept) for r in rules.apply_policy(led).collect()}
    assert v1 == {1: True, 2: False, 3: True, 4: False, 5: False}
    assert v3 == {1: (False, True), 2: (True, False), 3: (False, False), 4: (True, False), 5: (True, False)}
    found = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in rules.ablation(led).collect()}
    assert found["few_words"] == (2, 1, 2)
    assert found["many_symbols"] == (2, 1, 2)
    assert found["short_words"] == (1, 0, 1)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rules.apply_policy(rules.ledger(empty)).collect() == []


def test_filters_stay_above_the_measurements(spark):
    docs = spark.createDataFrame([(i, "some words here " * i) for i in range(50)], "doc_id long, text string")
    kept = rules.apply_policy(rules.ledger(docs, keep=("doc_id", "text"))).where("kept AND n_repeat_words >= 0")
    assert kept.select("doc_id", "text").count() == 0


def test_rows_keep_their_columns(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text, 5, "a", True, None), (None, text, 5, "a", True, None), (1, None, 1, "b", None, 2), (1, text, 9, None, False, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, row string, kept boolean, `__w` int")
    got = rules.keep_passing(docs)
    assert got.columns == docs.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows[:2] + rows[3:]))
