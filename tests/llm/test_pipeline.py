"""Each stage of the pipeline against a plain version of it, on its own input."""

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from loomgraph.llm import cotrain, rules
from loomgraph.llm.common import stage, table
from tests.llm.test_neardup import brute as components
from tests.llm.test_packing import check as check_packing
from tests.llm.test_rules import brute as measures


def by_rules(text):
    n_words, chars, symbols, dup_lines, repeated = measures(text)
    n_lines = len([x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")])
    failed = n_words < 50 or 100 * repeated > 50 * n_words or 100 * symbols > 20 * n_words or chars < 2 * n_words or chars > 20 * n_words
    return not (failed or n_lines >= 10 and 100 * dup_lines > 60 * n_lines)


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "packing"]
    outs = [docs]
    for name, f in corpus_pipeline.STAGES:
        outs.append(stage(f(spark, outs[-1], sf), name))
    rows = [sorted(map(tuple, o.collect())) for o in outs[:-1]]
    assert all(o.columns == docs.columns for o in outs[:-1])

    fitted = cotrain.train(docs, table(spark, sf, "labels"))
    good = {r.doc_id for r in cotrain.score(docs, fitted).where("kept").collect()}
    assert rows[1] == [r for r in rows[0] if r[0] in good] and 0 < len(rows[1]) < len(rows[0])
    labelled = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert all(r[0] in good for r in rows[0] if labelled.get(r[0]) == 1)
    assert rows[2] == [r for r in rows[1] if by_rules(r[1])]
    least = {d for d, _, c in components([(r[0], r[1]) for r in rows[2]]) if d == c}
    assert rows[3] == [r for r in rows[2] if r[0] in least] and len(rows[3]) < len(rows[2])
    check_packing(outs[-1].collect(), [(r[0], r[1]) for r in rows[3]], Tokenizer.from_file(P.path("word_bpe_49k.json")))


def test_stages_of_odd_rows(spark, sf):
    """Nulls, repeats, very long texts and clashing names go through every stage, row by row; and an empty table."""
    docs = table(spark, sf, "documents")
    text = docs.where("n_chars > 600 AND lang = 'en'").first().text
    long = " ".join(f"w{i}" for i in range(200_000))
    names = ["n_words", "kept", "__place", "row", "digest", "component", "score"]
    rows = [(None, None), (None, text), (None, text), (1, text), (1, text), (2, ""), (3, long), (4, long + " x"), (5, text.upper())]
    odd = spark.createDataFrame([(*r, "en", "s", 5, *["own"] * len(names)) for r in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars int", *[f"`{x}` string" for x in names]]))
    ids = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.collect())
    by_rules = corpus_pipeline.quality_rules(spark, odd, sf)
    assert by_rules.columns == odd.columns and ids(by_rules) == [-1, -1, 1, 1, 3, 4, 5]
    assert all(r[x] == "own" for r in by_rules.collect() for x in names)
    one_each = corpus_pipeline.near_duplicates(spark, odd, sf)
    assert one_each.columns == odd.columns and ids(one_each) == [-1, -1, -1, 1, 2, 3]
    good = corpus_pipeline.quality_classifier(spark, odd, sf)
    want = {r.doc_id for r in cotrain.score(odd, cotrain.train(odd, table(spark, sf, "labels"))).where("kept").collect()}
    assert good.columns == odd.columns and set(ids(good)) == {-1 if d is None else d for d in want}
    packed = corpus_pipeline.pack(spark, odd, sf)
    check_packing(packed.collect(), rows, Tokenizer.from_file(P.path("word_bpe_49k.json")))
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, odd.limit(0), sf).collect() == [], name


def test_rules_stage_takes_the_current_policy(spark, sf):
    assert rules.CURRENT in rules.POLICIES


def test_stages_of_columns_of_any_type_and_name(spark, sf):
    """Maps, arrays and binaries, and names that differ from the needed ones in case only."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, {"a": 1}, [1], b"x", "T"), (1, text, {"b": 2}, None, None, "U"), (1, text, {"a": 1}, [1], b"x", "T"), (2, text + " more", None, [], b"", None), (3, "few", {"c": 3}, [2], b"y", "V")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, a array<int>, b binary, Text string")
    one = corpus_pipeline.near_duplicates(spark, odd, sf)
    assert one.columns == odd.columns and [(r[0], r[2]) for r in sorted(one.collect(), key=lambda r: r[0])] == [(1, {"a": 1}), (3, {"c": 3})]
    passed = corpus_pipeline.quality_rules(spark, odd, sf)
    assert passed.columns == odd.columns and [r[0] for r in passed.collect()] == [1, 1, 1, 2]
    assert corpus_pipeline.quality_classifier(spark, odd, sf).columns == odd.columns
    assert corpus_pipeline.pack(spark, odd, sf).count() > 0
