import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.functions import folds
from loomgraph.functions import text as fn


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


def test_identity(spark):
    rows = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, " "), (5, "None")], "n int, k string")
    loose = {r.n: r.e for r in rows.select("n", model.entity_name("t", "n", "k").alias("e")).collect()}
    strict = {r.n: r.e for r in rows.select("n", model.entity_name("t", "n", "k", strict=True).alias("e")).collect()}
    assert loose == {1: "t:1:a", 2: None, 3: None, 4: "t:4: ", 5: "t:5:None"}
    assert strict == {1: "t:1:a", 2: None, 3: None, 4: None, 5: None}
    assert one(spark, model.entity_id(F.lit("abc"))) == "900150983cd24fb0d6963f7d28e17f72"
    assert one(spark, model.describe("a", "b"), a=1, b=None) == "a=1, b=None"


def test_nodes_of_type_time_are_not_stored_and_untyped_ones_are(spark):
    df = spark.createDataFrame([("a", "time"), ("b", None), ("c", "person")], "name string, type string")
    assert sorted(r.name for r in model.storable(df).collect()) == ["b", "c"]


def test_resource_identifiers(spark):
    r = model.Resource.parse("DBS://u1/db/table")
    assert (r.kind, r.uuid, r.path, str(r)) == ("DBS", "u1", "db/table", "DBS://u1/db/table")
    assert model.Resource("DOC", "u 2", "a/b.txt").file_name == "DOC_u_2_a_b.txt"
    df = spark.createDataFrame([("DOC://u/f.md",), ("other",)], "c string")
    assert [tuple(x) for x in df.select(*[model.uri_part("c", p) for p in ("kind", "uuid", "path")]).collect()] == [("DOC", "u", "f.md"), (None, None, None)]
    assert one(spark, model.uuid_from_path(F.lit("/x/summaries/DOC/abc/f.json"))) == "abc"
    users = spark.createDataFrame([("DBS://c/d/user",), ("DBS://c/d/users",), ("DBS://c/d/user/1",)], "c string")
    assert users.where(model.under("c", "DBS://c/d/user")).count() == 3
    assert users.where(model.under("c", "DBS://c/d/user", strict=True)).count() == 2
    assert users.where(model.under_any("c", [])).count() == 0


def test_text_functions(spark):
    assert one(spark, fn.tokens(F.lit("中文字abcd efgh"))) == int(3 / 1.5 + 9 / 4)
    assert one(spark, fn.sentences(F.lit("一。二！three\nfour"))) == ["一。", "二！", "three\n", "four"]
    assert one(spark, fn.heading_level(F.lit("### Title"))) == 3 and one(spark, fn.heading_level(F.lit("#Title"))) is None
    assert one(spark, fn.heading_title(F.lit("## A b "))) == "A b"
    assert one(spark, fn.leader_dots(F.lit("Intro ........ 5"))) == "Intro :  5"
    assert one(spark, fn.page_of_tag(F.lit("<physical_index_12>"))) == 12 and one(spark, fn.page_of_tag(F.lit("x"))) is None
    assert one(spark, fn.first_start_tag(F.lit("<start_index_3> <start_index_9>"))) == 3
    assert one(spark, fn.last_start_tag(F.lit("<start_index_3> <start_index_9>"))) == 9 and one(spark, fn.last_start_tag(F.lit(""))) == -1
    assert one(spark, fn.without_first_section(F.lit("a<physical_index_1>x<physical_index_1>b"))) == "ab"
    assert one(spark, fn.parent_code(F.lit("1.2.3"))) == "1.2" and one(spark, fn.parent_code(F.lit("1"))) is None
    assert one(spark, fn.node_number(F.lit(7))) == "00000007"
    assert one(spark, fn.page_number(F.lit("12"))) == 12 and one(spark, fn.page_number(F.lit("x"))) is None
    assert one(spark, fn.names(F.lit("Who is Ann Lee, and Bo? c"))) == ["Who", "is", "Ann", "Lee", "and"]
    assert one(spark, fn.keyword_score(F.lit("Alpha beta"), ["ALPHA", "gamma", ""])) == 0.5
    assert one(spark, fn.keyword_score(F.lit("Alpha"), ["zz", ""], keep_empty=True)) == 0.5
    chunks = one(spark, fn.fixed_chunks(F.lit("abcdefg"), 3))
    assert [(c.offset, c.chunk) for c in chunks] == [(0, "abc"), (3, "def"), (6, "g")]
    assert fn.clamp(0, 1, 5) == 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab。！\n ", max_size=200), st.integers(1, 40))
def test_split_text_keeps_everything_within_the_limit(text, most):
    parts = folds.split_text(text, most)
    assert "".join(parts) == text and all(len(p) <= most for p in parts)


def test_split_text_quirk():
    assert folds.split_text("ab。" + "c" * 9, 4) == ["ab。", "cccc", "cccc", "c"]
    assert folds.split_text("ab。" + "c" * 9, 4, repeat=True) == ["ab。", "cccc", "cccc", "c", "ab。"]


def test_merge_segments_and_page_groups():
    assert folds.merge_segments([("a", "x" * 10), ("b", "y" * 10), ("c", "z" * 50)], least=20, most=40) == [("a / b", "x" * 10 + "\n\n" + "y" * 10), ("c", "z" * 50)]
    assert folds.page_groups([10, 10, 10], 100) == [(0, 2)]
    groups = folds.page_groups([30] * 10, 100)
    assert groups[0][0] == 0 and groups[-1][1] == 9 and all(b[0] <= a[1] for a, b in zip(groups, groups[1:]))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 200))
def test_truncated_json_is_repaired(cut):
    full = {"entities": [{"n": 'A "q"', "t": "person"}, {"n": "B", "t": "x"}], "relationships": [{"s": "A", "p": "knows", "o": "B"}]}
    text = "```json\n" + json.dumps(full)
    found = folds.repair_json(text[: max(9, len(text) - cut)])
    assert found is None or isinstance(found, dict | list | str | int | float)
    if cut == 0:
        assert found == full


def test_json_helpers():
    assert folds.repair_json('{"entities": [{"n": "A"}, {"n": "B') == {"entities": [{"n": "A"}], "relationships": []}
    assert folds.repair_json('{"a": [1, 2') == {"a": [1, 2]}
    assert folds.extract_json('```json\n{"a": None, "b": [1,],}\n```') == {"a": None, "b": [1]}
    assert folds.canonical({"entity": [1], "relations": [2]}) == {"entities": [1], "relationships": [2]}
    assert folds.split_point("a" * 600 + "。" + "b" * 500) == 601
