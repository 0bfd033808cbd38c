import json
import threading

import pytest

from loomgraph import catalog
from loomgraph.plans import annotate, tasks


def test_tasks_run_fail_stop_and_reload(spark, tmp_path):
    gate = threading.Event()
    work = {"count": lambda s, p: s.range(p["n"]).count(), "fail": lambda s, p: 1 / 0, "wait": lambda s, p: gate.wait(20)}
    t = tasks.Tasks(spark, str(tmp_path), work)
    a, b, c = t.create("count", {"n": 5}), t.create("fail", {}), t.create("wait", {})
    assert t.wait(a)["result"] == "5" and t.wait(b)["status"] == "failed"
    t.stop(c)
    gate.set()
    assert t.wait(c)["status"] == "stopped" and t.table().count() == 3
    with pytest.raises(ValueError):
        t.create("other", {})
    t.close()
    job = json.loads((tmp_path / f"{a}.json").read_text()) | {"status": "running"}
    (tmp_path / f"{a}.json").write_text(json.dumps(job))
    again = tasks.Tasks(spark, str(tmp_path), work)
    assert again.wait(a)["result"] == "5"
    again.delete(a)
    assert again.table().count() == 2
    again.close()


def test_control_tables(spark):
    rows = spark.createDataFrame([("a", None), ("b", False), ("c", True)], "id string, is_deleted boolean")
    left = tasks.soft_delete(rows, ["a", "b"], spark.createDataFrame([("a",)], "id string"))
    assert {r.id: r.is_deleted for r in left.collect()} == {"a": True, "c": True}
    assert {r.id: r.is_deleted for r in tasks.restore(left, ["a"]).collect()} == {"a": False, "c": True}
    models = spark.createDataFrame([("m1", True, True), ("m2", False, True)], "id string, enabled boolean, available boolean")
    assert tasks.available_model(tasks.only_enabled(models, "m2")).first().id == "m2"


def test_annotations(spark):
    c = catalog.from_frames(spark, {"t": spark.createDataFrame([(1, "x")], "id int, n string"), "u": spark.createDataFrame([(1,)], "id int")}, {"t": ["id"]})
    assert "t(id int PRI, n string)" in annotate.prompt(c)
    assert annotate.run(c, None)[0] is c
    answer = '```json\n{"db": {"OV": "about", "dom": "sales"}, "tables": [{"T": "t", "d": "things", "et": "concept", "cols": [{"c": "n", "d": "name"}]}], "rels": [{"s": "t", "sc": "id", "t": "u", "tc": "id", "r": "has", "d": ""}]}'
    got, db = annotate.run(c, lambda text: answer)
    assert db == {"db_description": "about", "business_domain": "sales", "key_entities": None}
    assert {r.table_name: r.business_description for r in got.tables.collect()} == {"t": "things", "u": None}
    assert got.columns.where("column_name = 'n'").first().business_description == "name"
    assert [r.relationship_type for r in got.inferred.collect()] == ["has"]
