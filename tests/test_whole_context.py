from pyspark.sql import functions as F

from loomgraph import more_queries
from loomgraph.operators import retrieval


def test_contexts_list_all_evidence(spark, sf):
    rows = spark.range(450).select(F.lit("document").alias("source_type"), F.concat(F.lit("d"), "id").alias("source_id"), F.create_map(F.lit("title"), F.concat(F.lit("t"), "id")).alias("content"), (F.col("id") / 1000).alias("score"))
    fused = retrieval.fuse(rows, [])
    one = retrieval.context(fused).first()
    assert len(one.document) == one.n_document == 450
    parts = retrieval.context_parts(fused, 100).orderBy("part").collect()
    assert [len(p.pieces) for p in parts] == [100, 100, 100, 100, 50]
    assert [x.summary for p in parts for x in p.pieces] == [f"t{i}" for i in range(449, -1, -1)]
    assert "least(" not in more_queries.query.__globals__["ORACLES"]["ctx_build"].replace("least(1.0", "")
