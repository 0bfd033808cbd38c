import hashlib

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import warc


def expected(rows):
    best = {}
    for p, _, h in rows:
        body = (h or "").encode()
        if len(body) >= 1000 and p is not None:
            best[body] = max(p, best.get(body, p))
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        kept = best.get(body)
        revisit = kept is not None and p != kept
        out.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", kept if revisit else None))
    return sorted(out, key=str)


def rows():
    big, other = "é" * 600, "x\r\n\r\nWARC/1.1\r\n" * 90
    return [
        (1, "http://a/", big), (5, "http://b/", big), (3, None, big), (7, "http://c/\nX: 1", other), (8, "http://d/", other + "y"), (9, "u", "small"), (10, "u", "small"),
        (11, "u", None), (12, "u", ""), (13, "u", "a" * 999), (14, "u", "a" * 999), (15, "u", "\x00\x01" * 800), (None, "u", "n" * 2000), (None, "u", "n" * 2000), (20, "u", "n" * 2000),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression):
    path = f"file://{tmp_path}/w"
    warc.write_pages(frame(spark, rows()), path, compression)
    back = warc.read_pages(spark, path)
    assert got(back) == expected(rows())
    bodies = {r.page_id: bytes(r.payload) for r in back.where("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert bodies[7] == rows()[3][2].encode() and bodies[11] == b""
    assert got(warc.read_pages(spark, path, payload=False)) == expected(rows())
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.startswith("_temp")]


def test_query_form_and_empty_table(spark):
    assert got(warc.archive_pages(frame(spark, rows()))) == expected(rows())
    assert warc.archive_pages(frame(spark, rows()).limit(0)).collect() == []


def test_predicates_are_pushed_and_blocks_skipped(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_pages(frame(spark, rows()), path)
    df = spark.read.format("warc").load(path).where((F.col("record_type") == "response") & (F.col("target_uri") == "http://a/"))
    assert df.count() == 0
    df = spark.read.format("warc").load(path).where((F.col("record_type") == "revisit") & F.col("target_uri").isin("http://a/", "no"))
    assert [r.record_id for r in df.collect()] == ["<urn:page:1>"]
    reader = warc.WarcReader({"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload_bytes",), 5)]))
    assert len(left) == 1 and reader.wanted == {"record_type": {"response"}}
    assert len({r[1] for p in reader.partitions() for r in reader.read(p)}) == 11
    assert spark.read.format("warc").option("record_type", "warcinfo").load(path).count() >= 1


def test_files_roll_and_partitions_follow(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.register(spark)
    warc.page_records(frame(spark, rows())).write.format("warc").option("max_file_bytes", "2000").mode("append").save(path)
    assert len(list((tmp_path / "w").iterdir())) > 4
    reader = warc.WarcReader({"path": path, "max_partition_bytes": "4000"})
    assert len(reader.partitions()) > 2
    assert warc.base32_digest("00" * 20).startswith("sha1:AAAA")
