"""WARC archives as a PySpark Python data source, ``format("warc")``, for reading and writing.

Reading plans one partition for each run of files of about ``max_partition_bytes``. Record headers are
parsed first; a record that the pushed predicates (``record_type`` and equalities on header columns) exclude
is skipped by seeking over its block, and with ``payload=false`` no block is read unless it is a revisit's short
HTTP head. Writing rolls files at ``max_file_bytes``; each task writes under a temporary name and the
commit moves only the files of the attempts that succeeded, so a lost executor leaves no half archive.

Files are reached through ``pyarrow.fs``, hence on local disks and on the stores that it knows.
Files end in ``.warc``, or in ``.warc.gz`` with one gzip member a record.
"""

from __future__ import annotations

import base64
import gzip
import io
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import new_path, stage

#: Column, WARC header.
HEADERS = [
    ("record_type", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("date", "WARC-Date"), ("target_uri", "WARC-Target-URI"),
    ("payload_digest", "WARC-Payload-Digest"), ("refers_to", "WARC-Refers-To"), ("content_type", "Content-Type"),
]
SCHEMA = ", ".join(f"{c} string" for c, _ in HEADERS) + ", payload_bytes long, payload binary"
_HTTP = "application/http; msgtype=response"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class WarcPartition(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.most = int(options.get("max_partition_bytes", 128 << 20))
        self.payload = options.get("payload", "true").lower() == "true"
        self.wanted: dict[str, set] = {}
        if "record_type" in options:
            self.wanted["record_type"] = set(options["record_type"].split(","))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        names = {c for c, _ in HEADERS}
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column not in names:
                yield f
                continue
            allowed = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[column] = self.wanted[column] & allowed if column in self.wanted else allowed

    def partitions(self) -> list[WarcPartition]:
        store, root = _filesystem(self.path)
        found = [f for f in store.get_file_info(pafs.FileSelector(root, recursive=False)) if f.is_file and f.path.endswith((".warc", ".warc.gz"))]
        out, held = [], 0
        for f in sorted(found, key=lambda f: f.path):
            if not out or held + f.size > self.most:
                out.append(WarcPartition([]))
                held = 0
            out[-1].files.append(f.path)
            held += f.size
        return out or [WarcPartition([])]

    def read(self, partition: WarcPartition) -> Iterator[tuple]:
        store, _ = _filesystem(self.path)
        for path in partition.files:
            with store.open_input_file(path) as raw:
                packed = path.endswith(".gz")
                with gzip.GzipFile(fileobj=raw) if packed else raw as f:
                    yield from self.records(io.BufferedReader(f, 1 << 17))

    def records(self, f) -> Iterator[tuple]:
        for headers, length in _heads(f):
            row = [headers.get(name.lower()) for _, name in HEADERS]
            if any(headers.get(dict(HEADERS)[c].lower()) not in allowed for c, allowed in self.wanted.items()):
                f.seek(length + 4, 1)
                continue
            revisit = headers.get("warc-type") == "revisit"
            http = (headers.get("content-type") or "").startswith("application/http")
            if not self.payload and not revisit and not http:
                f.seek(length + 4, 1)
                yield (*row, length, None)
                continue
            if not self.payload and not revisit:  # the HTTP head gives the length of the body
                head = f.read(min(length, 1 << 13))
                cut = head.find(b"\r\n\r\n")
                if cut >= 0:
                    f.seek(length - len(head) + 4, 1)
                    yield (*row, length - cut - 4, None)
                    continue
                block = head + f.read(length - len(head))
            else:
                block = f.read(length)
            f.seek(4, 1)
            if http:
                head, _, body = block.partition(b"\r\n\r\n")
            else:
                head, body = b"", block
            size = len(body)
            if revisit:
                size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
            yield (*row, size, body if self.payload and not revisit else None)


def _heads(f) -> Iterator[tuple[dict[str, str], int]]:
    """The headers of each record and the length of its block, which the caller reads or skips."""
    while True:
        line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            if not line.strip():
                continue
            raise ValueError(f"not at the start of a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        for raw in iter(f.readline, b""):
            if not raw.strip():
                break
            name, _, value = raw.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, int(headers.get("content-length", 0))


class _Files(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of (record_type, record_id, target_uri, payload_digest, refers_to, payload_bytes, payload)."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.most = int(options.get("max_file_bytes", 1 << 30))
        self.packed = options.get("compression", "none") == "gzip"
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.temp = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        store, root = _filesystem(self.path)
        store.create_dir(f"{root}/{self.temp}", recursive=True)
        attempt, files, out, size = uuid.uuid4().hex, [], None, 0
        ending = ".warc.gz" if self.packed else ".warc"
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.most:
                    if out is not None:
                        out.close()
                    name = f"{self.temp}/part-{attempt}-{len(files):05d}{ending}"
                    out, size = store.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20), 0
                    files.append(name)
                    size += self._put(out, self._info(name))
                size += self._put(out, self.record(row))
        if out is not None:
            out.close()
        return _Files(files)

    def _put(self, out, data: bytes) -> int:
        data = gzip.compress(data, 1) if self.packed else data
        out.write(data)
        return len(data)

    def _info(self, name: str) -> bytes:
        block = b"software: loomgraph\r\nformat: WARC File Format 1.1\r\n"
        return _bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], block)

    def record(self, row: dict) -> bytes:
        body, revisit = row["payload"] or b"", row["record_type"] == "revisit"
        size = row.get("payload_bytes")
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body) if size is None else size}\r\n\r\n".encode()
        headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", self.date), ("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", row["payload_digest"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Profile", _PROFILE if revisit else None), ("Content-Type", _HTTP)]
        return _bytes(headers, head if revisit else head + body)

    def commit(self, messages: list[_Files | None]) -> None:
        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(pafs.FileSelector(root, recursive=False)):
                if f.is_file:
                    store.delete_file(f.path)
        for m in messages:
            for name in m.files if m else []:
                store.move(f"{root}/{name}", f"{root}/{name.split('/')[1]}")
        self.abort(messages)

    def abort(self, messages: list[_Files | None]) -> None:
        store, root = _filesystem(self.path)
        if store.get_file_info(f"{root}/{self.temp}").type == pafs.FileType.Directory:
            store.delete_dir(f"{root}/{self.temp}")


def _bytes(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {_line(v)}\r\n" for k, v in headers if v is not None]
    return f"WARC/1.1\r\n{''.join(lines)}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _line(value: str) -> str:
    """Control characters would end a header; they are percent-encoded."""
    return value if value.isprintable() else "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


#: Payloads from this size on are stored once.
LEAST_SHARED = 1000


def page_records(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Archive rows of ``pages`` (page_id, url, html), equal payloads of *least* bytes or more stored once.

    Of such equal payloads the one of the largest page_id is the response, the rest revisit it; rows that
    repeat that page_id are responses too. A null html is an empty payload; a null page_id has the record
    id ``<urn:page:null>`` and never stands for others; a null url is left out; columns other than these three are
    ignored; an empty table gives no records.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long")})
    large = rows.where(F.col("payload_bytes") >= least)
    # Only digests that occur again go on; the join broadcasts them if their files are small enough.
    shared = stage(large.groupBy("digest").agg(F.max("page_id").alias("stored"), F.count(F.lit(1)).alias("n")).where("n > 1 AND stored IS NOT NULL").select("digest", "stored"), "digests")
    rows = rows.join(shared, "digest", "left")
    revisit = F.col("stored").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"), F.when(revisit, urn(F.col("stored"))).alias("refers_to"),
        "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, compression: str = "none") -> None:
    register(pages.sparkSession)
    page_records(pages).write.format("warc").option("compression", compression).mode("append").save(path)


def read_pages(spark, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive with their page ids; digests of responses are taken from the payloads read."""
    register(spark)
    got = spark.read.format("warc").option("payload", str(payload).lower()).load(path).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    stored = F.substring("payload_digest", 6, 64)
    return got.select(
        as_id(F.col("record_id")).alias("page_id"), "target_uri", "record_type", as_id(F.col("refers_to")).alias("refers_to"), "payload_bytes",
        F.coalesce(F.sha1("payload"), stored).alias("payload_digest"), "payload",
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write *pages* to archives in the shared folder and read those back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_pages(pages, path)
    return read_pages(spark, path)


def base32_digest(hex_digest: str) -> str:
    """The base-32 spelling of a digest that some archives use."""
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()
