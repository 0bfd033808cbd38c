"""Documents from files: text, markdown, and by optional libraries PDF, DOCX and images; listings; summary files."""

from __future__ import annotations

import io
import os
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fn

# Extensions by kind.
KINDS = {"text": ("txt", "md"), "pdf": ("pdf",), "docx": ("docx",), "image": ("jpg", "jpeg", "png", "bmp")}
_COLUMNS = ("path", "kind", "text", "page_count", "word_count", "char_count")


def _glob(extensions: tuple[str, ...]) -> str:
    return "*.{" + ",".join(x for e in extensions for x in (e, e.upper())) + "}"


def _shaped(df: DataFrame, kind: str) -> DataFrame:
    pages = F.col("page_count") if "page_count" in df.columns else F.lit(None)
    return df.select("path", F.lit(kind).alias("kind"), "text", pages.cast("int").alias("page_count"), fn.words("text").alias("word_count"), F.length("text").alias("char_count"))


def read_text(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Whole text and markdown files; bytes that are no UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", _glob(KINDS["text"])).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return _shaped(raw.select("path", F.decode(F.encode(F.make_valid_utf8(F.col("content").cast("string")), "UTF-8"), "UTF-8").alias("text")), "text")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("page_count", T.IntegerType())]))
def _pdf(content: pd.Series) -> pd.DataFrame:
    from pypdf import PdfReader

    out = []
    for c in content:
        pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(c)).pages]
        out.append(("\n".join(pages), len(pages)))
    return pd.DataFrame(out, columns=["text", "page_count"])


@F.pandas_udf(T.StringType())
def _docx(content: pd.Series) -> pd.Series:
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    out = []
    for c in content:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(c)).read("word/document.xml"))
        out.append("\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p")))
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def _ocr(content: pd.Series) -> pd.Series:
    import pytesseract
    from PIL import Image

    return pd.Series([pytesseract.image_to_string(Image.open(io.BytesIO(c)), lang="chi_sim") for c in content])


def _binary(spark: SparkSession, path: str, kind: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", _glob(KINDS[kind])).option("recursiveFileLookup", str(recursive).lower()).load(path)


def read_pdf(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    return _shaped(_binary(spark, path, "pdf", recursive).select("path", _pdf("content").alias("d")).select("path", "d.*"), "pdf")


def read_docx(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    return _shaped(_binary(spark, path, "docx", recursive).select("path", _docx("content").alias("text")), "docx")


def read_image(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    return _shaped(_binary(spark, path, "image", recursive).select("path", _ocr("content").alias("text")), "image")


READERS = {"text": read_text, "pdf": read_pdf, "docx": read_docx, "image": read_image}


def read_any(spark: SparkSession, path: str, recursive: bool = False, kinds: tuple[str, ...] = ("text", "docx")) -> DataFrame:
    """All documents of the named kinds under *path*: (path, kind, text, page_count, word_count, char_count)."""
    unknown = set(kinds) - set(READERS)
    if unknown:
        raise ValueError(f"unknown kinds of files: {sorted(unknown)}")
    return reduce(DataFrame.unionByName, [READERS[k](spark, path, recursive) for k in kinds])


def list_files(path: str, recursive: bool = False) -> list[str]:
    """Readable files under a local folder, sorted."""
    known = {e for v in KINDS.values() for e in v}
    walk = os.walk(path) if recursive else [(path, [], os.listdir(path))]
    return sorted(os.path.join(d, f) for d, _, names in walk for f in names if f.rsplit(".", 1)[-1].lower() in known and os.path.isfile(os.path.join(d, f)))


def browse(base: str, path: str = "") -> list[dict]:
    """Entries of a folder under *base*, folders first, names without case; a path outside *base* is refused."""
    root = os.path.realpath(base)
    at = os.path.realpath(os.path.join(root, path))
    if at != root and not at.startswith(root + os.sep):
        raise ValueError("the path leaves the base folder")
    found = [{"name": e.name, "type": "dir" if e.is_dir() else "file", "size": 0 if e.is_dir() else e.stat().st_size} for e in os.scandir(at)]
    return sorted(found, key=lambda e: (e["type"] != "dir", e["name"].lower()))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Summary files ``DOC|DBS/<uuid>/<name>.json`` of one level: (path, kind, uuid, document as VARIANT)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"/(DOC|DBS)/([^/]+)/[^/]+\.json$", 1)
    rows = raw.select("path", name.alias("kind"), F.regexp_extract("path", r"/(DOC|DBS)/([^/]+)/[^/]+\.json$", 2).alias("uuid"), F.try_parse_json(F.col("content").cast("string")).alias("document"))
    return rows.where("kind <> ''")
