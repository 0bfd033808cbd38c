"""Language identification by fusing evidence the Bayesian way.

For each record and language the posterior is proportional to

    P(text | language)^t  x  P(declared language | language)  x  P(address suffix | language)  x  P(language | host)

- text: a byte-trigram model of every language code that any document has, counted over all documents of known language;
  a trigram's share is drawn to its share in all languages by the same weight, so that what no language knows speaks for none; t is a
  third, as each byte of a text lies in three trigrams;
- declared markup language and address suffix: how often they go with each language, from the texts of all records;
- host: shares smoothed by those of its domain, which are smoothed by those of all records; a record's own
  contribution is taken out of its host's counts.

All four are grouped aggregations. What is known of a host, its domain and its suffix is put together once a host; records meet it in a join by host, in
which the hosts with a thousandth of all records or more, at most a thousand, are broadcast, so that no other key is large. The model has 256 KB a language. Defined results: a null or empty text, a missing declaration, address or
host is no evidence and counts as 1; repeated rows count as often as they occur; null ids are kept; an empty table gives no
rows; without labelled documents the language is null and the confidence 0; columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage

BUCKETS = 1 << 16
#: Languages whose counts a task holds before it passes them on.
HELD = 64
#: Weight of a trigram's share in all languages.
SHARED = 0.05
#: Weight of a trigram's log-likelihood.
TEMPER = 1 / 3
#: A host with this share of all records is joined by broadcast.
HOT = 1000
#: Pseudo-counts of the aggregated evidence and of a host's and a domain's prior.
SMOOTH, PRIOR_WEIGHT = 1.0, 5.0

_DROP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
_HTML_LANG = r"(?i)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,3})\b"
_META_LANG = r"(?i)<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?\s*([a-z]{2,3})\b"


def visible(html: str | None) -> str:
    """The text of a page without markup, scripts, styles and comments."""
    return _DROP.sub(" ", html or "")


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Byte-trigram buckets of lower-cased texts, a blank before and after each, and how many each text has."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw) + b"  ", np.uint8).astype(np.uint32)
    h = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    return np.delete(h, np.concatenate([ends - 2, ends - 1])), sizes - 2  # without those that reach into the next text


def sums_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of *values* of the given sizes, which may be 0."""
    out = np.zeros(len(sizes))
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full], dtype=float)
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def passed() -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            b = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b)), pa.array(b.astype(np.int32)), pa.array(n[b])], names=["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            if lang not in held:
                if len(held) >= HELD:
                    yield from passed()
                held[lang] = np.zeros(BUCKETS, np.int64)
            for at in range(0, len(own), 64):
                held[lang] += np.bincount(buckets(own[at : at + 64])[0], minlength=BUCKETS)
    yield from passed()


def train(docs: DataFrame) -> tuple[list[str], np.ndarray] | None:
    """Language codes and their log-probabilities by bucket (buckets x languages)."""
    code = F.lower(F.regexp_extract(F.coalesce("lang", F.lit("")), r"^\s*([A-Za-z]{2,3})\b", 1))
    known = docs.select(code.alias("lang"), "text").where("lang <> '' AND text IS NOT NULL AND text <> ''")
    table = known.mapInArrow(_count_batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most codes x BUCKETS
    if not len(table):
        return None
    names = sorted(table.lang.unique())
    counts = np.zeros((BUCKETS, len(names)), np.float32)
    counts[table.bucket.to_numpy(), table.lang.map({x: k for k, x in enumerate(names)}).to_numpy()] = table.n.to_numpy()
    every = counts.sum(axis=1, dtype=float) + 0.5
    counts *= ((1 - SHARED) / counts.sum(axis=0, dtype=float)).astype(np.float32)
    counts += (SHARED * every / every.sum()).astype(np.float32)[:, None]
    return names, np.log(counts, out=counts)


def page_records(pages: DataFrame) -> DataFrame:
    """``page_id``, ``body``, ``is_html``, ``declared``, ``host`` of web pages."""
    part = lambda p: F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), p, 1))
    declared = F.when(part(_HTML_LANG) != "", part(_HTML_LANG)).when(part(_META_LANG) != "", part(_META_LANG))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.col("html").alias("body"), F.lit(True).alias("is_html"), declared.alias("declared"), F.when(host != "", host).alias("host"))


def document_records(docs: DataFrame) -> DataFrame:
    """The same of plain documents: their source is their host, and nothing declares a language."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text").alias("body"), F.lit(False).alias("is_html"), F.lit(None).cast("string").alias("declared"), F.lower("source").alias("host"))


def identify(records: DataFrame, model: tuple[list[str], np.ndarray] | None) -> DataFrame:
    """``doc_id``, ``page_id``, ``lang``, ``confidence`` and what spoke for it, for every record."""
    ids = ["doc_id", "page_id"]
    if model is None:
        return records.select(*ids, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    names, logp = model
    shared = records.sparkSession.sparkContext.broadcast(logp)  # BUCKETS x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [visible(t) if web else t or "" for t, web in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                h, sizes = buckets([t if t.strip() else "" for t in texts])
                ll = TEMPER * np.stack([sums_of(table[:, k][h], sizes) for k in range(len(names))], 1)
                ll -= ll.max(axis=1, keepdims=True)
                post = np.exp(ll)
                post /= post.sum(axis=1, keepdims=True)
                post[sizes == 0] = 0.0  # says nothing of its host either
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *part.columns[4:6], pa.array(list(ll.astype(float)), pa.list_(pa.float64())), pa.array(list(post.astype(float)), pa.list_(pa.float64()))], names=["doc_id", "page_id", "declared", "host", "ll", "post"])

    ddl = "doc_id long, page_id long, declared string, host string, ll array<double>, post array<double>"
    rows = stage(records.select("doc_id", "page_id", "body", "is_html", "declared", "host").mapInArrow(run, ddl), "evidence")
    n = len(names)
    sums = [F.sum(F.col("post")[k]).alias(f"s{k}") for k in range(n)]
    again = [F.sum(f"s{k}").alias(f"s{k}") for k in range(n)]
    value = F.array(*[F.col(f"s{k}") for k in range(n)])

    total = rows.agg(*sums, F.count(F.lit(1)).alias("rows")).first()
    world = [float(total[k] or 0) + SMOOTH for k in range(n)]
    share = F.array(*[F.lit(x / sum(world)) for x in world])
    whole = F.array(*[F.lit(x) for x in world])

    def likelihood(seen: DataFrame, column: str) -> DataFrame:
        """log P(value | language), with the value's overall share as pseudo-count."""
        own = F.aggregate(value, F.lit(0.0), lambda a, x: a + x) / F.lit(sum(world))
        return seen.where(F.col(column).isNotNull()).select(column, F.zip_with(value, whole, lambda x, w: F.log((x + SMOOTH * own + 1e-9) / (w + SMOOTH))).alias(f"__{column}"))

    suffix = F.regexp_extract("host", r"\.([a-z]{2,})$", 1)
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    hosts = rows.where("host IS NOT NULL").groupBy("host").agg(*sums, F.count(F.lit(1)).alias("records"))
    hosts = stage(hosts.withColumns({"suffix": F.when(suffix != "", suffix), "domain": F.when(domain != "", domain)}), "hosts")
    domains = hosts.where("domain IS NOT NULL").groupBy("domain").agg(*again).select("domain", value.alias("__d"))
    facts = hosts.select("host", "suffix", "domain", "records", value.alias("__h"))
    facts = facts.join(likelihood(hosts.groupBy("suffix").agg(*again), "suffix"), "suffix", "left").join(domains, "domain", "left")
    facts = stage(facts.select("host", "records", "__h", "__d", "__suffix"), "facts")
    drop_staged(hosts)

    declared = likelihood(rows.groupBy("declared").agg(*sums), "declared")  # codes of two or three letters
    rows = rows.join(F.broadcast(declared), "declared", "left")
    hot = F.col("records") >= F.lit((total.rows or 0) / HOT)
    met = rows.join(F.broadcast(facts.where(hot)), "host", "left")  # at most HOT rows
    known = F.col("records").isNotNull() | F.col("host").isNull()
    fused = met.where(known).unionByName(met.where(~known).drop("records", "__h", "__d", "__suffix").join(facts.where(~hot), "host", "left"))
    zero = F.array(*[F.lit(0.0)] * n)

    def smoothed(counts: Column, prior: Column) -> Column:
        """Shares without this record's own part, drawn to *prior*; *prior* itself where nothing else is counted."""
        left = F.zip_with(counts, F.col("post"), lambda c, p: F.greatest(c - p, F.lit(0.0)))
        size = F.aggregate(left, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(left, prior, lambda c, q: (c + PRIOR_WEIGHT * q) / (size + PRIOR_WEIGHT))

    fused = fused.withColumn("__dp", F.when(F.col("__d").isNotNull(), smoothed(F.col("__d"), share)).otherwise(share))
    fused = fused.withColumn("__hp", F.when(F.col("__h").isNotNull(), smoothed(F.col("__h"), F.col("__dp"))).otherwise(F.col("__dp")))
    logit = F.zip_with("ll", F.coalesce("__declared", zero), lambda a, b: a + b)
    logit = F.zip_with(logit, F.coalesce("__suffix", zero), lambda a, b: a + b)
    logit = F.zip_with(logit, "__hp", lambda a, b: a + F.log(b))
    fused = fused.withColumn("__z", logit)
    code = F.array(*[F.lit(x) for x in names])
    best = F.array_max("__z")
    pick = lambda scores, top: F.element_at(code, F.array_position(scores, top).cast("int"))
    spread = F.aggregate("__z", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    text_says = F.when(F.array_max("post") > 0, pick(F.col("post"), F.array_max("post")))
    return fused.select(*ids, pick(F.col("__z"), best).alias("lang"), (1 / spread).alias("confidence"), text_says.alias("text_lang"), "declared", "host")
