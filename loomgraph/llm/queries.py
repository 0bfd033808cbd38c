"""Queries of this subpackage: name -> function of (spark, sf_dir); oracle SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, cotrain, divergence, langid, mixing, neardup, packing, rules, sharding, toxicity, trie, warc
from .common import stage, table

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    got = warc.archive_pages(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS stored FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN stored IS NOT NULL AND page_id IS DISTINCT FROM stored THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN stored IS NOT NULL AND page_id IS DISTINCT FROM stored THEN stored END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d"""


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes that they decode to."""
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page and every document (the other kind's id is null)."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    records = langid.page_records(table(spark, sf_dir, "pages")).unionByName(langid.document_records(docs))
    return langid.identify(records, model)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule evaluated once: the stored bits and measurements of every document."""
    return stage(rules.ledger(table(spark, sf_dir, "documents")), "ledger")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger of every document with the verdict of the current policy."""
    return rules.apply_policy(_ledger(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "failed"
    )


@query
def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, alone rejects, and what the policy would keep without it; from the stored bits."""
    led = _ledger(spark, sf_dir)
    found = [rules.ablation(led, v).select(F.lit(v).alias("policy"), "*") for v in rules.POLICIES]
    return reduce(DataFrame.unionByName, found)


#: Window words as (document, place) rows; a word counts once however many repeated windows hold it.
_MEASURED = r"""d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         [x for x in regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+') if x <> ''] AS w,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^ \x09-\x0D]')] AS l
  FROM documents),
win AS (
  SELECT r, i, (w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
hit AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[ \x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)),
rule(name, bit, since) AS (VALUES ('few_words', 1, 1), ('repeated_words', 2, 1), ('many_symbols', 4, 2), ('short_words', 8, 2), ('long_words', 16, 2), ('repeated_lines', 32, 3)),
v AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 20 * n_words)::INT + 8 * (word_chars < 2 * n_words)::INT
         + 16 * (word_chars > 20 * n_words)::INT + 32 * (n_lines >= 10 AND 100 * n_dup_lines > 60 * n_lines)::INT AS BIGINT) AS failed FROM m)"""

ORACLES["op4_quality_rules"] = f"""
WITH {_MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, n_lines, failed FROM v"""

ORACLES["rules_ablation"] = f"""
WITH {_MEASURED},
policy(version, mask) AS (VALUES (1, 3), (2, 31), (3, 63))
SELECT 'v' || version AS policy, name AS rule, CAST(count(*) FILTER (failed & bit <> 0) AS BIGINT) AS n_failed,
       CAST(count(*) FILTER (failed & mask = bit) AS BIGINT) AS n_failed_alone, CAST(count(*) FILTER (failed & mask & ~bit = 0) AS BIGINT) AS n_kept_without
FROM v, policy JOIN rule ON since <= version GROUP BY ALL"""


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and verdict of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of held-out rows are never read by the fit."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each row whose id 20 divides."""
    return ann.search(table(spark, sf_dir, "embeddings"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return cotrain.score(docs, cotrain.train(docs, table(spark, sf_dir, "labels")))


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of near-equal row counts."""
    got = sharding.shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return got.select(
        "doc_id", (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of up to 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), WORDS, with_ids=False)


#: Pairs by an inverted list of shingles, components by walking the links from every document.
ORACLES["op7_near_duplicates"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+') if x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
v AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS x, doc_id AS c FROM d UNION SELECT r.x, v.b FROM reach r JOIN v ON r.c = v.a),
m AS (SELECT x AS doc_id, min(c) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m ON d.doc_id = m.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""


@query
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"), keep=("doc_id",))


#: The level by sorting sources by the words a unit of weight at which they are full, in place of rounds; draws by a running sum in place of narrowing.
ORACLES["op11_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(len([x for x in regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+') if x <> '']) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS n, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS HUGEINT) AS w FROM d GROUP BY source),
f AS (
  SELECT *, coalesce(sum(2 * n) OVER before, 0) AS full_before, coalesce(sum(w) OVER before, 0) AS w_before, sum(n) OVER () AS n_all, sum(w) OVER () AS w_all,
         row_number() OVER (ORDER BY 2 * n * (6 // w), source NULLS LAST) AS place
  FROM s WINDOW before AS (ORDER BY 2 * n * (6 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT place, 3 * n_all - 2 * full_before AS num, 2 * (w_all - w_before) AS den FROM f WHERE (3 * n_all - 2 * full_before) * w <= 2 * n * 2 * (w_all - w_before)
  ORDER BY place LIMIT 1),
t AS (
  SELECT source, n, CASE WHEN f.place < level.place THEN CAST(2 * n AS DOUBLE) ELSE CAST(num * w AS DOUBLE) / CAST(den AS DOUBLE) END AS target,
         CASE WHEN f.place < level.place THEN 2 * n ELSE (2 * num * w + den) // (2 * den) END AS quota FROM f, level),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM d)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
       CAST(CASE WHEN n > 0 THEN (quota // n) * size + greatest(0, least(size, quota % n - seen)) ELSE 0 END AS BIGINT) AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source"""


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set each source apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


#: Long form: one row a (group, term) in place of arrays.
ORACLES["op13_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, CAST(coalesce(n, 0) AS HUGEINT) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM dense JOIN v USING (lang)),
whole AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM whole JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (FROM pair UNION ALL FROM own))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return trie.trie(table(spark, sf_dir, "conversations"))


#: Prefixes as lists, ancestors by cutting them; crc32 bit by bit.
ORACLES["op12_prefix_trie"] = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         (coalesce(role, ''), coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(said ORDER BY i) AS own FROM t GROUP BY 1),
c AS (
  SELECT conv_id, own, (xor(list_reduce(list_prepend(4294967295::UBIGINT, [ascii(x)::UBIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 4)::INT AS h FROM o),
m AS (SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:h], c.own[h + 1:]) AS said FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, d, said[1:d] AS path, len(said) = d AS ends FROM (SELECT *, unnest(range(0, len(said) + 1)) AS d FROM m)),
n AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(ends) AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
s AS (SELECT *, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len([x FOR x IN regexp_split_to_array(path[d][2], '[ \\x09-\\x0D]+') IF x <> '']) END AS saved FROM n),
up AS (SELECT path[1:k] AS path, k AS d, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved, count(*) FILTER (d = k + 1) AS n_children FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM s) GROUP BY 1, 2)
SELECT s.conv_id, s.d::BIGINT AS depth, q.conv_id AS parent_conv_id, s.n_convs, n_children, n_leaves, up.saved::BIGINT AS saved_tokens, s.ends_sha256
FROM s JOIN up ON s.path = up.path AND s.d = up.d LEFT JOIN s q ON s.d > 0 AND q.d = s.d - 1 AND q.path = s.path[1:s.d - 1]"""
