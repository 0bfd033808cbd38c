"""Source divergence audit by wide term vectors: how far the sources of a language are apart, and by which terms.

1. Terms are counted by (language, source, term), summed up inside every input partition before anything moves, with the documents that have each.
2. The terms that enough documents of a language have are pivoted: one row a term with an array of counts, one place a source.
3. Higher-order functions turn a row's counts into smoothed shares and emit what every pair of sources gets from the term;
   sums over (language, pair) meet inside every partition first, so the exchange holds one number a pair and partition.
4. The terms that set a source apart are ranked with a limit that Spark applies before the exchange.

All arithmetic is on whole numbers. A share is 1 + floor(10^9 (count + 2) / (N + 2 V)), a contribution floor((p - q)^2 / (p + q)).

Defined results: null text, language and source count as empty strings; a source without terms takes part with counts of 0; a language
without kept terms has pairs of value 0; a language with one source has none; equal values rank by the item's bytes; repeated rows are documents of
their own; an empty table gives no rows; other columns are ignored whatever their names. A long text is split into its terms in one row.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, stage

#: What separates terms: ASCII but the letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term is in at least, and terms told for each source.
LEAST_DOCS, TOP = 10, 10


def terms(text: Column) -> Column:
    """Terms of a text in order, A-Z lower-cased; ``lower`` is quicker and the same where all characters are ASCII."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.array_remove(F.split(low, BETWEEN), "")


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term): occurrences ``n`` and documents ``docs``."""
    found = docs.select("lang", "source", terms(F.col("text")).alias("all"))
    both = F.array(F.struct(F.col("all").alias("terms"), F.lit(0).alias("once")), F.struct(F.array_distinct("all").alias("terms"), F.lit(1).alias("once")))
    rows = found.select("lang", "source", F.explode(both).alias("b")).select("lang", "source", "b.once", F.explode("b.terms").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.sum(F.lit(1) - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def term_vectors(counts: DataFrame, groups: DataFrame, langs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, counts): the kept terms with one count a source, in the order of the sources."""
    cells = counts.join(groups, ["lang", "source"])
    wide = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("cells")).where(F.col("docs") >= least)
    filled = """flatten(concat(
        transform(cells, (x, k) -> array_append(array_repeat(0L, x.at - coalesce(get(cells, k - 1).at, -1) - 1), x.n)),
        array(array_repeat(0L, n_sources - 1 - element_at(cells, -1).at))))"""
    return wide.join(langs.select("lang", "n_sources"), "lang").select("lang", "term", F.expr(filled).alias("counts"))


def _share(count: str, n: str) -> str:
    """Exact in 64 bits while 10^9 (count + 2) is, else in decimals."""
    exact = f"CAST(1000000000 AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(19,0)) div CAST({n} + 2 * v AS DECIMAL(19,0))"
    return f"1 + if({count} < 9000000000, (1000000000 * ({count} + 2)) div ({n} + 2 * v), {exact})"


def shares(vectors: DataFrame, langs: DataFrame) -> DataFrame:
    """The vectors with the shares ``p`` of every source and ``q`` of the language."""
    sums = vectors.select("lang", F.posexplode("counts").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    totals = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("ns"), F.sum("n").alias("n_lang"), F.max("v").alias("v"))
    known = stage(totals, "term-totals")
    return vectors.join(known, "lang").select(
        "lang", "term", "counts", F.expr(f"zip_with(counts, ns, (c, n) -> {_share('c', 'n')})").alias("p"),
        F.expr("aggregate(counts, 0L, (a, c) -> a + c)").alias("c"), "n_lang", "v",
    ).withColumn("q", F.expr(_share("c", "n_lang"))).select("lang", "term", "counts", "p", "q")


def pair_sums(found: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, i, j, value): contributions of all terms to each pair of sources, i before j."""
    none = langs.select("lang", F.expr("array_repeat(1L, n_sources)").alias("p"))  # equal shares: 0 for every pair, so that no pair is missing
    contributions = "transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), y -> (x - y) * (x - y) div (x + y)))"
    rows = found.select("lang", "p").unionByName(none).select("lang", F.posexplode(F.expr(contributions)).alias("i", "row"))
    pairs = rows.select("lang", "i", F.posexplode("row").alias("k", "f"))
    return pairs.groupBy("lang", "i", (F.col("i") + F.col("k") + 1).alias("j")).agg(F.sum("f").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``pair`` rows: every other source of the language with its distance; ``term`` rows: the terms that a source has more of than its language."""
    plain = only(docs, "text", "lang", "source")
    plain = plain.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in plain.columns])
    groups = plain.select("lang", "source").distinct()
    groups = stage(groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "sources")
    langs = groups.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "source"))), lambda x: x["source"]).alias("sources"))
    langs = stage(langs.withColumn("n_sources", F.size("sources")), "languages")
    vectors = stage(term_vectors(count_terms(plain), groups, langs, least), "term-vectors")
    found = shares(vectors, langs)
    sums = pair_sums(found, langs)
    pairs = sums.select("lang", F.explode(F.array(F.struct(F.col("i").alias("own"), F.col("j").alias("other")), F.struct(F.col("j").alias("own"), F.col("i").alias("other")))).alias("x"), "value")
    pairs = pairs.join(langs, "lang").select("lang", F.expr("sources[x.own]").alias("source"), F.lit("pair").alias("part"), F.expr("sources[x.other]").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    more = found.select("lang", "term", "q", F.posexplode(F.arrays_zip("counts", "p")).alias("at", "x")).where("x.counts > 0 AND x.p > q")
    more = more.select("lang", "at", F.col("term").alias("item"), F.expr("(x.p - q) * (x.p - q) div (x.p + q)").alias("value"))
    ranked = more.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "at").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    told = ranked.join(groups, ["lang", "at"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(told)
