"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures every document once and sets one failure bit a rule. Policies are versioned
masks over those bits, so that a verdict under another policy, or the effect of leaving out one
rule (``ablation``), needs bit operations on the ledger and never the texts.

Defined results: a null or empty text has no words, so every measurement is 0 and the rule on few
words fails; repeated rows are measured row by row; a null ``doc_id`` is kept as null; an empty
table gives an empty ledger; other columns of the input are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RUN, with_own_names

SYMBOLS = "#*$%&|<>"

#: Rule name and its failure condition over the measurements; the bit is the place in this list.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "100 * n_symbols > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("repeated_lines", "n_lines >= 10 AND 100 * n_dup_lines > 60 * n_lines"),
]
BASE_RULES = ("few_words", "repeated_words")
#: A policy is the set of rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE_RULES,
    "v2": (*BASE_RULES, "many_symbols", "short_words", "long_words"),
    "v3": tuple(name for name, _ in RULES),
}
CURRENT = "v3"


def mask(names: tuple[str, ...]) -> int:
    place = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << place[name] for name in names)


def _length_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document: *keep*, the measurements, nothing of the text.

    Three-word windows are compared inside one document, by their words; sorting them, by a hash first, which is
    quick, brings equal ones together, so no row leaves its document and nothing is shuffled.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(*keep, t.alias("__t"), F.array_remove(F.split(t, SPACE_RUN), "").alias("__w"))
    base = words.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        _length_without(F.col("__t"), SPACE).cast("long").alias("word_chars"),
        (F.length("__t") - _length_without(F.col("__t"), SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")).alias("__l"),
        F.expr(
            "if(size(__w) < 4, array(), sort_array(transform(sequence(0, size(__w) - 3), "
            "i -> struct(struct(xxhash64(__w[i], __w[i + 1], __w[i + 2]), __w[i], __w[i + 1], __w[i + 2]) AS h, i AS p))))"
        ).alias("__s"),
    )
    found = base.select(
        *keep, "n_words", "word_chars", "n_symbols",
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "sort_array(transform(filter(__s, (x, i) -> coalesce(x.h = get(__s, i - 1).h, false) "
            "OR coalesce(x.h = get(__s, i + 1).h, false)), x -> x.p))"
        ).alias("__p"),
    )
    covered = F.expr(
        "cast(aggregate(transform(__p, (p, i) -> least(3, coalesce(get(__p, i + 1) - p, 3))), 0, (a, x) -> a + x) AS BIGINT)"
    )
    # A filter on the ledger must not be pushed below: it would repeat all of the above once for each use
    # of a measurement. A term that the optimizer takes for non-deterministic, and that is 0, keeps it here.
    zero = F.least(F.monotonically_increasing_id(), F.lit(0))
    return found.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", (covered + zero).alias("n_repeat_words")
    )


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements and ``failed``, the bits of the rules that a document fails."""
    bits = " + ".join(f"if({cond}, {1 << i}, 0)" for i, (_, cond) in enumerate(RULES))
    return measure(docs, text, keep).withColumn("failed", F.expr(f"cast({bits} AS BIGINT)"))


def apply_policy(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """``base_failed`` and ``kept`` under the named policy, from the bits alone."""
    return led.withColumns(
        {
            "base_failed": F.col("failed").bitwiseAND(F.lit(mask(BASE_RULES))) != 0,
            "kept": F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0,
        }
    )


def keep_passing(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of *docs* that pass the policy, with their own columns, whatever the names of those."""

    def passing(docs: DataFrame) -> DataFrame:
        rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
        return apply_policy(ledger(rows, keep=("row",)), version).where("kept").select("row.*")

    return with_own_names(docs, passing, "text")


def ablation(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy
    would keep without it. One aggregation over at most 2^rules distinct bit patterns."""
    names = POLICIES[version]
    whole = mask(names)
    seen = led.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rows = seen.select("bits", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in names])).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    zero = F.lit(0).cast("long")
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(zero)).alias("n_failed_alone"),
        F.sum(F.when((F.col("bits") == 0) | alone, F.col("n")).otherwise(zero)).alias("n_kept_without"),
    )
