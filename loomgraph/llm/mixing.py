"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

1. Documents are measured once (words, a seeded order) and written as narrow rows; sources are summed up from them.
2. Water-filling: every source gets its weight's share of the budget. Sources above their most epochs are clamped there and what
   they leave is shared again by weight, until none is above. A round is one aggregation over one row a source, of
   which one row of sums comes to the driver; all of it is exact (decimals and whole numbers).
3. A source's target, rounded to whole words, is so many whole repetitions of the source and a rest. The rest is drawn from the source's
   documents in the seeded order, each once, and the document at which it ends is cut. So a source's words are its target to half a word.
4. Where the rest ends is found by narrowing: sums of at most 4096 groups a source by the first digits of the order, then the
   same inside the group that holds the end, until that holds few rows. No task sorts a source, however large it is.

Defined results: a null text has no words; a null source is a source of its own, behind all others; a null ``doc_id`` counts as empty text in the
order; of equal ids the shorter text comes first, and rows equal in both are alike, so it does not matter which of them is drawn. A source
without words has target 0. An empty table gives no rows. Very long texts are only split into words. A column that is called like
a result (``size``, ``source_size``, ``target``, ``taken``) is replaced.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.community import numbered
from .common import SPACE_RUN, by_place, stage

WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and epochs of a source at most.
SHARE, MOST = Fraction(3, 2), 2
#: Rows of a source that one task may put into their order.
FEW = 100_000
#: Groups of the seeded order, one inside the other: digits of the hash, the whole of it with the size, then written parts, for rows equal in both.
_LEVELS = ("substring(h, 1, 3)", "substring(h, 4, 3)", "concat(h, lpad(size, 20, '0'))", "lpad(shiftright(id, 33), 20, '0')")
RESULTS = ("size", "source_size", "target", "taken")


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")).cast("long")


def _whole(n: int) -> Column:
    return F.lit(Decimal(n)).cast("decimal(38,0)")


def water_level(sources: DataFrame, budget: Fraction, most: int = MOST) -> Fraction:
    """Words a unit of weight: sources (weight, size) get min(most x size, level x weight), and that sums up to *budget*."""
    total = sources.agg(F.sum("weight")).first()[0]
    level, clamped = Fraction(budget, total) if total else Fraction(0), 0
    while True:
        above = _above(level, most)
        found = sources.agg(
            F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        if found[0] == clamped or not found[2]:
            return level
        clamped, level = found[0], (budget - most * found[1]) / found[2]


def _above(level: Fraction, most: int) -> Column:
    return F.col("size").cast("decimal(38,0)") * _whole(most * level.denominator) < F.col("weight").cast("decimal(38,0)") * _whole(level.numerator)


def targets(measured: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: its ``size``, ``target``, and that as ``whole`` repetitions and ``left`` words."""
    sums = measured.groupBy("source").agg(F.sum("size").alias("size"))
    ranked = numbered(sums, F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod("number", F.lit(len(weights))).cast("int")).cast("long")
    sources = stage(ranked.select("source", "size", weight.alias("weight")), "sources")
    total = sources.agg(F.sum("size")).first()[0] or 0
    level = water_level(sources, share * total, most)
    above, capped = _above(level, most), F.col("size") * most
    part = F.col("weight").cast("decimal(38,0)") * _whole(level.numerator)
    rounded = (part * _whole(2) + _whole(level.denominator)).alias("n")
    return (
        sources.withColumn("n", rounded)
        .withColumn("quota", F.when(above, capped).otherwise(F.expr(f"n div cast({2 * level.denominator} AS DECIMAL(38,0))")))
        .withColumn("target", F.when(above, capped.cast("double")).otherwise(part.cast("double") / F.lit(float(level.denominator))))
        .withColumn("whole", F.expr("if(size > 0, quota div size, 0)"))
        .select("source", "size", "target", "whole", (F.col("quota") - F.col("whole") * F.col("size")).alias("left"))
    )


def _inside(rows: DataFrame, ends: DataFrame, depth: int) -> DataFrame:
    """Rows of the groups that hold the end of their source's rest, *depth* levels down."""
    rows, ends = rows.alias("r"), ends.where("left > 0").select(F.col("source").alias("s"), "left", *[f"end{i}" for i in range(depth)]).alias("e")
    same = F.col("r.source").eqNullSafe(F.col("e.s"))
    for i in range(depth):
        same &= F.col(f"r.key{i}") == F.col(f"e.end{i}")
    return rows.join(ends, same).select("r.*", "left")


def mix(
    docs: DataFrame, keep: tuple[str, ...] | None = None, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST,
    seed: int = 11, few: int = FEW,
) -> DataFrame:
    """The columns *keep* (default: all) of every row with its words, those of its source, the source's target, and the words that the mix takes of it."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    placed, col = by_place(docs, "doc_id", "text", "source", *kept)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col["doc_id"].cast("string"), F.lit(""))).cast("binary"))
    made = placed.select(
        F.struct(F.lit(0).alias("_"), *[col[c].alias(f"_{i}") for i, c in enumerate(kept)]).alias("row"), col["source"].cast("string").alias("source"), n_words(col["text"]).alias("size"),
        order.alias("h"), F.monotonically_increasing_id().alias("id"),
    )
    rows = stage(made, "measured").withColumns({f"key{i}": F.expr(key) for i, key in enumerate(_LEVELS)})
    ends = stage(targets(rows, weights, share, most), "targets")
    depth = 0
    while depth < len(_LEVELS):
        key = f"key{depth}"
        sums = _inside(rows, ends, depth).groupBy("source", key, "left").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        before = F.sum("words").over(Window.partitionBy("source").orderBy(key)) - F.col("words")
        hit = sums.withColumn("before", before).where("before < left AND left <= before + words")
        hit = hit.select(F.col("source").alias("s"), F.col(key).alias(f"end{depth}"), (F.col("left") - F.col("before")).alias("l"), "n")
        joined = ends.drop("n").join(hit, ends["source"].eqNullSafe(hit["s"]), "left")
        ends = stage(joined.withColumn("left", F.coalesce("l", F.lit(0))).drop("s", "l"), "ends")
        depth += 1
        if (ends.agg(F.max("n")).first()[0] or 0) <= few:
            break
    drawn = F.lit(None).cast("long")  # the end's own group, left to the order of its rows
    for i in reversed(range(depth)):
        key, end = F.col(f"key{i}"), F.col(f"end{i}")
        drawn = F.when(key < end, F.col("r.size")).when(key == end, drawn).otherwise(F.lit(0).cast("long"))
    ends = ends.withColumnsRenamed({"source": "s", "size": "source_size"})
    placed = rows.alias("r").join(ends, F.col("r.source").eqNullSafe(F.col("s"))).withColumn("drawn", drawn)
    before = F.sum("size").over(Window.partitionBy("source").orderBy("h", "size", "id")) - F.col("size")
    last = placed.where("drawn IS NULL").withColumn("before", before)
    last = last.withColumn("drawn", F.greatest(F.lit(0).cast("long"), F.least("size", F.col("left") - F.col("before")))).drop("before")
    done = placed.where("drawn IS NOT NULL").unionByName(last)
    own = [F.col(f"row._{i}").alias(c) for i, c in enumerate(kept)]  # Parquet takes no names that differ in case only
    return done.select(*own, "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("drawn")).alias("taken"))


def copies(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken (``copy`` from 1, ``words`` of it). A cut copy's text is its first words, joined by blanks."""
    found = mix(docs, **options).where("taken > 0")
    n = F.ceil(F.col("taken") / F.col("size"))
    out = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    out = out.withColumn("words", F.least("size", F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    first = F.array_join(F.slice(F.array_remove(F.split(F.col(text), SPACE_RUN), ""), F.lit(1), F.col("words").cast("int")), " ")
    return out.withColumn(text, F.when(F.col("words") < F.col("size"), first).otherwise(F.col(text)))
