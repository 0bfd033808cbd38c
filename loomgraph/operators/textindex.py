"""A stored full-text index: posting lists in tiers of impact, kept current by segments.

A segment holds the postings of the rows that one write puts, and the keys whose earlier postings no longer count. A pointer file names the segments in
order and the totals that scores need. Postings are laid out by tier and term, so a search reads the files' row groups of its own terms alone, and of those
only the tiers that can still matter: it goes down the tiers until no row below can reach the best found. Small tables beside them hold what a term has
in each tier and how many rows have it, and each row's words, from which the scores of the few candidates are taken exactly.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import _cut, _place, drop
from .retrieval import terms

FIELDS = ("name", "description", "byname", "datasource")
#: Tiers of impact; segments after which all is written as one again.
TIERS, SEGMENTS = 32, 16
K1, B = 1.2, 0.75
_DDL = {"postings": "tier int, term string, key string, tf int, size int", "terms": "term string, tier int, max_tf int, min_size int, n long", "words": "key string, size int, counts map<string,int>",
        "gone": "key string"}


def _mean(rows: int, words: int) -> float:
    return words / rows if words else 1.0


class TextIndex:
    """Full text over rows with a string key, in one folder."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", fields: tuple[str, ...] = FIELDS):
        self.spark, self.path, self.key, self.fields = spark, path.rstrip("/"), key, fields
        #: Tiers, candidates and rows of the last search, for tests and reports.
        self.last: dict = {}

    # --- pointer
    def _state(self) -> tuple[int, dict]:
        at, store = _place(self.spark, self.path)
        names = [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []
        numbers = sorted(int(n.split(".")[1]) for n in names if n.startswith("index.") and n.endswith(".json"))
        for n in reversed(numbers):
            row = self.spark.read.text(f"{self.path}/index.{n}.json", wholetext=True).first()
            if row is not None and row.value.endswith("}"):  # else its writer died while it wrote
                return numbers[-1], json.loads(row.value)
        return (numbers[-1] if numbers else 0), {"segments": [], "rows": 0, "words": 0, "mean": 1.0}

    def _point(self, number: int, state: dict) -> None:
        at, store = _place(self.spark, f"{self.path}/index.{number + 1}.json")
        out = store.create(at, False)  # fails where another writer has made this version
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    def _read(self, kind: str, segments: list[str]) -> list[DataFrame]:
        return [self.spark.read.schema(_DDL[kind]).parquet(f"{self.path}/{s}/{kind}") for s in segments]

    # --- writing
    def _words(self, rows: DataFrame) -> DataFrame:
        """A row a key, in their order: the number of its words, and of each. All within the row, after raw rows are dealt out."""
        dealt = rows.select(F.col(self.key).alias("key"), F.concat_ws(" ", *self.fields).alias("text")).repartitionByRange("key").sortWithinPartitions("key")
        found = dealt.select("key", F.sort_array(terms("text")).alias("w")).withColumn("size", F.size("w"))
        begins = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
        found = found.withColumn("at", F.when(F.col("size") > 0, begins).otherwise(F.array().cast("array<int>")))
        counts = F.transform("at", lambda i, k: F.coalesce(F.get("at", k + 1), F.col("size")) - i)
        return found.select("key", "size", F.map_from_arrays(F.transform("at", lambda i: F.get("w", i)), counts).alias("counts"))

    def _live(self, kind: str, segments: list[str], keys: DataFrame | None = None) -> DataFrame:
        """Rows of all segments, or of *keys* alone, but those whose key a later segment names."""
        of = lambda df: df if keys is None else df.join(keys, "key", "left_semi")
        parts, gone = self._read(kind, segments), self._read("gone", segments)
        for i in range(len(parts)):
            parts[i] = of(parts[i])
            if later := gone[i + 1 :]:
                parts[i] = parts[i].join(of(reduce(DataFrame.unionByName, later)).distinct(), "key", "left_anti")
        return reduce(DataFrame.unionByName, parts)

    def _segment(self, words: DataFrame, gone: DataFrame, lost: DataFrame | None, mean: float | None = None) -> tuple[str, int, int]:
        """Its name, rows and words; tiers are by *mean*, or by the mean of these rows. *words* come in ranges of keys."""
        name = uuid.uuid4().hex
        write = lambda df, kind: df.write.parquet(f"{self.path}/{name}/{kind}")
        write(words, "words")
        words = self._read("words", [name])[0]
        facts = words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
        if mean is None:
            mean = _mean(facts.n, facts.words)
        post = words.select("key", "size", F.explode("counts").alias("term", "tf"))
        impact = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
        post = post.select(F.least(F.lit(TIERS - 1), F.floor(impact * TIERS)).cast("int").alias("tier"), "term", "key", "tf", "size")
        write(post.repartitionByRange("tier", "term", "key").sortWithinPartitions("tier", "term", "key"), "postings")
        post = self._read("postings", [name])[0]
        found = post.groupBy("term", "tier").agg(F.max("tf").alias("max_tf"), F.min("size").alias("min_size"), F.count(F.lit(1)).alias("n"))
        if lost is not None:  # a row without a tier takes away
            less = lost.select(F.explode(F.map_keys("counts")).alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("n"))
            found = found.unionByName(less, allowMissingColumns=True)
        write(found.repartitionByRange("term").sortWithinPartitions("term"), "terms")
        write(gone, "gone")
        return name, facts.n, facts.words

    def build(self, rows: DataFrame) -> None:
        """The index of *rows*, one a key, alone, in one segment."""
        number, _ = self._state()
        name, n, words = self._segment(self._words(rows), rows.select(F.col(self.key).alias("key")).limit(0), None)
        self._point(number, {"segments": [name], "rows": n, "words": words, "mean": _mean(n, words)})

    def update(self, puts: DataFrame, gone: DataFrame | None = None) -> None:
        """Put rows, one a key, over those of their keys and take away the keys of *gone*; writes and reads only what these rows have."""
        number, state = self._state()
        if not state["segments"]:
            self.build(puts)
            return
        named = puts.select(F.col(self.key).alias("key"))
        if gone is not None:
            named = named.unionByName(gone.select(F.col(self.key).alias("key")))
        named = _cut(named.distinct())
        lost = _cut(self._live("words", state["segments"], named))
        before = lost.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
        name, n, words = self._segment(self._words(puts), named, lost, state["mean"])
        segments = [*state["segments"], name]
        state |= {"segments": segments, "rows": state["rows"] - before.n + n, "words": state["words"] - before.words + words}
        if len(segments) > SEGMENTS:
            whole = self._live("words", segments).repartitionByRange("key").sortWithinPartitions("key")
            state["mean"] = _mean(state["rows"], state["words"])
            state["segments"] = [self._segment(whole, named.limit(0), None, state["mean"])[0]]
        self._point(number, state)
        drop(named, lost)

    # --- reading
    def search(self, query: str, limit: int = 10) -> DataFrame:
        """(key, score): the *limit* best rows by BM25, ties to the smaller key; the same as by scanning all rows."""
        _, state = self._state()
        words = list(dict.fromkeys(self.spark.range(1).select(terms(F.lit(query)).alias("t")).first().t))
        empty = self.spark.createDataFrame([], "key string, score double")
        if not words or not state["segments"]:
            return empty
        of = F.col("term").isin(words)
        n, mean = state["rows"], _mean(state["rows"], state["words"])
        top = reduce(DataFrame.unionByName, self._read("terms", state["segments"])).where(of).groupBy("term", "tier").agg(F.max("max_tf").alias("tf"), F.min("min_size").alias("size"), F.sum("n").alias("n"))
        top = top.collect()  # TIERS + 1 rows a query term at most
        df = {t: have for t in words if (have := sum(r.n for r in top if r.term == t)) > 0}
        if not df:
            return empty
        idf = self.spark.range(1).select(*[F.log(F.lit(1 + (n - df[t] + 0.5) / (df[t] + 0.5))).alias(str(i)) for i, t in enumerate(df)]).first()
        weight = {t: idf[i] for i, t in enumerate(df)}
        bound: dict[str, dict[int, float]] = {t: {} for t in df}
        for r in top:
            if r.term in bound and r.tier is not None:
                bound[r.term][r.tier] = weight[r.term] * r.tf * (K1 + 1) / (r.tf + K1 * (1 - B + B * r.size / mean))
        full = {tier for b in bound.values() for tier in b}
        below = lambda tier: sum(max([v for k, v in b.items() if k < tier], default=0.0) for b in bound.values())
        share = reduce(lambda a, t: F.when(F.col("term") == t, weight[t]).otherwise(a), df, F.lit(0.0))
        part = share * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
        lowest, step, hits = TIERS, 1, []
        while True:
            above, lowest, step = lowest, max(0, lowest - step), 2 * step
            # Each tier is read once, and none that is empty; what was found in those above is kept.
            if any(lowest <= tier < above for tier in full):
                hits.append(_cut(self._live_postings(state["segments"], list(df), lowest, above)))
                partial = reduce(DataFrame.unionByName, hits).groupBy("key").agg(F.sum(part).alias("score"))
                best = partial.select("score").orderBy(F.desc("score")).limit(limit).collect()
                least = best[-1].score if len(best) == limit else float("-inf")
            rest = below(lowest)
            if lowest == 0 or (hits and rest < least - 1e-9):
                break
        candidates = _cut(partial.where(F.col("score") + rest >= least - 1e-9).select("key"))
        drop(*hits)
        self.last = {"lowest_tier": lowest, "tiers_of_terms": {t: sorted(b) for t, b in bound.items()}}
        scores = [F.coalesce(F.col("counts")[t], F.lit(0)) for t in df]
        exact = reduce(lambda a, b: a + b, [w * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / mean)) for w, tf in zip(weight.values(), scores)])
        found = self._live("words", state["segments"], candidates).select("key", exact.alias("score"))
        return found.orderBy(F.desc("score"), "key").limit(limit)

    def _live_postings(self, segments: list[str], words: list[str], lowest: int, above: int) -> DataFrame:
        parts, gone = self._read("postings", segments), self._read("gone", segments)
        out = []
        for i, p in enumerate(parts):
            p = p.where(F.col("term").isin(words) & (F.col("tier") >= lowest) & (F.col("tier") < above))
            if later := gone[i + 1 :]:
                p = p.join(reduce(DataFrame.unionByName, later).distinct(), "key", "left_anti")
            out.append(p)
        return reduce(DataFrame.unionByName, out)
