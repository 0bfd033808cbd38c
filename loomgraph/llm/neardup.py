"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

The sketch follows Dahlgaard, Knudsen and Thorup (2017): in round i every shingle is thrown into
one of T bins and offers the value i + fraction; an empty bin takes the least offer of the first
round that reaches it, and in rounds T to 2T-1 all shingles go to bin i-T, so every bin fills. Two
sets agree in a bin with probability equal to their Jaccard similarity, with concentration as
for independent minima. ``BANDS`` bands of ``ROWS`` bins make candidates; a pair at similarity 0.75 misses all
bands with probability (1 - 0.75^4)^32 < 6e-6. Candidates are confirmed on the full sets.

Work is arranged so that a group of copies costs its size, not its square:

1. equal sets are one class, found by a digest of the whole set, with a number of its own and the least doc_id that has it;
2. each class is compared with the least class of its buckets (a star), confirmed
   links are contracted to components, and a few more rounds of stars with other centres join what one
   centre missed; only pairs of one bucket in different components are ever compared;
3. in buckets of few members the pairs that are left are enumerated inside the join, where sizes and two
   bits of every sketch bin must allow a similarity of 0.75 (mismatches within 5.9 standard deviations), and confirmed;
4. in larger buckets the members outside the largest component meet all members block by block, each block of
   bounded volume, through an inverted list of shingles; only confirmed links leave a block.

Members of a bucket are dealt into parts of about ``PART``, and what is joined to a bucket is repeated for each part.

Defined results: a null, empty or blank text has an empty set, ``n_shingles`` 0, and is alone;
repeated rows of one ``doc_id`` with the same text stay separate rows of one component; each row of a ``doc_id`` with several texts
is linked by its own text, and rows of one ``doc_id`` are not linked by that alone; a null
``doc_id`` gets a row that is its own component (null) and links nothing; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage, with_own_names

SHINGLE, ROWS, BANDS = 5, 4, 32
BINS = ROWS * BANDS
#: Sketch bins, of which two bits are kept, that a pair at the threshold may differ in.
MOST_MISMATCHES = 50
#: Rounds of stars after the first; members of a bucket whose pairs are enumerated; shingles in a side of a block.
STARS, FEW, BLOCK = 1, 32, 1 << 19
#: Members of a bucket that a task should meet at once.
PART = 512
THRESHOLD = (75, 100)

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a text, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(w) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(w))], np.uint64)
    n = len(w) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h += mix(w[i : i + n] + _MULT[i]) * _MULT[i]
    return np.unique(mix(h))


def sketch(values: np.ndarray, sizes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Sketches of many sets at once; *values* holds the sets one after another. Sizes are > 0."""
    n = len(sizes)
    out = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    base = np.repeat(np.arange(n, dtype=np.int64) * bins, sizes)
    open_ = np.ones(n, bool)
    owner = np.repeat(np.arange(n), sizes)
    for i in range(2 * bins):
        h = mix(values ^ mix(np.full(1, i + 1, np.uint64) * _MULT[0]))
        into = base + ((h >> np.uint64(40)) % np.uint64(bins)).astype(np.int64) if i < bins else base + (i - bins)
        np.minimum.at(out, into, (np.uint64(i) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1)))
        still = (out.reshape(n, bins) == np.iinfo(np.uint64).max).any(axis=1)
        if not still.any():
            break
        if still.sum() < 0.7 * open_.sum():  # sets whose bins are all taken stop here
            pick = still[owner]
            values, base, owner, open_ = values[pick], base[pick], owner[pick], still
    return out.reshape(n, bins)


def bands_of(sk: np.ndarray, rows: int = ROWS) -> np.ndarray:
    h = np.zeros((sk.shape[0], sk.shape[1] // rows), np.uint64)
    for r in range(rows):
        h = mix(h * _MULT[1] + sk[:, r::rows])
    return mix(h + np.arange(h.shape[1], dtype=np.uint64) * _MULT[2]).view(np.int64)


def two_bits(sk: np.ndarray) -> np.ndarray:
    """Two bits of every bin, 32 bins a number."""
    low = (mix(sk) & np.uint64(3)).reshape(len(sk), -1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return np.bitwise_or.reduce(low, axis=2).view(np.int64)


_SKETCHED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64()))])
#: Shingles that are worked on at once in a task.
_CHUNK = 1 << 20


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sets, total = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            sets.append(shingle_hashes(text.as_py()))
            total += len(sets[-1])
            if total >= _CHUNK:
                yield _sketched(ids, sets)
                ids, sets, total = [], [], 0
        if ids:
            yield _sketched(ids, sets)


def _sketched(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    bands: list = [None] * len(ids)
    marks: list = [None] * len(ids)
    if len(full):
        sk = sketch(np.concatenate([sets[i] for i in full]), sizes[full])
        for i, b, m in zip(full, bands_of(sk), two_bits(sk)):
            bands[i], marks[i] = b, m
    digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))], schema=_SKETCHED)


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, digest, text) to (rep, shingle hashes) where the text has that digest, a few sets at a time."""
    for batch in batches:
        ids, sets, total = [], [], 0
        for rep, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            own = shingle_hashes(text.as_py())
            if xxhash.xxh3_128_digest(own.tobytes()) != digest:
                continue
            ids.append(rep)
            sets.append(own.view(np.int64))
            total += len(own)
            if total >= _CHUNK:
                yield _sets(ids, sets)
                ids, sets, total = [], [], 0
        if ids:
            yield _sets(ids, sets)


def _sets(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    flat = pa.array(np.concatenate(sets), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["rep", "shingles"])


def _alike(x: str, y: str) -> str:
    """Whether sizes and sketches of two rows allow the threshold, as a condition of a join."""
    low = 0x5555555555555555
    differing = " + ".join(f"bit_count((({x}.marks[{k}] ^ {y}.marks[{k}]) | shiftrightunsigned({x}.marks[{k}] ^ {y}.marks[{k}], 1)) & {low})" for k in range(BINS // 32))
    ratio = f"{THRESHOLD[1]} * least({x}.n, {y}.n) >= {THRESHOLD[0]} * greatest({x}.n, {y}.n)"
    return f"{x}.comp <> {y}.comp AND {ratio} AND {differing} <= {MOST_MISMATCHES}"


def connected_components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """``(node, component)`` of an edge table ``(a, b)``: the least node that is reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Each step hangs nodes onto
    their least neighbour, so a hub only ever spreads one number; the edges are written after
    each round and the loop ends when a round leaves them as they were.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        last, e = e, stage(small.where("a <> b").distinct(), "edges")
        drop_staged(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that are similar enough on the full sets."""
    left = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    joined = pairs.join(left, "b").join(right, "a")
    inter = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa").cast("long") + F.size("sb") - inter
    return joined.where(F.lit(THRESHOLD[1]) * inter >= F.lit(THRESHOLD[0]) * union).select("a", "b")


def _block_links(left: DataFrame, facts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components inside the buckets of *facts*, compared block by block."""
    outer = F.ceil((F.col("volume") - F.col("main.v")) / BLOCK).cast("int")
    grid = facts.select("value", F.col("main.comp").alias("main"), F.greatest(outer, F.lit(1)).alias("outs"), F.ceil(F.col("volume") / BLOCK).cast("int").alias("alls"))
    rows = left.select("value", "rep", "comp").join(grid, "value").join(sets, "rep")
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outsiders = rows.where("comp <> main").select("value", place("outs").alias("i"), numbers("alls").alias("j"), "rep", "comp", "shingles")
    everyone = rows.select("value", numbers("outs").alias("i"), place("alls").alias("j"), "rep", "comp", "shingles")
    keys = ["value", "i", "j"]
    everyone = everyone.toDF(*everyone.columns)  # attributes of its own, as a cogroup needs
    return outsiders.groupBy(*keys).cogroup(everyone.groupBy(*keys)).applyInArrow(_link_block, "a long, b long")


def _link_block(left: pa.Table, right: pa.Table) -> pa.Table:
    """Linked pairs of two tables of (rep, comp, shingles) that join components; a pair of components that others have joined isn't named."""
    found: list[tuple[int, int]] = []
    above: dict[int, int] = {}

    def top(c: int) -> int:
        while c in above:
            c = above[c]
        return c

    if left.num_rows and right.num_rows:
        lists = right["shingles"].combine_chunks()
        sizes = np.asarray(lists.value_lengths())
        values = lists.flatten().to_numpy()
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(sizes)), sizes)[order]
        reps, comps = right["rep"].to_numpy(), right["comp"].to_numpy()
        for rep, comp, own in zip(left["rep"].to_pylist(), left["comp"].to_pylist(), left["shingles"].combine_chunks()):
            own = own.values.to_numpy()
            lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            inter = np.bincount(owner[at], minlength=len(sizes))
            hit = np.flatnonzero((THRESHOLD[1] * inter >= THRESHOLD[0] * (len(own) + sizes - inter)) & (comps != comp))
            for other, k in zip(*np.unique(comps[hit], return_index=True)):
                x, y = top(comp), top(int(other))
                if x != y:
                    above[max(x, y)] = min(x, y)
                    found.append((rep, int(reps[hit[k]])))
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _mixed(left: DataFrame, comps: DataFrame) -> DataFrame:
    """The members, with their components, of buckets that hold more than one component."""
    placed = left.drop("comp").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    mixed = _per_part(placed.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("part").alias("parts")).where("lo < hi").select("value", "parts"))
    return stage(placed.join(mixed, ["value", "part"], "left_semi"), "mixed")


def _per_part(buckets: DataFrame) -> DataFrame:
    """A row of a bucket once for each of its parts 0 to ``parts``."""
    return buckets.withColumn("part", F.explode(F.sequence(F.lit(0), "parts"))).drop("parts")


def near_duplicates(docs: DataFrame, detailed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of *docs* (``doc_id``, ``text``).

    *detailed* adds the ``digest`` of the row's set and a number of its ``component``, null for empty sets and rows without an id.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    done = stage(docs.mapInArrow(_sketch_batches, "doc_id long, n_shingles long, digest binary, bands array<long>, marks array<long>"), "sketches")
    some = done.where("digest is not null and doc_id is not null")

    classes = some.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("marks").alias("marks"), F.first("n_shingles").alias("n"))
    classes = stage(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    spread = classes.select("rep", "doc_id", "n", "marks", F.explode("bands").alias("value"))
    # The first document of a bucket is the likeliest to be what the others vary.
    shared = spread.groupBy("value").agg(F.min(F.struct("doc_id", "rep")).alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1")
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("c") / PART)).cast("int")
    members = stage(spread.join(shared, "value").select("value", part.alias("part"), "least", "rep", "n", "marks"), "members")

    wanted = classes.select("rep", "digest", "doc_id").join(members.select("rep").distinct(), "rep", "left_semi")
    texts = docs.withColumn("hash", F.xxhash64("text")).join(wanted, "doc_id").dropDuplicates(["doc_id", "rep", "hash"]).select("rep", "digest", "text")
    sets = stage(texts.mapInArrow(_set_batches, "rep long, shingles array<long>"), "sets")

    # One link a member: to the least class that any of its buckets shows.
    star = members.where("least.rep <> rep").groupBy("rep").agg(F.min("least").alias("a")).select("a.rep", F.col("rep").alias("b")).toDF("a", "b")
    links = stage(_verified(star, sets), "links")
    left = members.drop("least")
    for r in range(STARS):
        found = connected_components(links)
        before, left = left, _mixed(left, found)
        drop_staged(before, found)
        centre = _per_part(left.groupBy("value").agg(F.min_by(F.struct("rep", "n", "marks", "comp"), F.xxhash64(F.lit(r), "rep")).alias("y"), F.max("part").alias("parts")))
        pairs = left.alias("x").join(centre.alias("c"), F.expr("x.value = c.value AND x.part = c.part AND " + _alike("x", "c.y")))
        pairs = pairs.select(F.least("x.rep", "c.y.rep").alias("a"), F.greatest("x.rep", "c.y.rep").alias("b")).distinct()
        links = links.unionByName(stage(_verified(pairs, sets), "links"))
    found = connected_components(links)
    before, left = left, _mixed(left, found)
    drop_staged(before)
    facts = left.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("v"))
    facts = stage(facts.groupBy("value").agg(F.sum("c").alias("members"), F.sum("v").alias("volume"), F.max_by(F.struct("comp", "v"), "c").alias("main")), "buckets")
    few = left.join(facts.where(F.col("members") <= FEW).select("value"), "value", "left_semi")
    pairs = few.alias("x").join(few.alias("y"), F.expr("x.value = y.value AND x.rep < y.rep AND " + _alike("x", "y")))
    pairs = pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    more = stage(_verified(pairs, sets).unionByName(_block_links(left, facts.where(F.col("members") > FEW), sets)), "links")
    final = connected_components(links.unionByName(more))
    drop_staged(sets, left, facts, found, more, links)

    ids = classes.select("digest", "rep", F.col("doc_id").alias("least_id"))
    linked = ids.join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labels = linked.join(least, "component").select("digest", "component_id", "component")
    out = done.select("doc_id", "n_shingles", "digest").join(labels, "digest", "left")
    more = ["digest", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component")] if detailed else []
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.cast("long").alias("component_id"), *more).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of *docs*, one of each component: its least id, and of several rows of that id the one whose columns, as JSON, come first.

    Rows without an id or without words are in no component and all stay. Columns keep their names, whatever those are, and may be of any type.
    """
    return with_own_names(docs, _keep_one, "doc_id", "text")


def _keep_one(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs, detailed=True)
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    # Most rows stay, so those that may not are named: the smaller side of the join with the texts.
    doubtful = stage(ids.where("n > 1 OR NOT kept"), "doubtful")
    out = docs.join(doubtful.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    several = doubtful.where("n > 1 AND kept").select("doc_id")
    if several.isEmpty():
        return out
    # Ids of several rows: the rows are told apart by the digests of their sets.
    digest_of = F.arrow_udf(lambda texts: pa.array([xxhash.xxh3_128_digest(h.tobytes()) if len(h := shingle_hashes(t.as_py())) else None for t in texts], pa.binary()), "binary")
    rows = docs.join(several, "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("id"), digest_of("text").alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = found.where("kept AND digest IS NOT NULL").select(F.col("doc_id").alias("id"), "digest", "component").distinct()
    one = rows.join(kept, ["id", "digest"]).groupBy("component").agg(F.min_by("row", F.to_json("row", {"ignoreNullFields": "false"})).alias("row"))
    return out.unionByName(one.select("row.*")).unionByName(rows.where("digest IS NULL").select("row.*"))
