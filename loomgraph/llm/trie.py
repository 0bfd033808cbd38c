"""Trie of conversation prefixes by polynomial rolling fingerprints.

1. Turns are laid out by ranges of (conversation, turn), so that one long conversation may lie in many tasks. Numpy scans over each range give
   every turn its place, the fingerprint of the prefix that it ends and the words so far; what a conversation brings along from an
   earlier range, at most one row a range, is added afterwards.
2. Conversations share heads: the first turns of one conversation in each block of 20 replace those of the others. Fingerprints
   are sums of powers, so those of the rebuilt conversations follow from sums already there, without a second scan and without texts.
3. Prefixes of equal length and fingerprint are candidates for one node. A group is verified turn by turn: all members must come from the
   same parent group, and their last turns must equal the representative's, the smallest. Where all come from one stored turn
   there is nothing to compare; else each turn is read once. Groups with a collision are split: their conversations get
   fingerprints to other primes and bases from the first such turn on, and are verified again.
4. Rollup to parents: children are counted at the parent's fingerprint. A node's subtree is what its members own from its depth on, a
   conversation owning the nodes whose smallest member it is, so leaves and savings of all ancestors come from one aggregation and depth costs no rounds.

Defined results: rows without ``conv_id`` belong to no conversation and are left out; null roles and texts are empty; of equal turns the one with the
smaller role, then text, comes first, and repeated rows are turns of their own; a conversation that loses all turns ends at the
root; no conversations give no nodes. Remainders have the sign of ``conv_id``. Other columns are ignored, whatever their names. Texts are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, stage
from .mixing import n_words

#: Conversations of a block, and most turns that its first one lends.
BLOCK, HEAD = 20, 4
#: Two primes below 2^31 and a base for each; the next rounds take the next pairs.
PRIMES = ((2147483647, 2147483629), (2147483587, 2147483579), (2147483563, 2147483549))
BASES = (1_234_577, 87_654_337)
#: Ids joined before they meet at their node.
CHUNK = 4096
_NODE = ["depth", "round", "key"]
_SCANNED = "conv_id long, part int, at long, words long, w long, h0 long, h1 long, g0 long, g1 long, role string, text string"


def _powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    out, b, e = np.ones(len(exponents), np.uint64), np.uint64(base % prime), exponents.astype(np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1), out * b % np.uint64(prime), out)
        b, e = b * b % np.uint64(prime), e >> np.uint64(1)
    return out


def _scan(primes: tuple[int, int]):
    """Place in the conversation, words so far, and fingerprints with (h) and without (g) the turn, all from the start of the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, words_seen, sums = TaskContext.get().partitionId(), None, 0, 0, [0, 0]
        for b in batches:
            if not b.num_rows:
                continue
            conv, words, turn = (b.column(c).to_numpy() for c in ("conv_id", "words", "hash"))
            new = np.r_[last is None or conv[0] != last, conv[1:] != conv[:-1]]
            row = np.arange(len(conv))
            start = np.maximum.accumulate(np.where(new, row, 0))
            goes_on = np.cumsum(new) == 0
            at = row - start + 1 + np.where(goes_on, seen, 0)
            w = np.cumsum(words)
            w = w - (w - words)[start] + np.where(goes_on, words_seen, 0)
            columns = [conv, np.full(len(conv), part, np.int32), at, words, w]
            with_turn, without = [], []
            for k, p in enumerate(primes):
                x = np.mod(turn, p).astype(np.uint64) * _powers(BASES[k], at, p) % np.uint64(p)
                total = np.cumsum(x)
                h = (total - (total - x)[start] + np.where(goes_on, sums[k], 0).astype(np.uint64)) % np.uint64(p)
                with_turn.append(h.astype(np.int64))
                without.append(((h + np.uint64(p) - x) % np.uint64(p)).astype(np.int64))
            last, seen, words_seen, sums = conv[-1], int(at[-1]), int(w[-1]), [int(h[-1]) for h in with_turn]
            arrays = [pa.array(c) for c in columns + with_turn + without] + [b.column("role"), b.column("text")]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "at", "words", "w", "h0", "h1", "g0", "g1", "role", "text"])

    return run


def _turns(rows: DataFrame, round_: int, primes: tuple[int, int]) -> DataFrame:
    """Turns with their place, words and fingerprints from the start of the conversation."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    hashed = rows.withColumns({"words": n_words(F.col("text")), "hash": F.xxhash64(F.lit(round_), "role", "text")})
    laid = hashed.repartitionByRange(*order, F.substring("text", 1, 16)).sortWithinPartitions(*order, "text")
    found = stage(laid.drop("turn").mapInArrow(_scan(primes), _SCANNED), "turns")
    pieces = found.groupBy("conv_id", "part").agg(F.max(F.struct("at", "w", "h0", "h1")).alias("e"))
    split = pieces.join(pieces.groupBy("conv_id").count().where("count > 1"), "conv_id", "left_semi")
    brought, before = [], {}
    for r in split.orderBy("conv_id", "part").collect():  # conversations over more than one range: two rows a range at most
        n, w, h0, h1 = before.get(r.conv_id, (0, 0, 0, 0))
        f0, f1 = (pow(BASES[k], n, p) for k, p in enumerate(primes))
        if n:
            brought.append((r.conv_id, r.part, n, w, h0, h1, f0, f1))
        before[r.conv_id] = (n + r.e.at, w + r.e.w, (h0 + f0 * r.e.h0) % primes[0], (h1 + f1 * r.e.h1) % primes[1])
    if not brought:
        return found.drop("part")
    carry = rows.sparkSession.createDataFrame(brought, "conv_id long, part int, n long, w_ long, h0_ long, h1_ long, f0 long, f1 long")
    joined = found.join(F.broadcast(carry), ["conv_id", "part"], "left")  # a row a range at most
    shifted = {c: F.expr(f"if(n IS NULL, {c}, (h{k}_ + f{k} * {c}) % {primes[k]})") for k in (0, 1) for c in (f"h{k}", f"g{k}")}
    return joined.withColumns({"at": F.expr("at + coalesce(n, 0)"), "w": F.expr("w + coalesce(w_, 0)"), **shifted}).drop("part", "n", "w_", "h0_", "h1_", "f0", "f1")


def _members(turns: DataFrame, round_: int, primes: tuple[int, int]) -> DataFrame:
    """One row a conversation and depth from 0: fingerprints of the rebuilt prefix and its parent, the stored turn, words from there to the end."""
    heads = [F.max(F.when(F.col("at") == i, F.struct("w", "h0", "h1"))).alias(f"head{i}") for i in range(1, HEAD)]
    convs = turns.groupBy("conv_id").agg(F.max(F.struct("at", "w", "h0", "h1")).alias("all"), *heads)
    sums = [F.array(F.lit(0).cast("long"), *[F.coalesce(f"head{i}.{c}", f"all.{c}") for i in range(1, HEAD)]).alias(c) for c in ("w", "h0", "h1")]
    convs = stage(convs.select("conv_id", F.col("all.at").alias("n"), F.col("all.w").alias("words"), *sums), "conversations")
    lender = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("bn"), F.col("w").alias("bw"), F.col("h0").alias("b0"), F.col("h1").alias("b1"))
    spec = convs.withColumns({"base": F.expr(f"conv_id - conv_id % {BLOCK}"), "h": F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEAD))})
    spec = spec.join(lender, "base", "left").withColumn("nb", F.least(F.col("h"), F.coalesce("bn", F.lit(0))).cast("int")).withColumn("h", F.col("h").cast("int"))
    none = F.array_repeat(F.lit(0).cast("long"), HEAD)
    spec = spec.withColumns({c: F.coalesce(c, none) for c in ("bw", "b0", "b1")})
    spec = stage(spec.withColumns({"len": F.expr("nb + greatest(n - h, 0)"), "whole": F.expr("bw[nb] + words - w[h]")}).drop("n", "words", "bn"), "rebuilt")
    key = lambda a, b: f"({a}) * 2147483648 + ({b})"
    shared = ["conv_id", "len", F.lit(round_).alias("round")]
    root = spec.select(*shared, F.lit(0).cast("long").alias("depth"), F.expr("0L AS key"), F.expr("0L AS prev"), F.col("whole").alias("rest"), F.expr("CAST(NULL AS STRUCT<conv_id: BIGINT, at: BIGINT>) AS src"))
    head = spec.withColumn("i", F.explode(F.expr("filter(sequence(0, nb), x -> x > 0)"))).select(
        *shared, F.col("i").cast("long").alias("depth"), F.expr(f"{key('b0[i]', 'b1[i]')} AS key"), F.expr(f"{key('b0[i - 1]', 'b1[i - 1]')} AS prev"),
        F.expr("whole - bw[i - 1] AS rest"), F.expr("struct(base AS conv_id, CAST(i AS BIGINT) AS at) AS src"),
    )
    # places move down by what the lender's head is shorter, so sums are multiplied by the inverse power
    back = [F.array(*[F.lit(pow(BASES[k], -d, p)).cast("long") for d in range(HEAD)]) for k, p in enumerate(primes)]
    lent = spec.select("conv_id", "len", "whole", "h", "nb", F.expr("bw[nb] AS bw"), F.expr("w[h] AS wh"), *[F.expr(f"b{k}[nb] AS b{k}") for k in (0, 1)], *[F.expr(f"h{k}[h] AS p{k}") for k in (0, 1)])
    own = turns.drop("role", "text").join(lent, "conv_id").where("at > h").withColumns({f"back{k}": F.get(back[k], F.expr("h - nb")) for k in (0, 1)})
    moved = lambda c, k: f"(b{k} + ({c}{k} - p{k} + {primes[k]}) % {primes[k]} * back{k}) % {primes[k]}"
    own = own.select(
        *shared, F.expr("at - h + nb AS depth"), F.expr(f"{key(moved('h', 0), moved('h', 1))} AS key"), F.expr(f"{key(moved('g', 0), moved('g', 1))} AS prev"),
        F.expr("whole - bw - (w - words - wh) AS rest"), F.expr("struct(conv_id, at) AS src"),
    )
    return root.unionByName(head).unionByName(own).withColumn("prev", F.struct("round", "prev"))


def _collisions(members: DataFrame, turns: DataFrame) -> DataFrame:
    """Groups whose members differ in the parent group or in the last turn."""
    groups = members.groupBy(*_NODE).agg(
        (F.min("prev") != F.max("prev")).alias("mixed"), (F.min("src") != F.max("src")).alias("several")
    )
    groups = stage(groups.where("depth > 0 AND (mixed OR several)"), "candidates")
    read = members.join(groups.where("several AND NOT mixed"), _NODE).select(*_NODE, "src.conv_id", "src.at").distinct()
    said = read.join(turns.select("conv_id", "at", F.struct("role", "text").alias("turn")), ["conv_id", "at"])
    unlike = said.groupBy(*_NODE).agg(F.min("turn").alias("a"), F.max("turn").alias("b")).where("a != b")
    return groups.where("mixed").select(*_NODE).unionByName(unlike.select(*_NODE))


def memberships(rows: DataFrame, primes: tuple[tuple[int, int], ...] = PRIMES) -> DataFrame:
    """The verified members of every node, a node being (depth, round, key)."""
    turns = _turns(rows, 0, primes[0])
    done, fresh, round_ = None, stage(_members(turns, 0, primes[0]), "members"), 0
    while True:
        bad = stage(_collisions(fresh, turns), "collisions")
        if bad.isEmpty():
            return fresh if done is None else done.unionByName(fresh)
        round_ += 1
        first = stage(fresh.join(bad, _NODE).groupBy("conv_id").agg(F.min("depth").alias("first")), "collided")
        kept = fresh.join(first, "conv_id", "left").where("first IS NULL OR depth < first").drop("first")
        done = kept if done is None else done.unionByName(kept)
        needed = first.select("conv_id").unionByName(first.select(F.expr(f"conv_id - conv_id % {BLOCK} AS conv_id"))).distinct()
        turns = _turns(rows.join(needed, "conv_id", "left_semi"), round_, primes[round_ % len(primes)])
        again = _members(turns, round_, primes[round_ % len(primes)]).join(first, "conv_id").where("depth >= first")
        entry = fresh.join(first, "conv_id").where("depth = first").select("conv_id", F.col("depth").alias("first"), F.col("prev").alias("entry"))
        again = again.join(entry, ["conv_id", "first"]).withColumn("prev", F.when(F.col("depth") == F.col("first"), F.col("entry")).otherwise(F.col("prev")))
        fresh = stage(again.drop("first", "entry"), "members")


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node. Ids are ordered and joined in ranges; a node's pieces, of thousands of ids each, are then hashed in a stream."""

    def join(batches):
        for b in batches:
            b = b.reset_index(drop=True)
            piece = b.groupby([*_NODE, b.index // CHUNK], sort=False)["conv_id"]
            out = piece.agg(["min", lambda x: ",".join(map(str, x))]).reset_index()
            out.columns = [*_NODE, "_", "least", "ids"]
            yield out.drop(columns="_")

    def digest(batches):
        node = sha = None
        for b in batches:
            rows = []
            for depth, round_, key, _, ids in b[[*_NODE, "least", "ids"]].itertuples(index=False):
                if (depth, round_, key) != node:
                    if node is not None:
                        rows.append((*node, sha.hexdigest()))
                    node, sha = (depth, round_, key), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _frame(rows)
        if node is not None:
            yield _frame([(*node, sha.hexdigest())])

    def _frame(rows):
        import pandas as pd

        return pd.DataFrame(rows, columns=[*_NODE, "ends_sha256"])

    laid = ends.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    pieces = laid.mapInPandas(join, "depth long, round int, key long, least long, ids string")
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "least").mapInPandas(digest, "depth long, round int, key long, ends_sha256 string")


def trie(conversations: DataFrame, primes: tuple[tuple[int, int], ...] = PRIMES) -> DataFrame:
    """One row a node: a distinct sequence of first turns of the rebuilt conversations."""
    plain = only(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").withColumn("conv_id", F.col("conv_id").cast("long"))
    plain = plain.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")})
    members = memberships(plain, primes)
    nodes = members.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min(F.struct("conv_id", "rest", "prev")).alias("r"), (F.max("len") == F.col("depth")).alias("childless"))
    nodes = stage(nodes.select(*_NODE, "n_convs", "r.conv_id", "r.rest", F.col("r.prev.round").alias("pround"), F.col("r.prev.prev").alias("pkey"), "childless"), "nodes")
    owners = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "rest")).alias("top"), F.max(F.col("childless").cast("long")).alias("leaf"))
    shared = F.when(F.col("top").isNull() | (F.col("depth") < F.col("top.depth")), F.col("rest") - F.coalesce("top.rest", F.lit(0))).otherwise(0)
    rolled = members.select(*_NODE, "conv_id", "rest").join(owners, "conv_id", "left").groupBy(*_NODE)
    rolled = rolled.agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(shared).alias("saved_tokens"))
    up = (F.col("depth") - 1).alias("depth"), F.col("pround").alias("round"), F.col("pkey").alias("key")
    below = nodes.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    ends = _digests(members.where("depth = len").select(*_NODE, "conv_id"))
    # the first level has the root for its parent, one row; the others join theirs
    root = nodes.where("depth = 0").select(F.col("conv_id").alias("parent_conv_id"))
    first = nodes.where("depth <= 1").crossJoin(F.broadcast(root)).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("parent_conv_id")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("round").alias("pround"), F.col("key").alias("pkey"), F.col("conv_id").alias("parent_conv_id"))
    deeper = nodes.where("depth > 1").join(parents, ["depth", "pround", "pkey"])
    found = first.unionByName(deeper).join(rolled, _NODE).join(below, _NODE, "left").join(ends, _NODE, "left")
    zero = F.lit(0).cast("long")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
