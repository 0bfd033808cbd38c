"""Hierarchical packing of tokenized documents into sequences of several context sizes.

The context sizes are tiers, powers of two up to the longest. A document longer than the longest
tier is cut into full windows and a rest; rests and shorter documents are routed to the smallest tier
that holds them. Tiers are packed from the longest down: a window takes its document, gaps are filled with
the longest fitting documents of shorter tiers, and what is left of a gap is closed by the head of one
more document, whose rest is routed anew. A window that is closed has no padding. Sequences of a tier
are dealt into step groups of equal token counts.

Everything happens where a task reads its documents: a pool of bounded size is packed, what could not
close a window goes on to the next pool, and what is left at the end of a partition (less than one longest
window) is cut into windows of falling powers of two. So nothing is shuffled, memory is bounded by
the pool and the longest document, and a lost task is redone by itself from its input.

Defined results: a null or empty text is the end token alone; a null ``doc_id`` and repeated rows are packed
row by row; ties in length are taken in input order; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import stage

WINDOW, LEAST_TIER, END_ID = 4096, 512, 2
#: Tokens of a pool, and tokens of a step group.
POOL, STEP = 1 << 21, 1 << 16
#: Pieces of text whose ids a worker remembers before it starts afresh.
MEMORY = 800_000


class WordTokenizer(dict):
    """Ids of whole texts by a tokenizer that drops white space, from the ids of their blank-free runs.

    Its normalizer composes, folds white space and lower-cases characters one by one, and its splitter never joins
    characters across white space, so a text's ids are those of its runs. Special tokens come first: their strings cut the text as it
    stands, before any normalizing, and what lies between them is encoded by itself. The mapping holds the runs met so far with their ids as bytes; a
    new run of printable characters below U+0250 is split as the tokenizer's own splitter does it, and only its pieces go through the
    merges; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.model.get_added_tokens_decoder().items()}
        self.special = {x: np.array([i], np.uint32) for x, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else lambda text: [text]
        self.tokenize = self.model.model.tokenize
        self.slow_split = re.compile(r"[ \t\n\r]+").split
        self.odd = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.map = dict(enumerate(byte_characters()))

    def encode(self, text: str) -> np.ndarray:
        parts = self.cut(text)
        if len(parts) == 1:
            return self._encode(text)
        return np.concatenate([self.special[x] if k % 2 else self._encode(x) for k, x in enumerate(parts)])

    def _encode(self, text: str) -> np.ndarray:
        # ``str.split`` knows more white space than the tokenizer's; it serves where the text has none of that.
        runs = self.slow_split(text) if self.odd(text) else text.split()
        return np.frombuffer(b"".join(map(self.__getitem__, runs)), np.uint32)

    def __missing__(self, run: str) -> bytes:
        if len(self) > MEMORY:
            self.clear()
        if run.isalpha() and (run.isascii() or max(run) < "\u0250" and "\u0130" not in run):
            low = run.lower()
            ids = self._merged(low) if low == run else self[low]
        elif run.isprintable() and (run.isascii() or max(run) < "\u0250" and "\u0130" not in run):
            parts = self.parts(run.lower())
            ids = self._merged(parts[0]) if len(parts) == 1 else b"".join(map(self.__getitem__, parts))
        else:
            ids = np.array(self.model.encode(run, add_special_tokens=False).ids, np.uint32).tobytes()
        self[run] = ids
        return ids

    def _merged(self, piece: str) -> bytes:
        """A piece straight to the merges, its bytes spelled as the tokenizer spells them."""
        raw = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.map)
        return array("I", [t.id for t in self.tokenize(raw)]).tobytes()


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Packer:
    """Packs (document, length) pieces; ``out`` gets (document, start, length, sequence, offset, tier) rows.

    Free pieces wait by length, each length first in, first out; the bits of ``lengths`` say which lengths have any.
    """

    def __init__(self, window: int = WINDOW, least: int = LEAST_TIER):
        self.window = window
        self.tiers = [least]
        while self.tiers[-1] < window:
            self.tiers.append(self.tiers[-1] * 2)
        self.free: list[deque[tuple[int, int]]] = [deque() for _ in range(window)]
        self.lengths = self.held = 0
        self.out: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0

    def tier(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def waiting(self) -> set[int]:
        """Documents that have free pieces."""
        return {doc for pieces in self.free for doc, _ in pieces}

    def add(self, doc: int, n: int) -> None:
        start = 0
        while n - start >= self.window:
            self._emit([(doc, start, self.window)], self.window)
            start += self.window
        if n > start:
            self._put(n - start, doc, start)

    def _put(self, n: int, doc: int, start: int) -> None:
        self.free[n].append((doc, start))
        self.lengths |= 1 << n
        self.held += n

    def _take(self, n: int) -> tuple[int, int]:
        piece = self.free[n].popleft()
        if not self.free[n]:
            self.lengths ^= 1 << n
        self.held -= n
        return piece

    def _emit(self, pieces: list[tuple[int, int, int]], tier: int) -> None:
        at = 0
        for doc, start, n in pieces:
            self.out.append((doc, start, n, self.sequences, at, tier))
            at += n
        self.sequences += 1

    def pack(self, last: bool = False) -> None:
        """Close windows as long as the free pieces can fill one; with *last*, use them all up."""
        while self.lengths:
            tier = self.tier(self.lengths.bit_length() - 1)
            if self.held < tier:
                if not last:
                    return
                tier = 1 << (self.held.bit_length() - 1)
            pieces, gap = [], tier
            while gap:
                n = (self.lengths & ((2 << gap) - 1)).bit_length() - 1
                if n > 0:  # the longest that fits, whole
                    pieces.append((*self._take(n), n))
                    gap -= n
                else:  # the head of the shortest that doesn't
                    n = (self.lengths & -self.lengths).bit_length() - 1
                    doc, start = self._take(n)
                    pieces.append((doc, start, gap))
                    self._put(n - gap, doc, start + gap)
                    gap = 0
            self._emit(pieces, tier)


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int64()), ("place", pa.int64())]
_DDL = ", ".join(f"{name} long" for name, _ in _FIELDS)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, least: int = LEAST_TIER, step: int = STEP, pool: int = POOL, with_ids: bool = True) -> DataFrame:
    """One row a piece: where it comes from and lies, its crc32 and, if asked for, its ``ids``.

    ``step_group`` numbers, from 0 in each tier, groups of sequences of that tier with about *step* tokens each.
    """
    pieces = stage(_pieces(docs, tokenizer_path, window, least, pool, with_ids), "pieces")
    task = F.shiftright("sequence_id", 40)
    own = pieces.groupBy(task.alias("__task"), "tier").agg((F.max("place") + 1).alias("n"))
    before = Window.partitionBy("tier").orderBy("__task")
    # One row a task and tier; the groups of a tier take turns in having one sequence more.
    own = own.select("__task", "tier", (F.sum("n").over(before) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy("tier")).alias("total"))
    groups = F.ceil(F.col("total") / F.greatest(F.lit(1), F.floor(F.lit(step) / F.col("tier"))))
    group = F.expr("(first + place) * groups DIV total")
    found = pieces.withColumn("__task", task).join(F.broadcast(own.withColumn("groups", groups)), ["__task", "tier"]).withColumn("step_group", group)
    return found.select(*[c for c in pieces.columns if c not in ("place", "ids")], "step_group", *(["ids"] if with_ids else []))


def _pieces(docs: DataFrame, tokenizer_path: str, window: int, least: int, pool: int, with_ids: bool) -> DataFrame:
    """The packed pieces, with each sequence's ``place`` among those of its tier in the task."""
    schema = pa.schema(_FIELDS + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, packer = word_tokenizer(tokenizer_path), Packer(window, least)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        end = np.array([END_ID], np.uint32)
        docs_in: dict[int, tuple[int | None, np.ndarray]] = {}
        per_tier: dict[int, int] = {}
        n_docs = held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, docs_in
            done, packer.out = packer.out, []
            for i in range(0, len(done), 4096):
                yield _rows(done[i : i + 4096], docs_in, first, per_tier, schema)
            docs_in = {d: docs_in[d] for d in packer.waiting()}
            held = packer.held

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([tok.encode(text.as_py() or ""), end])
                docs_in[n_docs] = (doc_id, ids)
                packer.add(n_docs, len(ids))
                n_docs += 1
                held += len(ids)
                if held >= pool:
                    packer.pack()
                    yield from flush()
        packer.pack(last=True)
        yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _DDL + (", ids array<int>" if with_ids else ""))


def _rows(done, docs_in, first, per_tier, schema) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in schema]
    for doc, start, n, seq, offset, tier in done:
        doc_id, ids = docs_in[doc]
        part = ids[start : start + n]
        if offset == 0:
            per_tier[tier] = per_tier.get(tier, -1) + 1
        values = (doc_id, start, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids), first + seq, offset, tier, per_tier[tier])
        for c, v in zip(cols, values):
            c.append(v)
        if len(cols) > len(values):
            cols[-1].append(part.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
