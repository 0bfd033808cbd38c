"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

A rank file lists byte strings with their merge ranks. The model's pieces are those byte strings
with each byte mapped to one printable character, scored by negative rank, with an identity
normalizer: sentencepiece then merges the adjacent pair of least rank first, as a byte-level BPE does. Texts
are split into pre-tokens by a pattern, each pre-token is encoded by itself, and ids are decoded by the
inverse of the byte mapping.

Defined results: a null text is encoded as an empty one (no ids, empty bytes); texts are taken whole
whatever their length; repeated rows and null ``doc_id`` are kept row by row; an empty table gives no rows;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens that a worker remembers before it starts afresh.
MEMORY = 200_000


def byte_characters() -> list[str]:
    """A printable character for each byte: its own where it has one, else one from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(own) else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """The model file: piece 0 is the unknown piece that sentencepiece demands, piece r+1 has rank r."""
    to_char = byte_characters()
    ordered = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown = 1, 2
    out = bytearray(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    for token, rank in ordered:
        piece = "".join(to_char[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, normal))
    bpe = 2
    trainer = _field(3, bpe) + _field(4, len(ordered) + 1) + _field(40, 0) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class Codec:
    """Encodes and decodes whole texts; remembers the pre-tokens that it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes | None = None):
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model or serialize_model(ranks))
        self.map = dict(enumerate(byte_characters()))
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        known = self.known
        new = list({p for p in pieces if p not in known})
        if new:
            if len(known) > MEMORY:
                known.clear()
                new = list(set(pieces))
            mapped = [p.encode().decode("latin-1").translate(self.map) for p in new]
            for p, ids in zip(new, self.model.encode(mapped, num_threads=1)):
                known[p] = tuple(i - 1 for i in ids)
        out: list[int] = []
        for p in pieces:
            out += known[p]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (the bytes that decoding the ids gives) of each document.

    *ranks_path* must be readable on the executors, as an installed vocabulary is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for doc_ids, ids in _encoded(c, batches):
            decoded = [c.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``doc_id`` and ``decoded`` of a table that has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            out = [c.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), ids).mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: the encoding in short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for doc_ids, ids in _encoded(c, batches):
            sums = [(len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(c.decode(x)).hexdigest()) for x in ids]
            n, a, b = zip(*sums)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


#: Characters of text that are encoded before results leave the worker.
_CHUNK = 4 << 20


def _encoded(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[list[int]]]]:
    for batch in batches:
        start, size, ids = 0, 0, []
        for i, text in enumerate(batch.column(1)):
            text = text.as_py() or ""
            ids.append(c.encode(text))
            size += len(text)
            if size >= _CHUNK:
                yield batch.column(0).slice(start, len(ids)), ids
                start, size, ids = i + 1, 0, []
        if ids:
            yield batch.column(0).slice(start, len(ids)), ids
