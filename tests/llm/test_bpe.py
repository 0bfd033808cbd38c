import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from loomgraph.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(4)
    pool = "aeiou tnrs ÄÖüéñ中文字😀́‍\n\t  '<|>0123'll's#\x00\x1c▁­"
    fixed = ["", " ", "  \n\n ", "<|endoftext|>", "▁▁ a▁b", "\x00\x01", "a" * 5000, "don't we'll I'VE", "﻿x", "é" * 700, "ſ ß İ"]
    return fixed + ["".join(rng.choice(pool) for _ in range(rng.randrange(300))) for _ in range(300)]


def test_ids_equal_the_library(codec, library):
    for t in texts():
        ids = codec.encode(t)
        assert ids == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_digests_and_edge_cases(spark, library, sf):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(1, " ", "x"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digests(docs, PATH, P.PATTERN).collect()), key=str)
    expected = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    assert bpe.digests(docs.limit(0), PATH, P.PATTERN).collect() == []


def test_round_trip_of_tables(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None)], "doc_id long, text string")
    enc = bpe.encode(docs, PATH, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in enc.collect()} == {1: b"alpha beta", 2: b""}
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(enc, PATH, P.PATTERN).collect()} == {1: b"alpha beta", 2: b""}
