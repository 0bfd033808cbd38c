import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import packing

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(rows, docs, library):
    """Every id lies in one piece; sequences are gapless, and full at a power of two."""
    want = defaultdict(list)
    for d, text in docs:
        want[d].append(np.array([*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert any(r.doc_tokens == len(w) and zlib.crc32(w[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for w in want[r.doc_id])
    for d, ws in want.items():
        assert sum(r.length for r in by_doc[d]) == sum(map(len, ws))
        if len(ws) == 1:
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0


def test_tokenizer_equals_the_library(library):
    rng = random.Random(1)
    pool = "aeiouTNRS ÄÖÜéñ中文😀é‍\n\t  \x0b\x0c\x85\x1c'll's#ſΣİ"
    tok = packing.WordTokenizer(PATH)
    ends = ["hello <|endoftext|> world", "<|endoftext|>", "a<|startoftext|>b<|endoftext|>", "<|endoftext|><|endoftext|>", "e<|endoftext|>\u0301", "<|ENDOFTEXT|> <|endoftext| <|<|endoftext|>|>", "\x85<|startoftext|>\x1c"]
    texts = ["", " ", *ends, "ΑΣ ΑΣ.", "é"] + ["".join(rng.choice(pool) for _ in range(rng.randrange(200))) for _ in range(500)]
    for t in texts:
        assert tok.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_pieces_of_a_corpus(spark, library):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma.", "delta42", "x"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 30, 400, 3000, 9000]))) for i in range(150)] + [(500, None), (501, ""), (7, "again"), (None, "no id")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, tier long").repartition(3)
    check(packing.pack(df, PATH, with_ids=False).collect(), docs, library)
    rows = packing.pack(df, PATH, pool=20_000).collect()
    check(rows, docs, library)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_step_groups_are_balanced_over_tasks(spark):
    """Many small partitions: the groups of a tier still differ by one sequence at most, and are numbered without a gap."""
    docs = spark.createDataFrame([(i, "x y z " * (i * 37 % 900), "clash") for i in range(400)], "doc_id long, text string, place string").repartition(9)
    groups = defaultdict(lambda: defaultdict(set))
    for r in packing.pack(docs, PATH, step=1 << 14, with_ids=False).collect():
        groups[r.tier][r.step_group].add(r.sequence_id)
    assert len(groups[4096]) > 2
    for tier, own in groups.items():
        sizes = [len(own[g]) for g in range(len(own))]
        assert max(sizes) - min(sizes) <= 1 and max(sizes) <= max(1, (1 << 14) // tier)


def test_exact_powers_and_empty(spark, library):
    docs = [(i, " ".join(["x"] * n)) for i, n in enumerate([4095, 4096, 8191, 511, 512, 0])]
    check(packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect(), docs, library)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
