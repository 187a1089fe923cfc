"""Best-fit packing: every piece has its place, and as few sequences as one-by-one best fit needs."""

import bisect
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from armscope.llm import packing
from armscope.llm.token_ids import token_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """Sequences of best fit, longest first."""
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        if at == len(gaps):
            n, free = n + 1, capacity
        else:
            free = gaps.pop(at)
        if free > length:
            bisect.insort(gaps, free - length)
    return n


def check_places(rows, capacity):
    """rows of (sequence, offset, length): gapless from 0, nothing over the capacity."""
    ends = {}
    for seq, at, length in sorted(rows):
        assert at == ends.get(seq, 0) and length > 0
        ends[seq] = at + length
    assert max(ends.values(), default=0) <= capacity
    return len(ends)


@pytest.mark.parametrize("kind", ["spread", "halves", "tiny", "equal", "long"])
def test_as_few_sequences_as_one_by_one(spark, kind):
    rnd, capacity = random.Random(5), 200
    draw = {
        "spread": lambda: min(199, int(rnd.lognormvariate(3.8, 0.9)) + 1), "halves": lambda: rnd.randint(60, 110),
        "tiny": lambda: rnd.randint(1, 9), "equal": lambda: 7, "long": lambda: rnd.randint(101, 199),
    }[kind]
    lengths = [draw() for _ in range(1500)]
    pieces = spark.createDataFrame([(i * 3 - 50, n) for i, n in enumerate(lengths)], "id bigint, length bigint")
    want = one_by_one(lengths, capacity)
    for rows in (10_000, 130):
        got = {r["id"]: (r["seq"], r["at"]) for r in packing.best_fit(pieces, capacity, rows).collect()}
        assert set(got) == {i * 3 - 50 for i in range(1500)}
        n = check_places([(*got[i * 3 - 50], length) for i, length in enumerate(lengths)], capacity)
        assert max(math.ceil(sum(lengths) / capacity), 1) <= n <= want * 1.02 + 1
        assert {s for s, _ in got.values()} == set(range(n))


def test_carry_uses_no_gap_twice():
    rows, opened = packing.carry({90: 5, 40: 3, 30: 10}, {95: 2, 60: 2, 41: 1}, 100)
    used = {}
    for length, first, count, each, size, at in rows:
        assert length * each <= size and count > 0
        spots = set(range(at, at + -(-count // each)))
        assert not spots & used.setdefault(size, set())
        used[size] |= spots
    assert len(used[95]) == 2 and opened == 3 and len(used[101]) == 3


def test_ids_equal_the_library(edges):
    rnd = random.Random(3)
    marks = [" ", "  ", "\n", " \n", "\t", "a", "B", "é", "É", "é", "́", "Σ", "1", "12", "'s", "'", "!", "?.", "梦", "▁",
             "<|endoftext|>", "<|startoftext|>", "<|", "endoftext", "ſ", "İ", "\r\n", "\x1c", "x" * 60, "\x85", "Word.", "ß"]
    texts = [t or "" for t in edges] + ["".join(rnd.choices(marks, k=rnd.randint(0, 25))) for _ in range(4000)]
    whole = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    got = token_ids(PATH).packed(texts)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in whole]


def test_pieces_of_documents(docs_of, edges):
    docs = docs_of(edges, clash=True)
    docs = docs.unionByName(docs.limit(4)).unionByName(docs.limit(2).selectExpr("cast(null AS bigint) doc_id", *docs.columns[1:]))
    rows = packing.packed(docs, PATH, capacity=512, range_rows=7).collect()
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 512)
    model = Tokenizer.from_file(PATH)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = model.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want.append((r["doc_id"], p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted((tuple(r[n] for n in names) for r in rows), key=str) == sorted(want, key=str)
    assert packing.packed(docs_of([]), PATH).count() == 0
