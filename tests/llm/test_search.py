"""Pipelined lexical search against a brute-force ranking."""

import math
import re
from collections import Counter

import pytest

from armscope.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return Counter(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))


def brute(items, docs, top):
    bags = [terms_of(t) for _, t in docs]
    n_docs, n_terms = sum(1 for b in bags if b), sum(sum(b.values()) for b in bags)
    df = Counter(x for b in bags for x in b)
    out = []
    for item, text in items:
        found = []
        for (doc, _), bag in zip(docs, bags):
            n, score = sum(bag.values()), 0
            for x in terms_of(text):
                if bag[x]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    score += w * (10**9 * bag[x] // (1000 * bag[x] + 20 * (50 + 50 * n * n_docs // n_terms)))
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, r + 1, doc, -score) for r, (score, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def test_terms_fold_ascii_only_and_are_cut_in_steps(monkeypatch):
    text = "The-the THE É é 梦x_y z 12\x7f3"
    assert {k.decode(): v for k, v in search.terms(text.encode()).items()} == dict(terms_of(text))
    long = "Alpha beta, " * 5000 + "tail"
    monkeypatch.setattr(search, "_STEP", 1000)
    assert {k.decode(): v for k, v in search.terms(long.encode()).items()} == dict(terms_of(long))


@pytest.mark.parametrize("owners,bundle,bits", [(1, 256, 10), (3, 256, 10), (4, 2, 2)])
def test_same_as_brute_force(spark, docs_of, edges, owners, bundle, bits):
    rows = edges + [f"word{i % 7} word{i % 5} the word{i} " * (1 + i % 3) for i in range(120)] + ["the same text"] * 90
    docs = docs_of(rows, clash=True)
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.filter("doc_id > 200").selectExpr("cast(null AS bigint) doc_id", *docs.columns[1:]))
    asked = ["the same text", "word3 word1 word99 nowhere", None, "", "THE, cat", "the the the", "text x"]
    items = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(asked)], "item_id bigint, text string, score string")
    got = search.ranked(items, docs, top=20, owners=owners, bundle=bundle, block_bits=bits)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    have = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r[0], r[1]) for r in items.collect()], have, 20)


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert search.ranked(items, docs_of([])).count() == 0
    assert search.ranked(items.limit(0), docs_of(["a"])).count() == 0
