"""Counts of the quality rules against brute force, and EM against texts of known kind."""

import re

from armscope.llm import quality_rules as rules

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = SPLIT.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPLIT.search(x)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts_on_edges(docs_of, edges):
    texts = edges + ["a b c d e a b c d e f", "a a a a a a a", "x # $ y\n#\n x # $ y", "a\x1cb c\x0bd\x85e f"]
    out = rules.with_features(docs_of(texts, clash=True), out="counts").orderBy("doc_id").collect()
    for t, r in zip(texts, out):
        assert tuple(r["counts"][f] for f in FIELDS) == brute(t), t[:40] if t else t


def test_counts_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in rules.with_features(docs).collect():
        assert tuple(r["_f"][f] for f in FIELDS) == brute(r["text"])


def test_verdicts_follow_the_labels(spark):
    sf = "/root/testdata/sf0.1"
    judged = rules.judged(spark.read.parquet(f"{sf}/documents.parquet"), keep=["doc_id"])
    rows = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed").select("quality", "kept").collect()
    bad, good = [r["kept"] for r in rows if r["quality"] == 0], [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.05


def test_edges_and_empty(docs_of, edges):
    docs = docs_of(edges, clash=True)
    rows = rules.judged(docs).orderBy("doc_id").collect()
    assert len(rows) == len(edges)
    for t, r in zip(edges, rows):
        n, _, _, _, repeated = brute(t)
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n)
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["posterior"] <= 1
    assert rules.judged(docs_of([])).count() == 0


def test_em_learns_from_agreement(spark):
    """Two rules that agree on bad texts are trusted; one that says bad at random is not."""
    names = [rules.Rule(n, None, None) for n in "abc"]
    patterns = [([1, 1, 1], 700), ([1, 1, 0], 150), ([0, 0, 1], 100), ([0, 0, 0], 20), ([2, 2, 2], 5)]
    model = rules.fit(spark.createDataFrame(patterns, "votes array<int>, n bigint"), tuple(names))
    assert model.log_odds("a", 0) < -3 and abs(model.log_odds("c", 0)) < 1
    assert 0.8 < model.prior < 0.95
