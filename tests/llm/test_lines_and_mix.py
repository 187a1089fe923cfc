"""Site-relative line dedup and raking."""

import math

import pytest
from pyspark.sql import functions as F

from armscope.llm import line_dedup, mixing


def test_boilerplate_is_relative_to_the_host(docs_of):
    a = [(f"menu\nbody {i}\n menu\t\n\nend {i}", "en", "a") for i in range(20)]
    b = [(f"menu\nother {i}" if i < 10 else f"other {i}", "en", "b") for i in range(300)]
    out = line_dedup.drop_boilerplate(docs_of(a + b, clash=True)).orderBy("doc_id").collect()
    assert out[0]["text"] == "body 0\n\nend 0" and out[0]["n_lines_dropped"] == 2
    assert out[20]["text"] == "menu\nother 0" and out[20]["n_lines_dropped"] == 0


def test_edges(docs_of, edges):
    docs = docs_of(edges, clash=True)
    out = line_dedup.drop_boilerplate(docs, min_pages=2, ratio=0.1)
    assert out.columns == [*docs.columns, "n_lines_dropped"]
    rows = out.orderBy("doc_id").collect()
    assert [r["text"] for r in rows[:4]] == [None, "", " ", "\n\n"]
    assert rows[4]["text"] == "" and rows[4]["n_lines_dropped"] == 1  # "a" stands on two of twelve pages
    assert rows[11]["text"] == edges[11]  # a line counts once a page
    assert line_dedup.drop_boilerplate(docs_of([])).count() == 0


def test_small_hosts_lose_their_boilerplate_too(docs_of):
    rows = [(f"menu\nbody {h} {i}", "en", f"h{h}") for h, n in ((0, 1), (1, 2), (2, 3), (3, 9), (4, 10)) for i in range(n)]
    out = line_dedup.drop_boilerplate(docs_of(rows)).groupBy("source").agg(F.max("n_lines_dropped").alias("n")).collect()
    assert {r["source"]: r["n"] for r in out} == {"h0": 0, "h1": 0, "h2": 1, "h3": 1, "h4": 1}


def test_null_host_is_a_host(docs_of):
    docs = docs_of([("x\ny", "en", None)] * 12)
    assert {r["text"] for r in line_dedup.drop_boilerplate(docs).collect()} == {""}


def test_raking_meets_the_margins(spark):
    cells = spark.createDataFrame(
        [("a", "en", "p", 500), ("a", "de", "p", 100), ("b", "en", "q", 50), ("b", "de", "p", 80), ("b", "de", "q", 20)],
        "source string, lang string, topic string, tokens bigint",
    )
    want = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.55, "de": 0.45}, "topic": {"p": 0.6, "q": 0.4}}
    goals = {k: spark.createDataFrame(list(v.items()), f"{k} string, target double") for k, v in want.items()}
    out = mixing.rake(cells, goals, sweeps=12).collect()
    for by, target in want.items():
        for value, share in target.items():
            assert math.isclose(sum(r["w"] for r in out if r[by] == value), share, abs_tol=1e-3)
    assert max(r["rate"] for r in out) == 1.0
    per = {(r["source"], r["lang"], r["topic"]): r["w"] / r["tokens"] / r["rate"] for r in out}
    assert max(per.values()) - min(per.values()) < 1e-12


def test_raking_ends_at_the_tolerance_and_says_when_it_cannot(spark):
    rows = [("a", "en", "p", 900), ("a", "de", "p", 1), ("b", "en", "p", 3), ("b", "de", "p", 96)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")

    def goals(**want):
        return {k: spark.createDataFrame(list(v.items()), f"{k} string, target double") for k, v in want.items()}

    fair = goals(source={"a": 0.3, "b": 0.7}, lang={"en": 0.6, "de": 0.4})
    out = mixing.rake(cells, fair, sweeps=3, tolerance=1e-9).collect()
    for by, want in (("source", {"a": 0.3, "b": 0.7}), ("lang", {"en": 0.6, "de": 0.4})):
        for value, share in want.items():
            assert math.isclose(sum(r["w"] for r in out if r[by] == value), share, abs_tol=1e-9)
    with pytest.raises(ValueError):  # no cell has this source
        mixing.rake(cells, goals(source={"a": 0.5, "c": 0.5}))
    with pytest.raises(ValueError):  # all of b is en, all of a is de, and the shares differ
        mixing.rake(
            cells.filter("tokens IN (1, 3)"), goals(source={"a": 0.5, "b": 0.5}, lang={"en": 0.1, "de": 0.9}), sweeps=3
        )


def test_raking_in_tables_is_raking_in_one_task(spark):
    rows = [("a", "en", "p", 900), ("a", "de", "q", 1), ("b", "en", "p", 3), ("b", "de", "q", 96), ("b", "en", "q", 0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    want = {"source": {"a": 0.3, "b": 0.7}, "lang": {"en": 0.6, "de": 0.4}}
    goals = {k: spark.createDataFrame(list(v.items()), f"{k} string, target double") for k, v in want.items()}
    found = []
    for task_rows in (0, 1000):
        out = mixing.rake(cells.drop("topic"), goals, sweeps=2, task_rows=task_rows).collect()
        found.append(sorted((r["source"], r["lang"], r["tokens"], r["w"], r["rate"]) for r in out))
    assert len(found[0]) == len(found[1]) == 5
    for x, y in zip(*found):
        assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], abs=1e-12)
    for task_rows in (0, 1000):
        with pytest.raises(ValueError):
            clash = spark.createDataFrame([("a", 0.5), ("c", 0.5)], "source string, target double")
            mixing.rake(cells.drop("topic"), {"source": clash}, task_rows=task_rows)


def test_mixed_edges(docs_of, edges):
    rows = [(t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s") for i, t in enumerate(edges)]
    docs = docs_of(rows, clash=True)
    out = mixing.mixed(docs)
    got = out.collect()
    assert len(got) == len(rows) and all(0.0 <= r["rate"] <= 1.0 for r in got)
    again = {r["doc_id"]: r["drawn"] for r in mixing.mixed(docs).collect()}
    assert again == {r["doc_id"]: r["drawn"] for r in got}
    assert mixing.mixed(docs_of([])).count() == 0


def test_drawn_tokens_follow_the_rates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = mixing.mixed(docs).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("rate")).alias("expected"), F.sum(F.when(F.col("drawn"), F.col("tokens"))).alias("got")
    ).collect()
    total, drawn = sum(r["expected"] for r in out), sum(r["got"] for r in out)
    assert all(abs(r["expected"] / total - r["got"] / drawn) < 0.03 for r in out)
