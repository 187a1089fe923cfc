"""Plans and results under skew: one key holds a third of all rows."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  loads the queries
from armscope.plans import registry
from armscope.operators import pairing, results, voting
from armscope.sources import records

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


LAZY = sorted(
    n for n in registry.QUERIES
    if not n.startswith("stream_") and n not in ("read_records", "record_counts", "read_split_csv", "write_metrics_table")
)


@pytest.mark.parametrize("name", LAZY)
def test_no_cartesian_product_and_no_row_udf(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if name != "bootstrap_counts_labels":
        assert "InPandas" not in text and "ArrowEvalPython" not in text


def test_columns_are_pruned_and_filters_pushed(spark):
    text = plan(registry.QUERIES["latest_per_id"](spark, SF))
    assert "o_totalprice" not in text.split("ReadSchema")[1].split("\n")[0]


def hot(spark, n=30_000):
    """A third of the rows under one key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("instance_id"),
        F.col("id").alias("cand_idx"), (F.col("id") % 5).cast("string").alias("candidate"),
    )


def test_hot_key_vote_and_latest(spark):
    rows = hot(spark)
    vote = voting.string_vote(rows).filter(F.col("instance_id") == "hot").first()
    assert vote["voted"] == "0" and vote["n_candidates"] == 10_000
    last = records.latest_per_id(rows, "instance_id", F.col("cand_idx")).filter(F.col("instance_id") == "hot").first()
    assert last["cand_idx"] == 29_997
    for df in (voting.string_vote(rows), records.latest_per_id(rows, "instance_id", F.col("cand_idx"))):
        assert "Window" not in plan(df)


def test_hot_run_fingerprint_needs_no_list(spark):
    rows = hot(spark).select("instance_id", F.array(F.struct(F.lit("a").alias("name"), F.col("candidate").alias("value"))).alias("cols"))
    fps = results.fingerprints(rows, ["instance_id"], results.named_row(F.col("cols")))
    again = results.fingerprints(rows.repartition(5), ["instance_id"], results.named_row(F.col("cols")))
    assert "collect_list" not in plan(fps)
    one, two = (x.filter(F.col("instance_id") == "hot").first() for x in (fps, again))
    assert one == two and one["n_rows"] == 10_000


def test_hot_text_leakage_counts_all_rows(spark):
    rows = hot(spark).select(F.col("cand_idx").alias("id"), F.col("instance_id").alias("question"), F.lit("q").alias("query"))
    got = {r["level"]: (r["n_test"], r["n_seen"]) for r in pairing.leakage_audit(
        rows.filter("id < 3"), rows.filter("id >= 3"), "id", "question", "query").collect()}
    assert got["question"] == (29_997, 9_999) and got["id"] == (29_997, 0)


def test_top_k_per_source_is_limited_before_the_shuffle(spark):
    df = hot(spark).withColumnRenamed("instance_id", "src")
    assert "WindowGroupLimit" in plan(voting.pilot_by_source(df, "cand_idx", "src", 50))
