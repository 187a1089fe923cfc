"""Registered queries for streams over record folders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from armscope.functions.text import norm_ws
from armscope.plans import duck as d
from armscope.plans import fixtures as fx
from armscope.plans.registry import query
from armscope.session import work_dir
from armscope.streaming import records as op

RECORD = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("arm", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("db_name", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("exec_match", T.BooleanType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
    ]
)


def folder(spark, sf):
    """(records as JSON-lines files, an empty folder): every id occurs in both arms, the direct arm is older.

    Every 17th record is followed by a broken copy of its line.
    """
    base = work_dir(spark, "stream")
    preds = fx.predictions(spark, sf)
    rows = preds.select(
        "instance_id", "arm", F.when(F.col("arm") == "cot", F.col("k") * 2 + 1).otherwise(F.col("k") * 2).alias("seq"),
        "db_name", "reasoning",
        (norm_ws(F.col("predicted_cypher")) == norm_ws(F.col("reference_cypher"))).alias("exec_match"),
        F.length("question").cast("bigint").alias("prompt_tokens"),
        F.length("predicted_cypher").cast("bigint").alias("completion_tokens"),
    )
    line = F.to_json(F.struct(*[f.name for f in RECORD.fields]))
    lines = F.when(F.col("seq") % 34 < 2, F.array(line, F.substr(line, F.lit(1), F.length(line) - 2))).otherwise(F.array(line))
    for arm in ("direct", "cot"):
        part = rows.filter(F.col("arm") == arm).select(F.explode(lines).alias("value"))
        part.write.mode("append").option("maxRecordsPerFile", 50_000).text(f"{base}/in")
    return op.record_stream(spark, f"{base}/in", RECORD, files_per_batch=2), base


@query(
    "stream_first",
    f"WITH p AS ({fx.PREDICTIONS}) SELECT instance_id, arm, k * 2 AS seq, db_name, reasoning FROM p WHERE arm = 'direct'",
)
def stream_first(spark, sf):
    records, base = folder(spark, sf)
    op.stream_first(records, f"{base}/out", f"{base}/state").awaitTermination()
    return op.read_first(spark, f"{base}/out").select("instance_id", "arm", "seq", "db_name", "reasoning")


@query(
    "stream_bad_lines",
    f"WITH p AS ({fx.PREDICTIONS}) SELECT count(*) AS n FROM p WHERE (k * 2 + CASE WHEN arm = 'cot' THEN 1 ELSE 0 END) % 34 < 2",
)
def stream_bad_lines(spark, sf):
    records, base = folder(spark, sf)
    op.stream_bad_lines(records, f"{base}/bad", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/bad").agg(F.count("line").alias("n"))


@query(
    "stream_latest",
    f"WITH p AS ({fx.PREDICTIONS}) SELECT instance_id, arm, k * 2 + 1 AS seq, reasoning FROM p WHERE arm = 'cot'",
)
def stream_latest(spark, sf):
    records, base = folder(spark, sf)
    op.stream_latest(records, f"{base}/out", f"{base}/state", "seq").awaitTermination()
    return op.read_latest(spark, f"{base}/out", "seq").select("instance_id", "arm", "seq", "reasoning")


_EM = f"{d.norm_ws('predicted_cypher')} = {d.norm_ws('reference_cypher')}"


@query(
    "stream_board",
    f"""WITH p AS ({fx.PREDICTIONS}) SELECT db_name, count(*) AS n, {d.count_if("reasoning <> ''")} AS n_ok, {d.count_if("reasoning = ''")} AS n_fail,
  CAST(sum(len(question)) AS BIGINT) AS prompt_tokens, CAST(sum(len(predicted_cypher)) AS BIGINT) AS completion_tokens,
  {d.count_if(_EM)} AS matches, {d.rate(_EM)} AS em FROM p GROUP BY db_name""",
)
def stream_board(spark, sf):
    records, base = folder(spark, sf)
    op.stream_board(records, f"{base}/out", f"{base}/state").awaitTermination()
    return op.read_board(spark, f"{base}/out")
