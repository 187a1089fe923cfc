from pyspark.sql import functions as F
from pyspark.sql import types as T

from armscope.sources import graph_schema as gs
from armscope.sources import records
from armscope.streaming import records as streams

REC = T.StructType([T.StructField("instance_id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("reasoning", T.StringType())])


def test_bad_lines_are_kept_and_counted(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"instance_id": "1", "n": 1}\n{broken\n{"instance_id": "2", "n": "x"}\n')
    rows = records.read_records(spark, str(tmp_path), REC)
    counts = records.record_counts(rows).first()
    assert (counts["n_good"], counts["n_bad"]) == (1, 2)
    assert [r["instance_id"] for r in records.good_records(rows).collect()] == ["1"]


def test_csv_first_file_wins(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,nl,num_nodes\n1,"say ""hi"", twice\nnow",2\n1,again,3\n')
    (tmp_path / "b.csv").write_text("id,nl,num_nodes\n1,other,5\n2,two,7\n")
    rows = records.read_split_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ["id", "nl", "num_nodes"])
    got = {r["id"]: (r["nl"], r["num_nodes"]) for r in rows.collect()}
    assert got == {"1": ('say "hi", twice\nnow', 2), "2": ("two", 7)}


def test_split_priority(spark):
    lists = spark.createDataFrame([("compositional", "1"), ("iid", "1"), ("compositional", "2"), ("other", "3")], "split string, id string")
    rows = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    assert {r["id"]: r["split"] for r in records.label_split(rows, lists).collect()} == {"1": "iid", "2": "compositional", "3": "unknown"}


def test_pending_and_latest(spark):
    work = spark.createDataFrame([("1",), ("2",), ("3",)], "instance_id string")
    done = spark.createDataFrame([("1", "r"), ("2", ""), ("2", " ")], "instance_id string, reasoning string")
    assert sorted(r[0] for r in records.pending(work, done).collect()) == ["3"]
    assert sorted(r[0] for r in records.pending(work, done, retry_failed=True).collect()) == ["2", "3"]
    log = spark.createDataFrame([("1", 1, "a"), ("1", 3, "c"), ("1", 2, "b")], "id string, t int, v string")
    assert records.latest_per_id(log, "id", F.col("t")).first()["v"] == "c"
    assert records.first_per_id(log, "id", F.col("t")).first()["v"] == "a"


def test_a_long_schema_is_one_text_in_order(spark):
    lines = spark.range(5001).select(F.lit("g").alias("graph_id"), F.lit(1).alias("sec"), F.col("id").alias("pos"), F.lit(0).alias("sub"), F.col("id").cast("string").alias("line"))
    rows = gs.join_lines(lines, "graph_id", ["sec", "pos", "sub"]).collect()
    assert len(rows) == 1 and rows[0]["schema_text"].split("\n") == [str(i) for i in range(5001)]


def test_stream_resumes_without_repeats(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"instance_id": "1", "n": 1}\n{"instance_id": "2", "n": 1}\n{"instance_id": "1", "n": 2}\n{"instance_id": "1", "n\n')
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def go():
        streams.stream_first(streams.record_stream(spark, str(src), REC), out, state).awaitTermination()
        return sorted((r["instance_id"], r["n"]) for r in streams.read_first(spark, out).collect())

    assert go() == [("1", 1), ("2", 1)]
    (src / "b.json").write_text('{"instance_id": "2", "n": 9}\n{"instance_id": "3", "n": 1}\n')
    assert go() == [("1", 1), ("2", 1), ("3", 1)]


def test_stream_latest_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for name, text in (("a", '{"instance_id": "1", "n": 1}\n{"instance_id": "1", "n": 5}\n'), ("b", '{"instance_id": "1", "n": 3}\n{"instance_id": "2", "n": 3}\n')):
        (src / f"{name}.json").write_text(text)
        streams.stream_latest(streams.record_stream(spark, str(src), REC), out, state, "n").awaitTermination()
    assert {r["instance_id"]: r["n"] for r in streams.read_latest(spark, out, "n").collect()} == {"1": 5, "2": 3}


def test_stream_board_adds_each_batch_once_and_keeps_no_other_state(spark, tmp_path):
    """a batch writes few files; a resumed and a replayed batch count once."""
    rec = T.StructType([
        *[T.StructField(c, T.StringType()) for c in ("db_name", "reasoning")], T.StructField("exec_match", T.BooleanType()),
        *[T.StructField(c, T.LongType()) for c in ("prompt_tokens", "completion_tokens")],
    ])
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()

    def run():
        streams.stream_board(streams.record_stream(spark, str(src), rec, files_per_batch=1), out, state).awaitTermination()
        return {r["db_name"]: tuple(r)[1:] for r in streams.read_board(spark, out).collect()}

    (src / "a.json").write_text('{"db_name": "x", "reasoning": "r", "exec_match": true, "prompt_tokens": 3}\n{broken\n')
    (src / "b.json").write_text('{"db_name": "x", "reasoning": "", "completion_tokens": 4}\n{"reasoning": "r", "exec_match": false}\n')
    first = {"x": (2, 1, 1, 3, 4, 1, 0.5), None: (1, 1, 0, 0, 0, 0, 0.0)}
    assert run() == first and run() == first
    (src / "c.json").write_text('{"db_name": "x", "reasoning": "r", "exec_match": true, "prompt_tokens": 1}\n')
    second = first | {"x": (3, 2, 1, 4, 4, 2, 2 / 3)}
    assert run() == second
    (tmp_path / "state" / "commits" / "2").unlink()
    for crc in (tmp_path / "state" / "commits").glob(".2.crc"):
        crc.unlink()
    assert run() == second
    assert not (tmp_path / "state" / "state").exists()
    assert all(len(list(p.glob("*.parquet"))) < 10 for p in (tmp_path / "out").glob("batch=*"))
