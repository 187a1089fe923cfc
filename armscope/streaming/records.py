"""Append-only record folders as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from armscope.operators.scoring import ratio
from armscope.sources.records import CORRUPT, first_per_id, latest_per_id

#: Where a record stands: file time, file, block in it.
PLACE = {"_time": "file_modification_time", "_path": "file_path", "_block": "file_block_start"}


def record_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000
) -> DataFrame:
    """New JSON-lines files of a folder, with the place of every line; a broken line keeps its text."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = (
        spark.readStream.schema(full)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .json(folder)
    )
    return lines.select("*", *[F.col(f"_metadata.{m}").alias(c) for c, m in PLACE.items()])


def _batches(records: DataFrame, checkpoint: str, reduce, out: str) -> StreamingQuery:
    """Every micro-batch reduced and stored under its number, so a replayed batch replaces itself."""

    def store(batch: DataFrame, batch_id: int) -> None:
        good = batch.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
        # A block is read by one partition, where this number follows its lines.
        reduce(good.withColumn("_row", F.monotonically_increasing_id())).write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}"
        )

    return (
        records.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _place() -> Column:
    return F.struct(*PLACE, "_row")


def stream_first(records: DataFrame, out: str, checkpoint: str, id_col: str = "instance_id") -> StreamingQuery:
    """One row per id: the first record of an id wins, by file time, file and place in it.

    Broken lines are left out.  A micro-batch is reduced to its first record per id;
    ``read_first`` merges the batches, so the result does not depend on how
    files fall into batches or on restarts.
    """
    return _batches(records, checkpoint, lambda good: first_per_id(good, id_col, _place()), out)


def read_first(spark: SparkSession, out: str, id_col: str = "instance_id") -> DataFrame:
    kept = spark.read.parquet(out).drop("batch")
    return first_per_id(kept, id_col, _place()).drop(*PLACE, "_row")


def stream_latest(
    records: DataFrame, out: str, checkpoint: str, order: str, id_col: str = "instance_id"
) -> StreamingQuery:
    """One row per id: the record with the largest ``order`` wins; ``read_latest`` merges the batches."""
    return _batches(records, checkpoint, lambda good: latest_per_id(good, id_col, F.struct(order, _place())), out)


def read_latest(spark: SparkSession, out: str, order: str, id_col: str = "instance_id") -> DataFrame:
    kept = spark.read.parquet(out).drop("batch")
    return latest_per_id(kept, id_col, F.struct(order, _place())).drop(*PLACE, "_row")


def merge_batches(merged: DataFrame, out: str) -> None:
    """Write what ``read_first`` or ``read_latest`` gives, so that a later read need not go through the history."""
    merged.write.mode("overwrite").parquet(out)


def stream_bad_lines(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The broken lines, with their file, apart from the records.

    All fields are touched, because a line is only judged by the fields read.
    """
    fields = [c for c in records.columns if c != CORRUPT and c not in PLACE]
    read = F.coalesce(F.length(F.to_json(F.struct(*fields))), F.lit(0)) >= 0
    return (
        records.filter(F.col(CORRUPT).isNotNull() & read).select(F.col(CORRUPT).alias("line"), F.col("_path").alias("file"))
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def stream_board(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running board per database: ok and failed rows, tokens, matches and EM.

    Broken lines are not counted.  The board has one row per database; each batch writes it whole, under the
    batch number, and the highest number is the current board.  A batch adds its own counts to the board of the
    batch before, which it only reads: a replayed batch replaces itself, and there is no other state to commit.
    """
    ok = F.coalesce(F.col("reasoning"), F.lit("")) != ""
    counts = {
        "n": F.count("*"),
        "n_ok": F.count(F.when(ok, 1)),
        "n_fail": F.count(F.when(~ok, 1)),
        "prompt_tokens": F.sum(F.coalesce("prompt_tokens", F.lit(0))),
        "completion_tokens": F.sum(F.coalesce("completion_tokens", F.lit(0))),
        "matches": F.count(F.when(F.col("exec_match"), 1)),
    }

    def store(batch: DataFrame, batch_id: int) -> None:
        good = batch.filter(F.col(CORRUPT).isNull())
        board = good.groupBy("db_name").agg(*[c.alias(name) for name, c in counts.items()])
        if batch_id:
            before = batch.sparkSession.read.schema(board.schema).parquet(f"{out}/batch={batch_id - 1}")
            board = board.unionByName(before).groupBy("db_name").agg(*[F.sum(name).alias(name) for name in counts])
        board.withColumn("em", ratio(F.col("matches"), F.col("n"))).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        records.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_board(spark: SparkSession, out: str) -> DataFrame:
    """The board of the last finished batch."""
    boards = spark.read.parquet(out)
    last = boards.agg(F.max("batch")).scalar()
    return boards.filter(F.col("batch") == last).drop("batch")
