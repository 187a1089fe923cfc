"""Reading, resuming and writing record tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armscope.functions.text import is_blank

CORRUPT = "_bad_line"


def read_records(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """JSON lines as a typed table; unreadable lines keep their text in ``_bad_line``."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(full)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def good_records(records: DataFrame) -> DataFrame:
    return records.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def record_counts(records: DataFrame) -> DataFrame:
    """One row: readable and rejected lines.

    All fields are touched, because a line is only judged by the fields read.
    """
    fields = [c for c in records.columns if c != CORRUPT]
    bad = F.col(CORRUPT).isNotNull()
    whole = F.length(F.to_json(F.struct(*fields))) > 0
    return records.agg(
        F.count(F.when(~bad & whole, 1)).alias("n_good"), F.count(F.when(bad, 1)).alias("n_bad")
    )


def read_split_csv(
    spark: SparkSession,
    paths: Sequence[str],
    columns: Sequence[str],
    id_col: str = "id",
    int_cols: Sequence[str] = ("num_nodes",),
) -> DataFrame:
    """Several CSV files as one table; an id found twice keeps its first row.

    First means: path in the given order, then file, then place in the file.  A
    quoted field may hold line breaks, so a file is read by one task: pass many
    files rather than a huge one.
    """
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    merged = None
    for rank, path in enumerate(paths):
        part = (
            spark.read.schema(schema)
            .option("header", True)
            .option("multiLine", True)
            .option("quote", '"')
            .option("escape", '"')
            .csv(path)
            .select("*", F.lit(rank).alias("_rank"), F.col("_metadata.file_path").alias("_file"),
                    F.col("_metadata.file_block_start").alias("_block"))
        )
        merged = part if merged is None else merged.unionByName(part)
    # Rows of one block are in one partition, where this number follows their order.
    ranked = merged.withColumn("_row", F.monotonically_increasing_id())
    return first_per_id(ranked, id_col, F.struct("_rank", "_file", "_block", "_row")).select(
        *[F.col(c).cast("int").alias(c) if c in int_cols else F.col(c) for c in columns]
    )


def first_per_id(rows: DataFrame, id_col: str, order: Column) -> DataFrame:
    """The row with the smallest ``order`` of every id (combined before the shuffle)."""
    keep = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(id_col).alias("_k")).agg(
        F.min_by(keep, order).alias("_r")
    ).select("_r.*")


def latest_per_id(rows: DataFrame, id_col: str, order: Column) -> DataFrame:
    """The row with the largest ``order`` of every id: the last record wins."""
    keep = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(id_col).alias("_k")).agg(
        F.max_by(keep, order).alias("_r")
    ).select("_r.*")


def pending(
    work: DataFrame, done: DataFrame, id_col: str = "instance_id", retry_failed: bool = False
) -> DataFrame:
    """Work rows not done yet; with ``retry_failed`` a done row without reasoning counts as open."""
    finished = done.filter(~is_blank(F.col("reasoning"))) if retry_failed else done
    return work.join(finished.select(id_col).distinct(), id_col, "left_anti")


def label_split(
    rows: DataFrame,
    id_lists: DataFrame,
    id_col: str = "id",
    priority: Sequence[str] = ("iid", "compositional"),
) -> DataFrame:
    """Add ``split``: the first list in ``priority`` that holds the id, else 'unknown'."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("split"))
    best = (
        id_lists.filter(F.col("split").isin(*priority))
        .groupBy(F.col("id").alias(id_col))
        .agg(F.min_by("split", rank).alias("split"))
    )
    return rows.join(best, id_col, "left").withColumn(
        "split", F.coalesce("split", F.lit("unknown"))
    )


def write_table(board: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a board or any operator result as files."""
    board.write.mode("overwrite").format(fmt).save(path)


def nested_metrics(board: DataFrame, group_col: str, metrics: Sequence[str]) -> DataFrame:
    """One row with the overall metrics and ``per_group`` as a map.

    The board holds one row per group and its overall row (group null), so it
    is as small as the list of groups.
    """
    values = F.struct(*metrics)
    groups = F.map_from_entries(
        F.array_sort(
            F.collect_list(
                F.when(F.col(group_col).isNotNull(), F.struct(F.col(group_col), values))
            )
        )
    )
    overall = [
        F.max(F.when(F.col(group_col).isNull(), F.col(m))).alias(m) for m in metrics
    ]
    return board.agg(*overall, groups.alias("per_group"))


def write_nested_metrics(board: DataFrame, group_col: str, metrics: Sequence[str], path: str) -> None:
    """The nested form as a JSON file: the overall metrics, and one object per group under ``per_group``."""
    nested_metrics(board, group_col, metrics).coalesce(1).write.mode("overwrite").json(path)
