"""A corpus pipeline: rules, line dedup, near-dedup, mixing, pieces.

Every stage works on all rows that the one before kept, is written as Parquet
and read again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armscope.llm import line_dedup, mixing, near_text, pieces, quality_rules
from armscope.llm.common import shared_dir, table
from armscope.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or whose votes speak against them go."""
    return quality_rules.judged(docs).filter("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; a document of nothing else goes with them."""
    out = line_dedup.drop_boilerplate(docs)
    changed = F.col("n_lines_dropped") > 0
    out = out.filter(~changed | (F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")) != ""))
    n_chars = F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the row with the smallest id stays."""
    return near_text.keep_first(docs).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics get their target shares of tokens."""
    return mixing.mixed(docs).filter("drawn").select(*COLUMNS)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their best segmentation, checked by decoding, and the next best ones."""
    out = pieces.with_pieces(docs, tokenizer_file("piece_bpe_32k.model"))
    return out.select(*COLUMNS, *pieces.ADDED)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_stage),
    ("mixing to target weights", mix_stage),
    ("piece encoding", piece_stage),
]

#: Rules fitted by EM, fingerprints and the piece lattice are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each table between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
