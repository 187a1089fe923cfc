"""Reading inputs and writing intermediate tables, shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a regular expression class: space and the controls 9 to 13.
BLANKS = r"[\x20\x09-\x0D]"
#: The same characters, for translate().
BLANK_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets its own.

    The driver and all executors must see this folder, so a cluster has to
    name it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='armscope-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Whether the shuffles of a query are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_and_clean(df: DataFrame, path: str) -> None:
    """``df`` as Parquet; its shuffles, which nothing reads again, are removed after the write."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back.

    It cuts the lineage: a lost executor costs a task of the reading stage,
    not the work behind the table.  The shuffles of the write go when it ends,
    and not only when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    write_and_clean(df, path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """The table of an iteration: every round is written anew, and the round before the last is deleted.

    Written files give the planner true sizes; a checkpointed frame would keep
    the estimate of its plan, which joins multiply from round to round.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", []

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        write_and_clean(df, path)
        self.paths.append(path)
        if len(self.paths) > 2:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[-3])
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text: runs of characters other than ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS + "+"), lambda w: w != "")


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` starts with, for columns made on the way."""
    prefix = "_x"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
