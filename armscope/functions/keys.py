"""Digest keys, deterministic draws and order positions without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket of prefix sums, about; the number of buckets follows the rows.
BUCKET_ROWS = 1_000_000


def text_key(c: Column) -> Column:
    """32-byte digest that stands for a long text in a shuffle."""
    return F.unhex(F.sha2(c, 256))


def hex_to_long(c: Column) -> Column:
    return F.conv(c, 16, 10).cast("bigint")


def order_key(seed: int, key: Column) -> Column:
    """Hex text that puts rows in a seeded, repeatable shuffled order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def running_total(df: DataFrame, key: str, amount: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Sum of the column ``amount`` over all earlier rows in the order (md5 of key, key).

    A scan on two levels without a global window.  The rows are counted and cut into even ranges of the digest,
    about ``bucket_rows`` rows each; sums run inside a range, and the totals of the ranges, one row per
    ``bucket_rows`` rows, give each its offset.  Ranges keep the order, so the result does not
    depend on their number.  The input is read three times: pass a narrow
    table, written first when it is costly.  ``key`` must be unique and ``amount`` not negative.
    """
    digest = F.md5(F.col(key).cast("string"))
    buckets = -(-df.count() // bucket_rows) or 1
    # The first 32 bits of the digest times the number of ranges, over 2**32: rises with the digest.
    bucket = F.shiftright(hex_to_long(F.substring(digest, 1, 8)) * F.lit(buckets).cast("bigint"), 32)
    inside = Window.partitionBy("_b").orderBy("_o", key).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_o", digest).withColumn("_b", bucket).withColumn(
        "_run", F.coalesce(F.sum(amount).over(inside), F.lit(0))
    )
    totals = placed.groupBy("_b").agg(F.max(F.col("_run") + F.col(amount)).alias("_t"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    return (
        placed.join(offsets, "_b")
        .withColumn(out, F.col("_off") + F.col("_run"))
        .drop("_b", "_o", "_off", "_run")
    )


def dense_index(df: DataFrame, key: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """0-based position of every row in the order (md5 of key, key)."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_total(one, key, "_one", out, bucket_rows).drop("_one")
