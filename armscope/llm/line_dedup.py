"""Line dedup by site-relative frequency.

A line that stands on a large share of one host's pages is boilerplate of that
host, however rare it is elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.llm.common import free_name, stored

#: Lines on more than this share of a host's pages go.
RATIO = 0.1
#: A line on fewer pages than this is a line that two pages share, not boilerplate; the same for hosts of any size.
MIN_PAGES = 3


def line_key(line: Column) -> Column:
    """128-bit digest of a line without the blanks around it, as text; blank lines have none."""
    bare = F.trim(F.regexp_replace(line, r"[\t\r]", " "))
    return F.when(bare != "", F.md5(bare))


def _host(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """One row per host that has boilerplate: host, n_pages, lines (their digests).

    Every page counts a line once.  Page counts are added up on the map side,
    so a host with a third of all pages or a line on all of them is one number
    per task.  The shares of a host's lines sum to its mean number of lines per
    page, so ``lines`` holds at most that mean divided by ``ratio``.
    """
    hosted = pages.select(_host(host).alias("host"), F.col(text).alias("text"))
    keys = F.array_distinct(F.transform(F.split(F.col("text"), "\n"), line_key))
    totals = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    counts = (
        hosted.select("host", F.explode(keys).alias("line"))
        .filter(F.col("line").isNotNull())
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_pages)
    )
    return (
        counts.join(totals, "host")
        .filter(F.col("n") > ratio * F.col("n_pages"))
        .groupBy("host")
        .agg(F.first("n_pages").alias("n_pages"), F.sort_array(F.collect_list("line")).alias("lines"))
    )


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    dropped: str = "n_lines_dropped",
) -> DataFrame:
    """All rows and columns of ``pages``, ``text`` without its host's boilerplate lines, and ``dropped``.

    A line counts as the same with other blanks around it.  Blank lines stay.
    A null host is a host of its own, shared with the empty name; a null text
    stays null with 0 dropped lines and still counts as a page.  Repeated rows
    are pages of their own.  No page is dropped, also when all its lines go:
    its text is then empty.  The columns made on the way never clash with
    columns of ``pages``; a column named as ``dropped`` is replaced.

    The boilerplate joins by host, one row each: Spark broadcasts it while it
    is small, and otherwise splits the hot host in a sort-merge join.
    """
    key, lines = free_name(pages, "_host"), free_name(pages, "_lines")
    # Written first: the join then sees a table, not the aggregate by host whose dealing it would keep.
    found = stored(boilerplate(pages, host, text, ratio, min_pages), "boilerplate").select(
        F.col("host").alias(key), F.col("lines").alias(lines)
    )
    joined = pages.drop(dropped).withColumn(key, _host(host)).join(found, key, "left")
    stay = free_name(pages, "_stay")
    joined = joined.withColumn(
        stay,
        F.when(
            F.col(lines).isNotNull(),
            F.filter(
                F.split(F.col(text), "\n"),
                lambda x: ~F.coalesce(F.array_contains(F.col(lines), line_key(x)), F.lit(False)),
            ),
        ),
    )
    n_before, n_after = F.size(F.split(F.col(text), "\n")), F.size(F.col(stay))
    joined = joined.withColumn(
        dropped,
        F.when(F.col(lines).isNull() | F.col(text).isNull(), 0).otherwise(n_before - n_after).cast("bigint"),
    ).withColumn(text, F.when(F.col(dropped) > 0, F.array_join(F.col(stay), "\n")).otherwise(F.col(text)))
    return joined.select(*[c for c in pages.columns if c != dropped], dropped)
