"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armscope.llm.common import Rounds

#: Rounds after which a graph that has not settled is an error; they grow with log^2 of its size.
MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u, v) with u > v.

    large: every neighbour above u is tied to the smallest of u and its neighbours.
    small: u and its smaller neighbours are tied to the smallest of them.
    """
    if large:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = both.join(low, "u")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    ``links`` has two columns of the same ordered type; loops, repeated links and both
    directions may occur, rows with a null are ignored.  Nodes without a link to
    another node do not occur in the result.  All steps are aggregates and joins
    on a node, so a node with very many links is combined on the map side and
    split by the skew join.  Every round is written to the shared folder; only its
    row count and a checksum come to the driver.
    """
    a, b = links.columns[:2]
    links = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col("u").isNotNull())
        .filter("u <> v")
        .distinct()
    )
    rounds = Rounds(links.sparkSession, "links")
    links = rounds.put(links)
    before = None
    for _ in range(max_rounds):
        links = rounds.put(_star(_star(links, large=True), large=False))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = tuple(now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
