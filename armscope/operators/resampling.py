"""Bootstrap of single pairs, exact at any number of pairs.

A replicate draws as many pairs as there are, with replacement.  Equal pairs are first reduced to one
row and its weight, so a replicate is one multinomial draw over the kinds of pairs.  That draw is split
down a binary tree: at every node a binomial decides how many draws go left, until a leaf holds a few
thousand kinds and draws among them.  A task walks only the path to its own leaf, and tasks that share a
node repeat the same binomial from the same seed, so nothing is exchanged between them and the work of a
task does not depend on the number of leaves beyond its logarithm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armscope.operators.stats import REPLICATES, SEED, SLICE, _interval
from armscope.session import work_dir

#: Kinds of pairs of a leaf, about.
LEAF_KINDS = 4096

SUMS = ("m_d", "a_d", "m_c", "a_c")
_DRAWN = "b bigint, " + ", ".join(f"{x} bigint" for x in SUMS)


def _leaf_sums(parts: Iterator[pd.DataFrame], depth: int, seed: int) -> Iterator[pd.DataFrame]:
    """What the draws of one leaf add to every replicate of a slice."""
    for pdf in parts:
        for row in pdf.itertuples(index=False):
            left_over = np.full(row.m, row.n, dtype=np.int64)
            for level, (w, w_left) in enumerate(zip(row.w_node, row.w_left)):
                node = row.leaf >> (depth - level)
                rng = np.random.default_rng([seed, row.s, level, node])
                to_left = rng.binomial(left_over, w_left / w)
                right = (row.leaf >> (depth - level - 1)) & 1
                left_over = left_over - to_left if right else to_left
            weights = np.asarray(row.w, dtype=np.int64)
            rng = np.random.default_rng([seed, row.s, depth, row.leaf])
            drawn = rng.multinomial(left_over, weights / weights.sum())
            values = np.stack([np.asarray(getattr(row, x), dtype=np.int64) for x in SUMS], axis=1)
            out = pd.DataFrame(drawn @ values, columns=list(SUMS))
            out.insert(0, "b", row.s * SLICE + np.arange(row.m, dtype=np.int64))
            yield out


def _paths(leaves: DataFrame, depth: int) -> DataFrame:
    """leaf, n, w_node, w_left: all pairs, and on the way to the leaf the pairs under a node and under its left child."""
    at = leaves.select("leaf", "total", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")).withColumn(
        "node", F.expr(f"shiftright(leaf, {depth} - level)")
    )
    nodes = at.groupBy("level", "node").agg(F.sum("total").alias("w"))
    lefts = nodes.filter("level > 0 AND node % 2 = 0").select(
        (F.col("level") - 1).alias("level"), F.shiftright("node", 1).alias("node"), F.col("w").alias("w_left")
    )
    known = nodes.join(lefts, ["level", "node"], "left").withColumn("w_left", F.coalesce("w_left", F.lit(0)))
    steps = at.select("leaf", "level", "node").join(known, ["level", "node"]).groupBy("leaf").agg(
        F.sort_array(F.collect_list(F.struct("level", "w", "w_left"))).alias("path")
    )
    above = F.slice("path", 1, depth)
    return steps.select(
        "leaf", F.col("path")[0]["w"].alias("n"),
        F.transform(above, lambda x: x["w"]).alias("w_node"), F.transform(above, lambda x: x["w_left"]).alias("w_left"),
    )


def replicate_sums(kinds: DataFrame, replicates: int, seed: int, leaf_kinds: int) -> DataFrame:
    """b and the sums of every replicate, from a written table of kinds (SUMS, and w: how many pairs)."""
    spark = kinds.sparkSession
    depth = max(0, math.ceil(math.log2(max(1, kinds.count()) / leaf_kinds)))
    # The leading bits of a digest: even leaves, whatever the values are.
    leaf = F.shiftrightunsigned(F.xxhash64(*SUMS), 64 - depth) if depth else F.lit(0).cast("bigint")
    leaves = kinds.groupBy(leaf.alias("leaf")).agg(
        F.sort_array(F.collect_list(F.struct(*SUMS, "w"))).alias("kinds"), F.sum("w").alias("total")
    )
    table = leaves.join(_paths(leaves.select("leaf", "total"), depth), "leaf").select(
        "leaf", "n", "w_node", "w_left", *[F.col("kinds").getField(x).alias(x) for x in (*SUMS, "w")]
    )
    last = -(-replicates // SLICE) - 1
    slices = table.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(last)))).withColumn(
        "m", F.least(F.lit(SLICE), F.lit(replicates) - F.col("s") * SLICE)
    )
    tasks = max(spark.sparkContext.defaultParallelism, (1 << depth) * (last + 1) // 8)
    drawn = slices.repartition(tasks, "leaf", "s").mapInPandas(lambda p: _leaf_sums(p, depth, seed), _DRAWN)
    return drawn.groupBy("b").agg(*[F.sum(x).alias(x) for x in SUMS])


def pair_bootstrap(
    pairs: DataFrame, columns: Sequence[str] = SUMS, replicates: int = REPLICATES, seed: int = SEED,
    leaf_kinds: int = LEAF_KINDS,
) -> DataFrame:
    """delta, lo, hi, n of sum(m_c)/sum(a_c) - sum(m_d)/sum(a_d), from resamples of single pairs.

    A null counts as 0, and a ratio without a denominator is 0.  No pairs give one row of nulls with n 0.
    For flags give the flag as matches and 1 as total.  A pair with very many copies is one kind, and kinds
    are dealt to leaves by digest, so no leaf grows with a hot pair.  The kinds are written once; their
    number, which sets the depth of the tree, is all that comes to the driver.
    """
    flat = pairs.select(*[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(x) for c, x in zip(columns, SUMS)])
    path = work_dir(pairs.sparkSession, "kinds")
    flat.groupBy(*SUMS).agg(F.count(F.lit(1)).alias("w")).write.parquet(path)
    kinds = pairs.sparkSession.read.parquet(path)
    sums = replicate_sums(kinds, replicates, seed, leaf_kinds)
    seen = kinds.agg(
        F.lit(-1).cast("bigint").alias("b"), F.coalesce(F.sum("w"), F.lit(0)).alias("n"),
        *[F.sum(F.col(x) * F.col("w")).alias(x) for x in SUMS],
    )

    def share(top: str, bottom: str):
        return F.when(F.col(bottom) != 0, F.col(top) / F.col(bottom)).otherwise(F.when(F.col(bottom) == 0, 0.0))

    both = sums.withColumn("n", F.lit(None).cast("bigint")).unionByName(seen).withColumn(
        "_d", share("m_c", "a_c") - share("m_d", "a_d")
    )
    observed = F.col("b") < 0
    return _interval(
        both.withColumn("delta", F.when(~observed, F.col("_d"))), F.max(F.when(observed, F.col("_d"))), F.max("n")
    )
