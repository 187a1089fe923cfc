"""Selecting among candidates, and seeded samples.

Candidates come as a long table (id, cand_idx, candidate[, fp]).  Votes are
counted with plain aggregates that combine before the shuffle, so no
candidate list is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armscope.functions.keys import order_key
from armscope.functions.text import norm_ws
from armscope.operators.scoring import rate, ratio


def _clusters(cands: DataFrame, id_col: str, cluster: Column) -> DataFrame:
    return cands.groupBy(id_col, cluster.alias("_c")).agg(
        F.count("*").alias("votes"), F.min("cand_idx").alias("first_idx")
    )


def _biggest(votes: Column, first_idx: Column) -> Column:
    """Order in which the biggest cluster is largest and ties go to the earliest."""
    return F.struct(votes, (-first_idx).alias("_early"))


def string_vote(cands: DataFrame, id_col: str = "instance_id", text_col: str = "candidate") -> DataFrame:
    """Majority over collapsed candidate texts; a tie goes to the text seen first."""
    clusters = _clusters(cands, id_col, norm_ws(F.col(text_col)))
    rank = _biggest(F.col("votes"), F.col("first_idx"))
    return clusters.groupBy(id_col).agg(
        F.max_by("_c", rank).alias("voted"),
        F.max("votes").alias("votes"),
        F.sum("votes").alias("n_candidates"),
    )


def result_vote(cands: DataFrame, id_col: str = "instance_id", text_col: str = "candidate") -> DataFrame:
    """Representative of the biggest result cluster.

    ``fp`` is null for a candidate that failed: it does not vote.  When all
    failed, the first candidate is returned with ``all_errored``.
    """
    return _voted(result_clusters(cands, id_col, text_col), id_col, [])


def result_clusters(cands: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Candidates of an id with the same result: votes, first index, representative (combined before the shuffle)."""
    return cands.groupBy(id_col, "fp").agg(
        F.count("*").alias("votes"),
        F.min("cand_idx").alias("first_idx"),
        F.min_by(text_col, "cand_idx").alias("_rep"),
    )


def _voted(clusters: DataFrame, id_col: str, more: list[Column]) -> DataFrame:
    """The biggest cluster of every id, and further aggregates of its clusters."""
    ran = F.col("fp").isNotNull()
    rank = _biggest(F.col("votes"), F.col("first_idx"))
    won = clusters.groupBy(id_col).agg(
        F.max_by("_rep", F.when(ran, rank)).alias("_won"),
        F.max_by("fp", F.when(ran, rank)).alias("selected_fp"),
        F.min_by("_rep", "first_idx").alias("_first"),
        F.coalesce(F.sum(F.when(ran, F.col("votes"))), F.lit(0)).alias("n_executed"),
        *more,
    )
    return won.withColumn(
        "selected_query", F.when(F.col("n_executed") > 0, F.col("_won")).otherwise(F.col("_first"))
    ).withColumn("all_errored", F.col("n_executed") == 0).drop("_won", "_first")


def selection_outcomes(
    cands: DataFrame, refs: DataFrame, id_col: str = "instance_id", text_col: str = "candidate"
) -> DataFrame:
    """Verdict of result_vote per instance.

    ``refs`` has id, ``ref_fp`` (null on error) and ``ref_error``.  It meets the
    clusters, a few per id, and never the candidates: the votes of the cluster
    with the reference's result are the candidates that match it.
    """
    clusters = result_clusters(cands, id_col, text_col)
    matching = F.coalesce(F.sum(F.when(F.col("fp") == F.col("ref_fp"), F.col("votes"))), F.lit(0))
    chosen = _voted(
        clusters.join(refs.select(id_col, "ref_fp", "ref_error"), id_col), id_col,
        [matching.alias("n_candidates_matching_ref"), F.first("ref_fp").alias("ref_fp"), F.first("ref_error").alias("ref_error")],
    )
    return chosen.select(
        id_col,
        F.coalesce(F.col("selected_fp") == F.col("ref_fp"), F.lit(False)).alias("exec_match"),
        "selected_query",
        "n_candidates_matching_ref",
        F.col("n_executed").alias("n_candidates_executed"),
        "ref_error",
    )


def selection_board(outcomes: DataFrame) -> DataFrame:
    """Selected EM, oracle EM and captured share, without failed references."""
    valid = outcomes.filter(F.col("ref_error").isNull())
    oracle = F.count(F.when(F.col("n_candidates_matching_ref") > 0, 1))
    matches = F.count(F.when(F.col("exec_match"), 1))
    return valid.agg(
        F.count("*").alias("valid_instances"),
        matches.alias("match_count"),
        ratio(matches, F.count("*")).alias("select_em"),
        oracle.alias("oracle_count"),
        ratio(oracle, F.count("*")).alias("oracle_em"),
        ratio(matches, oracle).alias("captured_share"),
    )


def oracle_anatomy(outcomes: DataFrame) -> DataFrame:
    """Solved / addressable / generation-bound, and lone-correct addressable ones."""
    valid = outcomes.filter(F.col("ref_error").isNull())
    kind = (
        F.when(F.col("exec_match"), "solved")
        .when(F.col("n_candidates_matching_ref") > 0, "addressable")
        .otherwise("generation_bound")
    )
    counts = valid.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n"),
        rate(F.col("n_candidates_matching_ref") == 1).alias("lone_correct_share"),
    )
    # At most three rows are left, so the total is a window over three rows.
    whole = Window.partitionBy(F.lit(1))
    return counts.select(
        "kind", "n", (F.col("n") / F.sum("n").over(whole)).alias("share"), "lone_correct_share"
    )


def agreement(
    cands: DataFrame, full: int, most: int, id_col: str = "instance_id", text_col: str = "candidate"
) -> DataFrame:
    """Share of instances with at least ``full`` and at least ``most`` equal candidates."""
    biggest = _clusters(cands, id_col, norm_ws(F.col(text_col))).groupBy(id_col).agg(
        F.max("votes").alias("top")
    )
    return biggest.agg(
        F.count("*").alias("n"),
        rate(F.col("top") >= full).alias("share_full"),
        rate(F.col("top") >= most).alias("share_most"),
    )


def verified_traces(
    cands: DataFrame, refs: DataFrame, id_col: str = "instance_id"
) -> tuple[DataFrame, DataFrame]:
    """(kept, audit): the first candidate whose result equals the reference's.

    ``cands`` has cand_idx, reasoning, query and ``fp``; an empty query is no
    candidate.  The audit gives a status for every reference.
    """
    # One row per id and result before the join: an id with very many candidates is reduced in each task.
    first = (
        cands.filter(F.col("query") != "")
        .groupBy(id_col, "fp")
        .agg(F.min(F.struct("cand_idx", "reasoning", "query")).alias("_first"))
    )
    wanted = refs.select(id_col, F.col("ref_fp").alias("fp")).distinct()
    hit = (
        first.join(wanted, [id_col, "fp"]).groupBy(id_col).agg(F.min("_first").alias("_best"))
        .withColumn("cand_idx", F.col("_best.cand_idx"))
    )
    audit = refs.join(hit, id_col, "left").select(
        id_col,
        F.when(F.col("ref_fp").isNull(), "ref_failed")
        .when(F.col("cand_idx").isNull(), "no_correct_candidate")
        .otherwise("kept").alias("status"),
        F.col("ref_error").alias("ref_err"),
    )
    kept = hit.select(id_col, "cand_idx", "_best.reasoning", "_best.query")
    return kept, audit


def keep_rate(audit: DataFrame) -> DataFrame:
    """Audit counts and kept / (examined - failed references)."""
    kept = F.count(F.when(F.col("status") == "kept", 1))
    failed = F.count(F.when(F.col("status") == "ref_failed", 1))
    return audit.agg(
        F.count("*").alias("examined"),
        kept.alias("kept"),
        F.count(F.when(F.col("status") == "no_correct_candidate", 1)).alias("no_correct_candidate"),
        failed.alias("ref_failed"),
        ratio(kept, F.count("*") - failed).alias("keep_rate"),
    )


def seeded_limit(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of a repeatable shuffle; every task keeps only its own best n."""
    return (
        rows.withColumn("_o", order_key(seed, F.col(id_col)))
        .orderBy("_o", id_col).limit(n).drop("_o")
    )


def pilot_by_source(
    rows: DataFrame, id_col: str, source_col: str, n: int = 50, seed: int = 42
) -> DataFrame:
    """A pilot of n rows spread over sources: max(1, n // #sources) each, then filled up.

    The first filter, rank <= n, is a constant, so Spark keeps only the n best
    rows of a source in each task before the shuffle.
    """
    keyed = rows.select(
        id_col, F.coalesce(F.col(source_col), F.lit("unknown")).alias("_s"),
        order_key(seed, F.col(id_col)).alias("_o"),
    )
    best = Window.partitionBy("_s").orderBy("_o", id_col)
    top = keyed.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= n)
    # At most n rows per source are left.  A row beyond them cannot be in the pilot.
    n_src = keyed.agg(F.count_distinct("_s")).scalar()
    ranked = top.withColumn("_share", F.greatest(F.lit(1), F.floor(F.lit(n) / n_src)))
    share = F.col("_share")
    first = F.when(F.col("_rn") <= share, 0).otherwise(1)
    source_rank = F.when(F.col("_rn") <= share, F.col("_s"))
    picked = ranked.orderBy(
        first, F.asc_nulls_last(source_rank), "_o", id_col
    ).limit(n).select(id_col)
    return rows.join(picked, id_col, "left_semi")


def pilot_by_size(
    rows: DataFrame, id_col: str, size_col: str, per_size: int = 5, n: int = 20, seed: int = 42
) -> DataFrame:
    """``per_size`` rows of every size, sizes ascending, first n."""
    keyed = rows.withColumn("_o", order_key(seed, F.col(id_col)))
    best = Window.partitionBy(size_col).orderBy("_o", id_col)
    return (
        keyed.withColumn("_rn", F.row_number().over(best))
        .filter(F.col("_rn") <= per_size)
        .orderBy(size_col, "_rn").limit(n)
        .drop("_o", "_rn")
    )


def review_sample(
    traces: DataFrame, id_col: str, n: int = 10, failures: bool = False, seed: int = 42
) -> DataFrame:
    """n successes or failures for reading, long fields cut for display."""
    failed = F.coalesce(F.col("reasoning"), F.lit("")) == ""
    pool = traces.filter(failed if failures else ~failed)
    shown: Sequence[Column] = (
        [F.coalesce("parse_error", F.lit("unknown")).alias("error"),
         F.substring("raw_response", 1, 500).alias("raw_response")]
        if failures
        else [F.col("reasoning"), F.substring("generated_cypher", 1, 200).alias("generated_cypher")]
    )
    return seeded_limit(pool, id_col, n, seed).select(
        id_col, "data_source", "question", F.substring("cypher", 1, 200).alias("cypher"), *shown
    )
