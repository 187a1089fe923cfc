"""Text scores of predictions and the boards built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.functions.graphtext import FEATURES, hop_count
from armscope.functions.multiset import ngram_match
from armscope.functions.text import (
    canon_sql, code_balanced, fold_key, is_blank, norm_ws, raw_key, text_or_empty,
)

# Upper bounds of the reference-length buckets (half open).
LENGTH_BUCKETS = [(50, "0-50"), (100, "50-100"), (200, "100-200"), (500, "200-500")]
LAST_BUCKET = "500+"

#: Name of a missing group; a null group is the overall row of a board.
UNKNOWN = "unknown"

def rate(flag: Column) -> Column:
    """Mean of a boolean as a double."""
    return F.avg(flag.cast("double"))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as a double, 0.0 on a zero denominator."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0)).cast("double")


def exact_match_board(
    preds: DataFrame, keys: Sequence[str], group_col: str, pred_col: str, ref_col: str
) -> DataFrame:
    """n, matches and EM for every group and overall (group null), in one pass."""
    hit = (norm_ws(F.col(pred_col)) == norm_ws(F.col(ref_col))).alias("_hit")
    flat = preds.select(*keys, F.coalesce(F.col(group_col).cast("string"), F.lit(UNKNOWN)).alias(group_col), hit)
    return flat.groupingSets([[*keys], [*keys, group_col]], *keys, group_col).agg(
        F.count("*").alias("n"),
        F.sum(F.col("_hit").cast("bigint")).alias("n_match"),
        rate(F.col("_hit")).alias("em"),
    )


def gleu_stats(pairs: DataFrame, pred_col: str, ref_col: str, max_n: int = 4) -> DataFrame:
    """Add ``gleu_match`` and ``gleu_all`` to every pair.

    All work is inside the row: no n-gram is exploded or shuffled.
    """
    step = pairs.withColumn("_grams", ngram_match(F.col(pred_col), F.col(ref_col), max_n))
    return (
        step.withColumn("gleu_match", F.col("_grams.shared")).withColumn("gleu_all", F.col("_grams.most")).drop("_grams")
    )


def corpus_gleu(stats: DataFrame, keys: Sequence[str], group_col: str) -> DataFrame:
    """sum(match) / sum(all) for every group and overall (group null)."""
    top, bottom = F.sum("gleu_match"), F.sum("gleu_all")
    flat = stats.select(*keys, F.coalesce(F.col(group_col).cast("string"), F.lit(UNKNOWN)).alias(group_col), "gleu_match", "gleu_all")
    return flat.groupingSets([[*keys], [*keys, group_col]], *keys, group_col).agg(
        F.count("*").alias("n"), top.alias("gleu_match"), bottom.alias("gleu_all"),
        ratio(top, bottom).alias("gleu"),
    )


def normalized_em_ladder(
    preds: DataFrame, keys: Sequence[str], group_col: str, pred_col: str, ref_col: str
) -> DataFrame:
    """raw, normalised and canonical EM and the share of readable references."""
    p, r = F.col(pred_col), F.col(ref_col)
    raw = preds.select(
        *keys, F.coalesce(F.col(group_col).cast("string"), F.lit(UNKNOWN)).alias(group_col),
        p.alias("p"), r.alias("r"), raw_key(p).alias("rp"), raw_key(r).alias("rr"),
    )
    # Equal raw keys settle the later levels; only the rest is normalised.
    same = F.col("rp") == F.col("rr")
    canon = F.coalesce(canon_sql(F.col("p")) == canon_sql(F.col("r")), F.lit(False))
    flat = raw.select(
        *keys, group_col,
        same.alias("raw_hit"),
        F.when(same, True).otherwise(fold_key(F.col("rp")) == fold_key(F.col("rr"))).alias("norm_hit"),
        F.when(same, ~is_blank(F.col("p"))).otherwise(canon).alias("canon_hit"),
        code_balanced(F.col("r")).alias("ok"),
    )
    return flat.groupingSets([[*keys], [*keys, group_col]], *keys, group_col).agg(
        F.count("*").alias("n"),
        rate(F.col("raw_hit")).alias("raw_em"),
        rate(F.col("norm_hit")).alias("norm_em"),
        rate(F.col("canon_hit")).alias("canon_em"),
        rate(F.col("ok")).alias("ref_parse_rate"),
    )


def arm_delta(board: DataFrame, group_col: str, metrics: Sequence[str]) -> DataFrame:
    """direct, cot and cot - direct of each metric; a missing side counts as 0.0."""
    sides = [
        F.max(F.when(F.col("arm") == arm, F.col(m))).alias(f"{arm}_{m}")
        for m in metrics
        for arm in ("direct", "cot")
    ]
    wide = board.groupBy(group_col).agg(*sides)
    out = [F.col(group_col)]
    for m in metrics:
        d = F.coalesce(F.col(f"direct_{m}"), F.lit(0.0))
        c = F.coalesce(F.col(f"cot_{m}"), F.lit(0.0))
        out += [d.alias(f"direct_{m}"), c.alias(f"cot_{m}"), (c - d).alias(f"delta_{m}")]
    return wide.select(*out)


def length_bucket(ref: Column) -> Column:
    size = F.length(ref)
    bucket = None
    for bound, name in LENGTH_BUCKETS:
        bucket = F.when(size < bound, name) if bucket is None else bucket.when(size < bound, name)
    return bucket.otherwise(LAST_BUCKET)


def complexity_buckets(preds: DataFrame, pred_col: str, ref_col: str) -> DataFrame:
    """EM per arm by length of the reference."""
    hit = norm_ws(F.col(pred_col)) == norm_ws(F.col(ref_col))
    return (
        preds.select("arm", length_bucket(F.col(ref_col)).alias("bucket"), hit.alias("_hit"))
        .groupBy("arm", "bucket")
        .agg(F.count("*").alias("n"), rate(F.col("_hit")).alias("em"))
    )


def prompt_limit_board(stats: DataFrame, prompt_tokens: Column, limit: int) -> DataFrame:
    """Corpus GLEU per arm for prompts over and within a token limit."""
    top, bottom = F.sum("gleu_match"), F.sum("gleu_all")
    return stats.groupBy("arm", (prompt_tokens > limit).alias("over_limit")).agg(
        F.count("*").alias("n"), ratio(top, bottom).alias("gleu")
    )


def query_features(query: Column) -> Column:
    """Array of the feature names a query shows."""
    hops = hop_count(query)
    hop_name = (
        F.when(hops == 0, "0-hop").when(hops == 1, "1-hop").when(hops == 2, "2-hop").otherwise("3+-hop")
    )
    names = [F.when(F.regexp_like(query, F.lit(p)), F.lit(n)) for n, p in FEATURES]
    return F.array_compact(F.array(hop_name, *names))


def feature_board(preds: DataFrame, pred_col: str, ref_col: str) -> DataFrame:
    """EM per arm for every feature of the reference; a row counts under each of its features."""
    hit = norm_ws(F.col(pred_col)) == norm_ws(F.col(ref_col))
    return (
        preds.select("arm", hit.alias("_hit"), query_features(F.col(ref_col)).alias("_f"))
        .select("arm", "_hit", F.explode("_f").alias("feature"))
        .groupBy("feature", "arm")
        .agg(F.count("*").alias("n"), rate(F.col("_hit")).alias("em"))
    )


def win_loss_table(paired: DataFrame, d: Column, c: Column, group_col: str | None = None) -> DataFrame:
    """Counts of the four outcomes and the gain:loss ratio."""
    keys = [group_col] if group_col else []
    both = F.count(F.when(d & c, 1))
    cot_only, direct_only = F.count(F.when(~d & c, 1)), F.count(F.when(d & ~c, 1))
    return paired.groupBy(*keys).agg(
        F.count("*").alias("n"),
        both.alias("both"), cot_only.alias("cot_only"), direct_only.alias("direct_only"),
        F.count(F.when(~d & ~c, 1)).alias("neither"),
        F.when(direct_only > 0, cot_only / direct_only).alias("gain_loss_ratio"),
    )


def gap_decomposition(
    board: DataFrame, arm_col: str, score_col: str, base: str, middle: str, full: str
) -> DataFrame:
    """Total gap base->full as the step base->middle plus the step middle->full.

    ``recovery_share`` is the part of the total that the first step explains.
    """
    def at(arm: str) -> Column:
        return F.max(F.when(F.col(arm_col) == arm, F.col(score_col)))

    return board.agg(at(base).alias("a"), at(middle).alias("b"), at(full).alias("c")).select(
        F.col("a").alias("base_score"), F.col("b").alias("middle_score"),
        F.col("c").alias("full_score"),
        (F.col("c") - F.col("a")).alias("total_gap"),
        (F.col("b") - F.col("a")).alias("pipeline_gap"),
        (F.col("c") - F.col("b")).alias("treatment_gap"),
        F.when(F.col("c") != F.col("a"),
               (F.col("b") - F.col("a")) / (F.col("c") - F.col("a"))).alias("recovery_share"),
    )


def token_cost(
    traces: DataFrame, rates: dict[str, tuple[float, float]], meta: str = "generation_metadata"
) -> DataFrame:
    """Token totals, averages over all records and the cost at every provider's rates.

    ``rates`` gives dollars per million prompt and completion tokens.
    """
    p = F.coalesce(F.col(f"{meta}.prompt_tokens"), F.lit(0))
    c = F.coalesce(F.col(f"{meta}.completion_tokens"), F.lit(0))
    providers = F.array(
        *[
            F.struct(
                F.lit(name).alias("provider"),
                F.lit(float(i)).alias("in_per_m"), F.lit(float(o)).alias("out_per_m"),
            )
            for name, (i, o) in sorted(rates.items())
        ]
    )
    total = traces.agg(
        F.count("*").alias("n_records"),
        F.coalesce(F.sum(p), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(c), F.lit(0)).alias("completion_tokens"),
    )
    return total.select("*", F.inline(providers)).select(
        "provider", "n_records", "prompt_tokens", "completion_tokens",
        ratio(F.col("prompt_tokens"), F.col("n_records")).alias("avg_prompt"),
        ratio(F.col("completion_tokens"), F.col("n_records")).alias("avg_completion"),
        (
            F.col("prompt_tokens") / 1e6 * F.col("in_per_m")
            + F.col("completion_tokens") / 1e6 * F.col("out_per_m")
        ).alias("cost"),
    )


def trace_stats(traces: DataFrame) -> DataFrame:
    """Success counts, reasoning-length statistics and match rate, one row.

    Lengths are counted first, so the exact median works on distinct lengths.
    """
    ok = F.coalesce(F.col("reasoning"), F.lit("")) != ""
    hit = norm_ws(F.col("generated_cypher")) == norm_ws(F.col("cypher"))
    per_len = traces.groupBy(
        ok.alias("ok"), F.when(ok, F.length("reasoning")).alias("len")
    ).agg(F.count("*").alias("n"), F.sum((ok & hit).cast("bigint")).alias("hits"))
    n_ok = F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0))
    s1 = F.sum(F.col("len") * F.col("n")).cast("double")
    mean = s1 / n_ok
    s2 = F.sum(F.col("len").cast("decimal(20,0)") * F.col("len") * F.col("n")).cast("double")
    return per_len.agg(
        F.sum("n").alias("n_total"),
        n_ok.alias("n_success"),
        F.sum(F.when(~F.col("ok"), F.col("n")).otherwise(0)).alias("n_failure"),
        F.min("len").alias("min_len"),
        F.percentile("len", F.lit(0.5), F.col("n")).alias("median_len"),
        mean.alias("mean_len"),
        F.max("len").alias("max_len"),
        F.when(n_ok > 1, F.sqrt((s2 - s1 * s1 / n_ok) / (n_ok - 1))).alias("stdev_len"),
        F.sum("hits").alias("n_match"),
        ratio(F.sum("hits"), n_ok).alias("match_rate"),
    )


def trace_source_table(traces: DataFrame) -> DataFrame:
    """Totals, successes and failures per source, biggest source first."""
    ok = F.coalesce(F.col("reasoning"), F.lit("")) != ""
    return (
        traces.groupBy(F.coalesce("data_source", F.lit("unknown")).alias("data_source"))
        .agg(
            F.count("*").alias("total"),
            F.count(F.when(ok, 1)).alias("success"),
            F.count(F.when(~ok, 1)).alias("fail"),
            rate(ok).alias("success_rate"),
        )
        .orderBy(F.desc("total"), "data_source")
    )


def failure_reasons(traces: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent parse errors of failed traces."""
    failed = F.coalesce(F.col("reasoning"), F.lit("")) == ""
    return (
        traces.filter(failed)
        .groupBy(F.coalesce("parse_error", F.lit("unknown")).alias("parse_error"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "parse_error")
        .limit(top)
    )


def trace_mismatch_kinds(traces: DataFrame, gen_col: str, ref_col: str, long_literal: int = 200) -> DataFrame:
    """Kinds of difference between generated and reference query of successful traces; first match wins."""
    traces = traces.filter(F.coalesce(F.col("reasoning"), F.lit("")) != "")
    g, r = text_or_empty(F.col(gen_col)), text_or_empty(F.col(ref_col))
    flat = traces.select(
        g.alias("g"), r.alias("r"), norm_ws(g).alias("gn"), norm_ws(r).alias("rn")
    ).filter(F.col("g") != F.col("r"))
    bare = lambda c: F.regexp_replace(c, "[; ]+$", "")
    long_text = F.regexp_like("r", F.lit(f"'[^']{{{long_literal},}}'"))
    kind = (
        F.when(F.col("gn") == F.col("rn"), "whitespace")
        .when(F.lower("gn") == F.lower("rn"), "case")
        .when(bare(F.col("gn")) == bare(F.col("rn")), "semicolon")
        .when(long_text & (F.length("g") < F.length("r")), "truncated_literal")
        .otherwise("other")
    )
    return flat.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def match_part(query: Column) -> Column:
    """Pattern text before RETURN, blanks collapsed."""
    return norm_ws(F.regexp_extract(query, r"(?is)^(.*?)\bRETURN\b", 1))


def return_part(query: Column) -> Column:
    """Text of RETURN up to ORDER BY, LIMIT or SKIP."""
    tail = F.regexp_extract(query, r"(?is)\bRETURN\b(.*)$", 1)
    return norm_ws(F.regexp_replace(tail, r"(?is)\b(ORDER\s+BY|LIMIT|SKIP)\b.*$", ""))


def pred_mismatch_kinds(preds: DataFrame, pred_col: str, ref_col: str) -> DataFrame:
    """Where a wrong prediction differs: pattern, return columns, alias only, or elsewhere."""
    p, r = text_or_empty(F.col(pred_col)), text_or_empty(F.col(ref_col))
    wrong = preds.filter(norm_ws(p) != norm_ws(r)).select(
        "arm",
        match_part(p).alias("pm"), match_part(r).alias("rm"),
        return_part(p).alias("pr"), return_part(r).alias("rr"),
    )
    no_alias = lambda c: F.regexp_replace(c, r"(?i) AS \w+", "")
    kind = (
        F.when(F.col("pm") != F.col("rm"), "different_match")
        .when(F.col("pr") == F.col("rr"), "other")
        .when(no_alias(F.col("pr")) == no_alias(F.col("rr")), "alias_only")
        .otherwise("different_return")
    )
    return wrong.groupBy("arm", kind.alias("kind")).agg(F.count("*").alias("n"))


def usable(rows: DataFrame, col: str) -> DataFrame:
    """Rows whose column is not blank."""
    return rows.filter(~is_blank(F.col(col)))
