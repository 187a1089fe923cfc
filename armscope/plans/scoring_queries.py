"""Registered queries for text scores and boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from armscope.functions.text import norm_ws, words
from armscope.operators import scoring as op
from armscope.operators.pairing import pair_arms
from armscope.plans import duck as d
from armscope.plans import fixtures as fx
from armscope.plans.registry import query

P = fx.PREDICTIONS
EM = f"({d.norm_ws('predicted_cypher')} = {d.norm_ws('reference_cypher')})"

# Dollars per million prompt and completion tokens, by provider.
RATES = {
    "cerebras": (0.25, 0.69),
    "galaxy": (0.02, 0.10),
    "openrouter": (0.039, 0.19),
    "deepinfra": (0.04, 0.19),
    "openai": (0.15, 0.60),
}


def em_board(spark, sf):
    return op.exact_match_board(
        fx.predictions(spark, sf), ["arm"], "data_source", "predicted_cypher", "reference_cypher"
    )


EM_BOARD_SQL = f"""
WITH p AS ({P}), h AS (SELECT arm, data_source, {EM} AS hit FROM p)
SELECT arm, data_source, count(*) AS n, {d.count_if('hit')} AS n_match, {d.rate('hit')} AS em
FROM h GROUP BY GROUPING SETS ((arm), (arm, data_source))"""


@query("exact_match_board", EM_BOARD_SQL)
def exact_match_board(spark, sf):
    return em_board(spark, sf)


@query(
    "arm_delta_by_source",
    f"""WITH b AS ({EM_BOARD_SQL})
SELECT data_source,
  coalesce(max(CASE WHEN arm = 'direct' THEN em END), 0.0::DOUBLE) AS direct_em,
  coalesce(max(CASE WHEN arm = 'cot' THEN em END), 0.0::DOUBLE) AS cot_em,
  coalesce(max(CASE WHEN arm = 'cot' THEN em END), 0.0::DOUBLE)
    - coalesce(max(CASE WHEN arm = 'direct' THEN em END), 0.0::DOUBLE) AS delta_em
FROM b GROUP BY data_source""",
)
def arm_delta_by_source(spark, sf):
    return op.arm_delta(em_board(spark, sf), "data_source", ["em"])


@query(
    "gleu_stats_documents",
    f"""WITH {d.gleu_ctes(fx.TEXT_PAIRS, 'predicted', 'reference')}
SELECT instance_id, gleu_match, gleu_all FROM stat""",
)
def gleu_stats_documents(spark, sf):
    pairs = fx.fixture(spark, sf, fx.TEXT_PAIRS)
    return op.gleu_stats(pairs, "predicted", "reference").select(
        "instance_id", "gleu_match", "gleu_all"
    )


@query(
    "corpus_gleu_documents",
    f"""WITH {d.gleu_ctes(fx.TEXT_PAIRS, 'predicted', 'reference')}
SELECT lang, data_source, count(*) AS n, CAST(sum(gleu_match) AS BIGINT) AS gleu_match,
  CAST(sum(gleu_all) AS BIGINT) AS gleu_all,
  CASE WHEN sum(gleu_all) = 0 THEN 0.0 ELSE sum(gleu_match)::DOUBLE / sum(gleu_all)::DOUBLE END AS gleu
FROM stat GROUP BY GROUPING SETS ((lang), (lang, data_source))""",
)
def corpus_gleu_documents(spark, sf):
    pairs = fx.fixture(spark, sf, fx.TEXT_PAIRS)
    return op.corpus_gleu(op.gleu_stats(pairs, "predicted", "reference"), ["lang"], "data_source")


@query(
    "corpus_gleu_predictions",
    f"""WITH {d.gleu_ctes(P, 'predicted_cypher', 'reference_cypher')}
SELECT arm, data_source, count(*) AS n, CAST(sum(gleu_match) AS BIGINT) AS gleu_match,
  CAST(sum(gleu_all) AS BIGINT) AS gleu_all,
  CASE WHEN sum(gleu_all) = 0 THEN 0.0 ELSE sum(gleu_match)::DOUBLE / sum(gleu_all)::DOUBLE END AS gleu
FROM stat GROUP BY GROUPING SETS ((arm), (arm, data_source))""",
)
def corpus_gleu_predictions(spark, sf):
    stats = op.gleu_stats(fx.predictions(spark, sf), "predicted_cypher", "reference_cypher")
    return op.corpus_gleu(stats, ["arm"], "data_source")


LADDER_SQL = f"""WITH p AS ({fx.SQL_PREDICTIONS}), k AS (SELECT arm, sql_complexity,
  {d.raw_key('predicted_sql')} = {d.raw_key('reference_sql')} AS r,
  {d.norm_key('predicted_sql')} = {d.norm_key('reference_sql')} AS n,
  coalesce({d.canon_sql('predicted_sql')} = {d.canon_sql('reference_sql')}, false) AS c,
  NOT {d.is_blank('reference_sql')} AND len(replace(reference_sql, '(', '')) = len(replace(reference_sql, ')', '')) AS ok
  FROM p)
SELECT arm, sql_complexity, count(*) AS n, {d.rate('r')} AS raw_em, {d.rate('k.n')} AS norm_em,
  {d.rate('c')} AS canon_em, {d.rate('ok')} AS ref_parse_rate
FROM k GROUP BY GROUPING SETS ((arm), (arm, sql_complexity))"""


@query("normalized_em_ladder", LADDER_SQL)
def normalized_em_ladder(spark, sf):
    return op.normalized_em_ladder(
        fx.fixture(spark, sf, fx.SQL_PREDICTIONS), ["arm"], "sql_complexity", "predicted_sql", "reference_sql"
    )


BUCKET = """CASE WHEN len(reference_cypher) < 50 THEN '0-50' WHEN len(reference_cypher) < 100 THEN '50-100'
  WHEN len(reference_cypher) < 200 THEN '100-200' WHEN len(reference_cypher) < 500 THEN '200-500' ELSE '500+' END"""


_LADDER_METRICS = ["raw_em", "norm_em", "canon_em"]


def _delta_sql(m: str) -> str:
    side = lambda arm: f"coalesce(max(CASE WHEN arm = '{arm}' THEN {m} END), 0.0::DOUBLE)"
    return f"{side('direct')} AS direct_{m}, {side('cot')} AS cot_{m}, {side('cot')} - {side('direct')} AS delta_{m}"


@query(
    "arm_delta_ladder",
    f"""WITH lb AS ({LADDER_SQL}) SELECT sql_complexity, {", ".join(_delta_sql(m) for m in _LADDER_METRICS)}
FROM lb GROUP BY sql_complexity""",
)
def arm_delta_ladder(spark, sf):
    """Delta of raw, normalised and canonical EM, overall (complexity null) and per complexity."""
    return op.arm_delta(normalized_em_ladder(spark, sf), "sql_complexity", _LADDER_METRICS)


@query(
    "complexity_buckets",
    f"""WITH p AS ({P})
SELECT arm, {BUCKET} AS bucket, count(*) AS n, {d.rate(EM)} AS em FROM p GROUP BY ALL""",
)
def complexity_buckets(spark, sf):
    return op.complexity_buckets(fx.predictions(spark, sf), "predicted_cypher", "reference_cypher")


@query(
    "gleu_by_prompt_limit",
    f"""WITH {d.gleu_ctes(P, 'predicted_cypher', 'reference_cypher')}
SELECT arm, len({d.words("schema_text || ' ' || question")}) > 18 AS over_limit, count(*) AS n,
  sum(gleu_match)::DOUBLE / sum(gleu_all)::DOUBLE AS gleu FROM stat GROUP BY ALL""",
)
def gleu_by_prompt_limit(spark, sf):
    stats = op.gleu_stats(fx.predictions(spark, sf), "predicted_cypher", "reference_cypher")
    prompt = F.size(words(F.concat_ws(" ", "schema_text", "question")))
    return op.prompt_limit_board(stats, prompt, 18)


FEATURE_SQL = [
    ("UNION", r"(?i)\bUNION\b"), ("VAR_LENGTH_PATH", r"\[[^\]]*\*[^\]]*\]"), ("CASE", r"(?i)\bCASE\b"),
    ("COLLECT", r"(?i)\bCOLLECT\s*\("), ("WHERE", r"(?i)\bWHERE\b"), ("EXISTS", r"(?i)\bEXISTS\b"),
    ("WITH", r"(?i)\bWITH\b"), ("DISTINCT", r"(?i)\bDISTINCT\b"),
    ("AGGREGATION", r"(?i)\b(AVG|SUM|MIN|MAX)\s*\("),
    ("WRITE", r"(?i)\b(CREATE|MERGE|SET|DELETE|REMOVE)\b"), ("COUNT", r"(?i)\bCOUNT\s*\("),
    ("ORDER BY", r"(?i)\bORDER\s+BY\b"), ("LIMIT", r"(?i)\bLIMIT\b"), ("UNWIND", r"(?i)\bUNWIND\b"),
    ("OPTIONAL MATCH", r"(?i)\bOPTIONAL\s+MATCH\b"),
]
_HOPS = d.count_rx("reference_cypher", r"-\[")
FEATURE_UNION = " UNION ALL ".join(
    [f"SELECT arm, hit, CASE h WHEN 0 THEN '0-hop' WHEN 1 THEN '1-hop' WHEN 2 THEN '2-hop' ELSE '3+-hop' END AS feature FROM h"]
    + [f"SELECT arm, hit, '{n}' FROM h WHERE regexp_matches(reference_cypher, '{p}')" for n, p in FEATURE_SQL]
)


@query(
    "feature_board",
    f"""WITH p AS ({P}), h AS (SELECT *, {EM} AS hit, {_HOPS} AS h FROM p), f AS ({FEATURE_UNION})
SELECT feature, arm, count(*) AS n, {d.rate('hit')} AS em FROM f GROUP BY feature, arm""",
)
def feature_board(spark, sf):
    return op.feature_board(fx.predictions(spark, sf), "predicted_cypher", "reference_cypher")


PAIRED_SQL = f"""SELECT a.instance_id, a.question, a.data_source,
  {d.norm_ws('a.predicted_cypher')} = {d.norm_ws('a.reference_cypher')} AS direct_em,
  {d.norm_ws('b.predicted_cypher')} = {d.norm_ws('b.reference_cypher')} AS cot_em
  FROM ({P}) a JOIN ({P}) b ON a.instance_id = b.instance_id WHERE a.arm = 'direct' AND b.arm = 'cot'"""


def paired_em(spark, sf):
    """One row per instance with both arms' EM, question and source."""
    preds = fx.predictions(spark, sf).withColumn(
        "em", norm_ws(F.col("predicted_cypher")) == norm_ws(F.col("reference_cypher"))
    )
    return pair_arms(
        fx.arm(preds, "direct"), fx.arm(preds, "cot"), "instance_id", ["em"],
        strict=True, shared=["question", "data_source"],
    )


@query(
    "win_loss_table",
    f"""WITH x AS ({PAIRED_SQL})
SELECT data_source, count(*) AS n, {d.count_if('direct_em AND cot_em')} AS "both",
  {d.count_if('NOT direct_em AND cot_em')} AS cot_only, {d.count_if('direct_em AND NOT cot_em')} AS direct_only,
  {d.count_if('NOT direct_em AND NOT cot_em')} AS neither,
  CASE WHEN {d.count_if('direct_em AND NOT cot_em')} > 0 THEN
    {d.count_if('NOT direct_em AND cot_em')}::DOUBLE / {d.count_if('direct_em AND NOT cot_em')} END AS gain_loss_ratio
FROM x GROUP BY data_source""",
)
def win_loss_table(spark, sf):
    return op.win_loss_table(paired_em(spark, sf), F.col("direct_em"), F.col("cot_em"), "data_source")


@query(
    "gap_decomposition",
    f"""WITH p AS ({P}), s AS (
  SELECT {d.rate("predicted_cypher = reference_cypher AND arm = 'cot'")} * 2 AS a,
    {d.rate(f"{EM} AND arm = 'cot'")} * 2 AS b,
    {d.rate(f"lower({d.norm_ws('predicted_cypher')}) = lower({d.norm_ws('reference_cypher')}) AND arm = 'cot'")} * 2 AS c FROM p)
SELECT a AS base_score, b AS middle_score, c AS full_score, c - a AS total_gap, b - a AS pipeline_gap,
  c - b AS treatment_gap, CASE WHEN c <> a THEN (b - a) / (c - a) END AS recovery_share FROM s""",
)
def gap_decomposition(spark, sf):
    """Gap of the cot arm from raw text match to case-free match, by way of collapsed blanks."""
    p, r = F.col("predicted_cypher"), F.col("reference_cypher")
    levels = [
        ("raw", p == r), ("blanks", norm_ws(p) == norm_ws(r)),
        ("case", F.lower(norm_ws(p)) == F.lower(norm_ws(r))),
    ]
    board = (
        fx.arm(fx.predictions(spark, sf), "cot")
        .select(F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), h.alias("hit")) for n, h in levels])).alias("x"))
        .groupBy("x.arm").agg(op.rate(F.col("x.hit")).alias("score"))
    )
    return op.gap_decomposition(board, "arm", "score", "raw", "blanks", "case")


RATE_ROWS = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in sorted(RATES.items()))


@query(
    "token_cost",
    f"""WITH t AS ({fx.TRACES}), s AS (SELECT count(*) AS n_records, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM t)
SELECT provider, n_records, prompt_tokens, completion_tokens,
  prompt_tokens::DOUBLE / n_records AS avg_prompt, completion_tokens::DOUBLE / n_records AS avg_completion,
  prompt_tokens::DOUBLE / 1e6::DOUBLE * i + completion_tokens::DOUBLE / 1e6::DOUBLE * o AS cost
FROM s, (VALUES {RATE_ROWS}) r(provider, i, o)""",
)
def token_cost(spark, sf):
    return op.token_cost(fx.traces(spark, sf), RATES)


@query(
    "trace_stats",
    f"""WITH t AS ({fx.TRACES}), s AS (SELECT *, reasoning <> '' AS ok,
  CASE WHEN reasoning <> '' THEN len(reasoning) END AS ln,
  {d.norm_ws('generated_cypher')} = {d.norm_ws('cypher')} AS hit FROM t)
SELECT count(*) AS n_total, {d.count_if('ok')} AS n_success, {d.count_if('NOT ok')} AS n_failure,
  CAST(min(ln) AS INT) AS min_len, median(ln) AS median_len, sum(ln)::DOUBLE / count(ln) AS mean_len, CAST(max(ln) AS INT) AS max_len,
  sqrt((sum(ln * ln)::DOUBLE - sum(ln)::DOUBLE * sum(ln)::DOUBLE / count(ln)) / (count(ln) - 1)) AS stdev_len,
  {d.count_if('ok AND hit')} AS n_match, {d.count_if('ok AND hit')}::DOUBLE / {d.count_if('ok')} AS match_rate
FROM s""",
)
def trace_stats(spark, sf):
    return op.trace_stats(fx.traces(spark, sf))


@query(
    "trace_source_table",
    f"""WITH t AS ({fx.TRACES})
SELECT data_source, count(*) AS total, {d.count_if("reasoning <> ''")} AS success,
  {d.count_if("reasoning = ''")} AS fail, {d.rate("reasoning <> ''")} AS success_rate FROM t GROUP BY data_source""",
)
def trace_source_table(spark, sf):
    return op.trace_source_table(fx.traces(spark, sf))


@query(
    "failure_reasons",
    f"""WITH t AS ({fx.TRACES})
SELECT coalesce(parse_error, 'unknown') AS parse_error, count(*) AS n FROM t WHERE reasoning = ''
GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""",
)
def failure_reasons(spark, sf):
    return op.failure_reasons(fx.traces(spark, sf))


_BARE = "[; ]+$"


@query(
    "trace_mismatch_kinds",
    f"""WITH t AS ({fx.TRACES}), f AS (SELECT generated_cypher AS g, cypher AS r,
  {d.norm_ws('generated_cypher')} AS gn, {d.norm_ws('cypher')} AS rn FROM t WHERE generated_cypher <> cypher AND coalesce(reasoning, '') <> '')
SELECT CASE WHEN gn = rn THEN 'whitespace' WHEN lower(gn) = lower(rn) THEN 'case'
  WHEN {d.rx('gn', _BARE, '')} = {d.rx('rn', _BARE, '')} THEN 'semicolon'
  WHEN regexp_matches(r, '''[^'']{{200,}}''') AND len(g) < len(r) THEN 'truncated_literal' ELSE 'other' END AS kind,
  count(*) AS n FROM f GROUP BY 1""",
)
def trace_mismatch_kinds(spark, sf):
    return op.trace_mismatch_kinds(fx.traces(spark, sf), "generated_cypher", "cypher")


def _match(e):
    return d.norm_ws(f"regexp_extract({e}, '(?is)^(.*?)\\bRETURN\\b', 1)")


def return_sql(e):
    tail = f"regexp_extract({e}, '(?is)\\bRETURN\\b(.*)$', 1)"
    return d.norm_ws(d.rx(tail, r"(?is)\b(ORDER\s+BY|LIMIT|SKIP)\b.*$", ""))


@query(
    "pred_mismatch_kinds",
    f"""WITH p AS ({P}), w AS (SELECT arm, {_match('predicted_cypher')} AS pm, {_match('reference_cypher')} AS rm,
  {return_sql('predicted_cypher')} AS pr, {return_sql('reference_cypher')} AS rr FROM p WHERE NOT {EM})
SELECT arm, CASE WHEN pm <> rm THEN 'different_match' WHEN pr = rr THEN 'other'
  WHEN {d.rx('pr', r'(?i) AS \w+', '')} = {d.rx('rr', r'(?i) AS \w+', '')} THEN 'alias_only'
  ELSE 'different_return' END AS kind, count(*) AS n FROM w GROUP BY ALL""",
)
def pred_mismatch_kinds(spark, sf):
    return op.pred_mismatch_kinds(fx.predictions(spark, sf), "predicted_cypher", "reference_cypher")
