"""Registered queries for votes, selection and seeded samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from armscope.functions.keys import text_key
from armscope.functions.text import norm_ws
from armscope.operators import voting as op
from armscope.plans import duck as d
from armscope.plans import fixtures as fx
from armscope.plans.registry import query

C = fx.CANDIDATES
TURNS = "SELECT CAST(conv_id AS STRING) AS instance_id, turn AS cand_idx, text AS candidate FROM {conversations}"


def vote_sql(cands: str) -> str:
    return f"""
WITH c AS ({cands}), g AS (SELECT instance_id, {d.norm_ws('candidate')} AS t, count(*) AS votes, min(cand_idx) AS f
  FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY votes DESC, f) AS rn,
  sum(votes) OVER (PARTITION BY instance_id) AS n FROM g)
SELECT instance_id, t AS voted, votes, CAST(n AS BIGINT) AS n_candidates FROM r WHERE rn = 1"""


@query("string_vote", vote_sql(C))
def string_vote(spark, sf):
    return op.string_vote(fx.fixture(spark, sf, C))


@query("string_vote_conversations", vote_sql(TURNS))
def string_vote_conversations(spark, sf):
    return op.string_vote(fx.fixture(spark, sf, TURNS))


# The result of a candidate stands for its executed text: case and blanks do not
# change it, a lower-case query fails, and so do some references.
FP_SQL = f"""CASE WHEN candidate = lower(candidate) THEN NULL ELSE replace({d.norm_ws('candidate')}, ' ;', '') END"""
REF_SQL = f"CASE WHEN k % 37 = 0 THEN NULL ELSE {d.norm_ws('reference_cypher')} END"


def executed(spark, sf):
    """(candidates with fp, references with ref_fp and ref_error)."""
    cands = fx.fixture(spark, sf, C)
    text = F.col("candidate")
    fp = F.when(text != F.lower(text), text_key(F.replace(norm_ws(text), F.lit(" ;"), F.lit(""))))
    with_fp = cands.withColumn("fp", fp)
    failed = F.col("k") % 37 == 0
    refs = cands.groupBy("instance_id").agg(
        F.max(F.when(~failed, text_key(norm_ws(F.col("reference_cypher"))))).alias("ref_fp"),
        F.max(F.when(failed, F.lit("db: gone"))).alias("ref_error"),
    )
    return with_fp, refs


OUT_SQL = f"""
WITH c AS ({C}), e AS (SELECT *, {FP_SQL} AS fp, {REF_SQL} AS ref_fp FROM c),
g AS (SELECT instance_id, fp, count(*) AS votes, min(cand_idx) AS f, arg_min(candidate, cand_idx) AS rep
  FROM e WHERE fp IS NOT NULL GROUP BY ALL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY votes DESC, f) AS rn FROM g) WHERE rn = 1),
i AS (SELECT instance_id, max(ref_fp) AS ref_fp, max(CASE WHEN k % 37 = 0 THEN 'db: gone' END) AS ref_error,
  arg_min(candidate, cand_idx) AS first_c, {d.count_if('fp IS NOT NULL')} AS n_exec, {d.count_if('fp = ref_fp')} AS n_hit
  FROM e GROUP BY instance_id),
outc AS (SELECT i.instance_id, coalesce(w.fp = i.ref_fp, false) AS exec_match, coalesce(w.rep, first_c) AS selected_query,
  n_hit AS n_candidates_matching_ref, n_exec AS n_candidates_executed, ref_error
  FROM i LEFT JOIN w USING (instance_id))
"""


@query("result_vote", OUT_SQL + "SELECT * FROM outc")
def result_vote(spark, sf):
    return op.selection_outcomes(*executed(spark, sf))


@query(
    "selection_board",
    OUT_SQL
    + f"""SELECT count(*) AS valid_instances, {d.count_if('exec_match')} AS match_count,
  {d.rate('exec_match')} AS select_em, {d.count_if('n_candidates_matching_ref > 0')} AS oracle_count,
  {d.rate('n_candidates_matching_ref > 0')} AS oracle_em,
  {d.count_if('exec_match')}::DOUBLE / {d.count_if('n_candidates_matching_ref > 0')} AS captured_share
FROM outc WHERE ref_error IS NULL""",
)
def selection_board(spark, sf):
    return op.selection_board(op.selection_outcomes(*executed(spark, sf)))


@query(
    "oracle_anatomy",
    OUT_SQL
    + f""", k AS (SELECT CASE WHEN exec_match THEN 'solved' WHEN n_candidates_matching_ref > 0 THEN 'addressable'
  ELSE 'generation_bound' END AS kind, n_candidates_matching_ref AS m FROM outc WHERE ref_error IS NULL)
SELECT kind, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER ()::DOUBLE AS share, {d.rate('m = 1')} AS lone_correct_share
FROM k GROUP BY kind""",
)
def oracle_anatomy(spark, sf):
    return op.oracle_anatomy(op.selection_outcomes(*executed(spark, sf)))


@query(
    "agreement",
    f"""WITH c AS ({C}), g AS (SELECT instance_id, {d.norm_ws('candidate')} AS t, count(*) AS v FROM c GROUP BY ALL),
m AS (SELECT instance_id, max(v) AS top FROM g GROUP BY ALL)
SELECT count(*) AS n, {d.rate('top >= 5')} AS share_full, {d.rate('top >= 3')} AS share_most FROM m""",
)
def agreement(spark, sf):
    return op.agreement(fx.fixture(spark, sf, C), 5, 3)


VERIFIED_SQL = f"""
WITH c AS ({C}), e AS (SELECT *, {FP_SQL} AS fp, {REF_SQL} AS ref_fp FROM c),
h AS (SELECT instance_id, min(cand_idx) AS cand_idx, arg_min(reasoning, cand_idx) AS reasoning,
  arg_min(candidate, cand_idx) AS qy FROM e WHERE fp = ref_fp AND candidate <> '' GROUP BY ALL),
a AS (SELECT instance_id, max(k) % 37 = 0 AS failed FROM c GROUP BY ALL),
audit AS (SELECT a.instance_id, CASE WHEN failed THEN 'ref_failed' WHEN h.cand_idx IS NULL THEN 'no_correct_candidate'
  ELSE 'kept' END AS status, CASE WHEN failed THEN 'db: gone' END AS ref_err FROM a LEFT JOIN h USING (instance_id))
"""


def verified(spark, sf):
    cands, refs = executed(spark, sf)
    return op.verified_traces(cands.withColumnRenamed("candidate", "query"), refs)


@query(
    "verified_traces",
    VERIFIED_SQL + 'SELECT instance_id, cand_idx, reasoning, qy AS "query" FROM h',
)
def verified_traces(spark, sf):
    return verified(spark, sf)[0]


@query("verified_audit", VERIFIED_SQL + "SELECT * FROM audit")
def verified_audit(spark, sf):
    return verified(spark, sf)[1]


@query(
    "verified_keep_rate",
    VERIFIED_SQL
    + f"""SELECT count(*) AS examined, {d.count_if("status = 'kept'")} AS kept,
  {d.count_if("status = 'no_correct_candidate'")} AS no_correct_candidate, {d.count_if("status = 'ref_failed'")} AS ref_failed,
  {d.count_if("status = 'kept'")}::DOUBLE / {d.count_if("status <> 'ref_failed'")} AS keep_rate FROM audit""",
)
def verified_keep_rate(spark, sf):
    return op.keep_rate(verified(spark, sf)[1])


def order_sql(key: str, seed: int = 42) -> str:
    return f"md5('{seed}|' || {key})"


@query(
    "pilot_by_source",
    f"""WITH t AS ({fx.TRACES}), r AS (SELECT instance_id, data_source, {order_sql('instance_id')} AS o,
  row_number() OVER (PARTITION BY data_source ORDER BY {order_sql('instance_id')}) AS rn FROM t),
s AS (SELECT *, greatest(1, 50 // (SELECT count(DISTINCT data_source) FROM t)) AS share FROM r)
SELECT instance_id, data_source FROM s
ORDER BY CASE WHEN rn <= share THEN 0 ELSE 1 END, CASE WHEN rn <= share THEN data_source END, o LIMIT 50""",
)
def pilot_by_source(spark, sf):
    return op.pilot_by_source(
        fx.traces(spark, sf).select("instance_id", "data_source"), "instance_id", "data_source", 50
    )


@query(
    "pilot_by_size",
    f"""WITH r AS ({fx.runs_sql('direct')}), k AS (SELECT instance_id, num_nodes,
  row_number() OVER (PARTITION BY num_nodes ORDER BY {order_sql('instance_id')}) AS rn FROM r WHERE side = 'ref')
SELECT instance_id, num_nodes FROM k WHERE rn <= 5 ORDER BY num_nodes, rn LIMIT 20""",
)
def pilot_by_size(spark, sf):
    refs = fx.fixture(spark, sf, fx.runs_sql("direct")).filter(F.col("side") == "ref")
    return op.pilot_by_size(refs.select("instance_id", "num_nodes"), "instance_id", "num_nodes")


@query(
    "seeded_limit",
    f"""WITH p AS ({fx.SQL_PREDICTIONS})
SELECT instance_id, reference_sql FROM p WHERE arm = 'direct' ORDER BY {order_sql('instance_id')} LIMIT 100""",
)
def seeded_limit(spark, sf):
    preds = fx.arm(fx.fixture(spark, sf, fx.SQL_PREDICTIONS), "direct")
    return op.seeded_limit(preds.select("instance_id", "reference_sql"), "instance_id", 100)


@query(
    "review_sample_failures",
    f"""WITH t AS ({fx.TRACES})
SELECT instance_id, data_source, question, left(cypher, 200) AS cypher, coalesce(parse_error, 'unknown') AS error,
  left(raw_response, 500) AS raw_response FROM t WHERE reasoning = '' ORDER BY {order_sql('instance_id')} LIMIT 10""",
)
def review_sample_failures(spark, sf):
    return op.review_sample(fx.traces(spark, sf), "instance_id", 10, failures=True)


@query(
    "review_sample_successes",
    f"""WITH t AS ({fx.TRACES})
SELECT instance_id, data_source, question, left(cypher, 200) AS cypher, reasoning,
  left(generated_cypher, 200) AS generated_cypher FROM t WHERE reasoning <> '' ORDER BY {order_sql('instance_id')} LIMIT 10""",
)
def review_sample_successes(spark, sf):
    return op.review_sample(fx.traces(spark, sf), "instance_id", 10)
