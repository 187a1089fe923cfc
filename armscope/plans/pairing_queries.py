"""Registered queries for pairing, leakage and overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from armscope.functions.text import norm_ws
from armscope.operators import pairing as op
from armscope.plans import duck as d
from armscope.plans import fixtures as fx
from armscope.plans.registry import query
from armscope.plans.scoring_queries import PAIRED_SQL, paired_em

P = fx.PREDICTIONS
SIDES = fx.LEAK_SIDES


@query("pair_arms_strict", PAIRED_SQL)
def pair_arms_strict(spark, sf):
    return paired_em(spark, sf)


@query(
    "pair_arms_inner",
    f"""WITH s AS ({fx.SQL_PREDICTIONS})
SELECT a.instance_id, a.predicted_sql AS direct_predicted_sql, b.predicted_sql AS cot_predicted_sql
FROM s a JOIN s b ON a.instance_id = b.instance_id WHERE a.arm = 'direct' AND b.arm = 'cot'
  AND a.predicted_sql <> '' AND b.predicted_sql <> ''""",
)
def pair_arms_inner(spark, sf):
    preds = fx.fixture(spark, sf, fx.SQL_PREDICTIONS).filter(F.col("predicted_sql") != "")
    return op.pair_arms(
        fx.arm(preds, "direct"), fx.arm(preds, "cot"), "instance_id", ["predicted_sql"]
    )


@query(
    "matched_check",
    f"""WITH s AS ({fx.SQL_PREDICTIONS}), f AS (SELECT DISTINCT instance_id, arm FROM s WHERE predicted_sql <> ''),
w AS (SELECT instance_id, count(*) AS w FROM f GROUP BY ALL)
SELECT arm, count(*) AS n_ids, {d.count_if('w < 2')} AS n_unmatched FROM f JOIN w USING (instance_id) GROUP BY arm""",
)
def matched_check(spark, sf):
    preds = fx.fixture(spark, sf, fx.SQL_PREDICTIONS).filter(F.col("predicted_sql") != "")
    return op.arm_mismatches(preds, 2)


SCHEMAS = f"""SELECT n_name AS db_name, CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE
  concat('CREATE TABLE ', n_name, ' (', r_name, ')') END AS schema_text
FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey"""


@query(
    "attach_schema",
    f"""WITH s AS ({SCHEMAS}), p AS ({P})
SELECT instance_id, arm, p.db_name, question, s.schema_text FROM p JOIN s ON p.db_name = s.db_name WHERE s.schema_text <> ''""",
)
def attach_schema(spark, sf):
    examples = fx.predictions(spark, sf).select("instance_id", "arm", "db_name", "question")
    return op.attach_schema(examples, fx.fixture(spark, sf, SCHEMAS), "db_name", "schema_text")


@query(
    "collect_candidates",
    f"""WITH c AS ({fx.CANDIDATES})
SELECT instance_id, 0::BIGINT AS part, list(candidate ORDER BY cand_idx) AS candidates
FROM c GROUP BY ALL""",
)
def collect_candidates(spark, sf):
    return op.collect_candidates(
        fx.fixture(spark, sf, fx.CANDIDATES), "instance_id", "cand_idx", "candidate"
    )


def sides(spark, sf):
    rows = fx.fixture(spark, sf, SIDES)
    return rows.filter(F.col("side") == "train"), rows.filter(F.col("side") == "test")


def _level_sql(level: str, key: str) -> str:
    return f"""SELECT '{level}' AS level, count(*) AS n_test, {d.count_if(f"{key} IN (SELECT {key} FROM s WHERE side = 'train')")} AS n_seen,
  {d.rate(f"{key} IN (SELECT {key} FROM s WHERE side = 'train')")} AS share_seen FROM s WHERE side = 'test'"""


@query(
    "leakage_audit",
    f"""WITH s0 AS ({SIDES}), s AS (SELECT *, {d.norm_ws('question')} AS qk,
  {d.norm_ws('question')} || chr(1) || {d.norm_ws('query')} AS pk FROM s0)
{_level_sql('id', 'instance_id')} UNION ALL {_level_sql('question', 'qk')} UNION ALL {_level_sql('pair', 'pk')}""",
)
def leakage_audit(spark, sf):
    train, test = sides(spark, sf)
    return op.leakage_audit(train, test, "instance_id", "question", "query")


@query(
    "seen_unseen_scores",
    f"""WITH s0 AS ({SIDES}), s AS (SELECT *, {d.norm_ws('question')} AS qk FROM s0),
t AS (SELECT qk IN (SELECT qk FROM s WHERE side = 'train') AS seen, quality = 1 AS dd, toxic = 1 AS cc FROM s WHERE side = 'test')
SELECT seen, count(*) AS n, {d.rate('dd')} AS direct_em, {d.rate('cc')} AS cot_em,
  {d.count_if('dd AND NOT cc')} AS direct_only, {d.count_if('cc AND NOT dd')} AS cot_only FROM t GROUP BY seen""",
)
def seen_unseen_scores(spark, sf):
    train, test = sides(spark, sf)
    paired = test.withColumn("direct_em", F.col("quality") == 1).withColumn(
        "cot_em", F.col("toxic") == 1
    )
    return op.seen_unseen_scores(train, paired)


@query(
    "cross_split_overlap",
    f"""WITH k AS (SELECT DISTINCT source, {d.norm_ws('text')} AS t FROM documents),
n AS (SELECT source, count(*) AS n FROM k GROUP BY ALL),
m AS (SELECT a.source AS split_a, b.source AS split_b, count(*) AS n_shared FROM k a JOIN k b ON a.t = b.t GROUP BY ALL),
z AS (SELECT x.source AS split_a, y.source AS split_b FROM n x, n y)
SELECT z.split_a, z.split_b, coalesce(n_shared, 0) AS n_shared, n.n AS n_a, coalesce(n_shared, 0)::DOUBLE / n.n AS share_of_a
FROM z JOIN n ON n.source = z.split_a LEFT JOIN m ON m.split_a = z.split_a AND m.split_b = z.split_b""",
)
def cross_split_overlap(spark, sf):
    docs = fx.read_table(spark, sf, "documents").select("source", "text")
    return op.cross_split_overlap(docs, op.question_key(F.col("text")), "source")


def _decon(level: str, key: str) -> str:
    return f"""WITH s0 AS ({SIDES}), s AS (SELECT *, {key} AS kk FROM s0)
SELECT instance_id, source FROM s WHERE side = 'train' AND kk NOT IN (SELECT kk FROM s WHERE side = 'test')"""


@query("decontaminate_id", _decon("id", "CAST(instance_id AS VARCHAR)"))
def decontaminate_id(spark, sf):
    train, test = sides(spark, sf)
    return op.decontaminate(train, test, "id", "instance_id", "question", "query").select("instance_id", "source")


@query("decontaminate_question", _decon("question", d.norm_ws("question")))
def decontaminate_question(spark, sf):
    train, test = sides(spark, sf)
    return op.decontaminate(train, test, "question", "instance_id", "question", "query").select(
        "instance_id", "source"
    )


@query(
    "decontaminate_pair",
    _decon("pair", f"{d.norm_ws('question')} || chr(1) || {d.norm_ws('query')}"),
)
def decontaminate_pair(spark, sf):
    train, test = sides(spark, sf)
    return op.decontaminate(train, test, "pair", "instance_id", "question", "query").select(
        "instance_id", "source"
    )


@query(
    "common_instances",
    f"""WITH s AS ({fx.SQL_PREDICTIONS}), f AS (SELECT * FROM s WHERE predicted_sql <> '')
SELECT instance_id, arm, predicted_sql FROM f WHERE instance_id IN
  (SELECT instance_id FROM f GROUP BY 1 HAVING count(DISTINCT arm) = 2)""",
)
def common_instances(spark, sf):
    preds = fx.fixture(spark, sf, fx.SQL_PREDICTIONS).filter(F.col("predicted_sql") != "")
    return op.common_instances(preds, 2).select("instance_id", "arm", "predicted_sql")


@query(
    "distinct_questions",
    f"""WITH p AS ({P}) SELECT arm, count(*) AS n_rows, count(DISTINCT {d.norm_ws('question')}) AS n_questions FROM p GROUP BY arm""",
)
def distinct_questions(spark, sf):
    return fx.predictions(spark, sf).groupBy("arm").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(norm_ws(F.col("question"))).alias("n_questions"),
    )
