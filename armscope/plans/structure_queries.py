"""Registered queries for the structure of query texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from armscope.functions.text import norm_ws
from armscope.operators import structure as op
from armscope.operators.pairing import pair_arms
from armscope.operators.scoring import return_part
from armscope.plans import duck as d
from armscope.plans import fixtures as fx
from armscope.plans.registry import query
from armscope.plans.result_queries import OUTCOMES_SQL, outcomes

P = fx.PREDICTIONS
PRED, REF = "predicted_cypher", "reference_cypher"
EM = f"({d.norm_ws(PRED)} = {d.norm_ws(REF)})"

ARROW = r"\(:([A-Za-z_]\w*)\)-\[:([A-Za-z_]\w*)\]->\(:([A-Za-z_]\w*)\)"


def decl_sql(rows: str, key: str, text: str = "schema_text") -> str:
    """(key, label_a, rel, label_b) for every relation declared in a text."""
    part = lambda i: f"unnest(regexp_extract_all({text}, '{ARROW}', {i}))"
    return f"""SELECT DISTINCT {key}, least(s, t) AS label_a, rel, greatest(s, t) AS label_b FROM
  (SELECT {key}, {part(1)} AS s, {part(2)} AS rel, {part(3)} AS t FROM ({rows}))"""


@query(
    "schema_relations",
    f"""WITH p AS ({P}), s AS (SELECT DISTINCT schema_text, sha256(schema_text) AS schema_key FROM p)
{decl_sql('SELECT * FROM s', 'schema_key')}""",
)
def schema_relations(spark, sf):
    return op.schema_relations(fx.predictions(spark, sf), "schema_text")


# The same relations with their labels in bold, as another kind of schema text writes them, beside those in arrows.
BOLD_SCHEMAS = f"""SELECT instance_id, CASE WHEN k % 3 = 0 THEN schema_text ELSE
  replace(replace(replace(replace(schema_text, '(:', '**'), ')-[', '** -['), ']->', ']-> '), concat(')', chr(10)), concat('**', chr(10))) END AS schema_text
FROM ({P}) q"""
BOLD = r"\*\*(\w+)\*\* -\[:(\w+)\]-> \*\*(\w+)\*\*"


@query(
    "schema_relations_forms",
    f"""WITH p AS ({BOLD_SCHEMAS}), s AS (SELECT DISTINCT schema_text, sha256(schema_text) AS schema_key FROM p)
{decl_sql('SELECT * FROM s', 'schema_key')} UNION {decl_sql('SELECT * FROM s', 'schema_key').replace(ARROW, BOLD)}""",
)
def schema_relations_forms(spark, sf):
    """Relations of schema texts in two forms."""
    return op.schema_relations(fx.fixture(spark, sf, BOLD_SCHEMAS), "schema_text")


def paired_queries(spark, sf):
    preds = fx.predictions(spark, sf).withColumn("pred", F.col(PRED))
    return pair_arms(
        fx.arm(preds, "direct"), fx.arm(preds, "cot"), "instance_id", ["pred"], shared=[REF, "schema_text"]
    )


def schemas(spark, sf):
    """The schemas of one arm; both arms of an instance have the same."""
    return op.schema_dictionary(fx.arm(fx.predictions(spark, sf), "direct"), "schema_text")


def one_hop(spark, sf):
    return op.one_hop_rows(paired_queries(spark, sf), "instance_id", REF, "schema_text", schemas=schemas(spark, sf))


ONE_HOP_SQL = f"""
WITH p AS ({P}), w AS (SELECT a.instance_id, a.{REF} AS r, a.schema_text, a.{PRED} AS pd, b.{PRED} AS pc
  FROM p a JOIN p b ON a.instance_id = b.instance_id WHERE a.arm = 'direct' AND b.arm = 'cot'),
one AS (SELECT *, {d.relations('r')}[1] AS rel_type, regexp_extract_all(r, '\\(\\s*[a-zA-Z_]?\\w*\\s*:\\s*([A-Za-z_]\\w*)', 1) AS lb
  FROM w WHERE NOT regexp_matches(r, '(?i)\\bUNION\\b')
  AND {d.count_rx('r', r'(?i)\bOPTIONAL\s+MATCH\b')} = 0 AND {d.count_rx('r', r'(?i)\bMATCH\b')} = 1
  AND {d.count_rx('r', r'-\[')} = 1 AND regexp_extract(r, '-\\[[^\\]]*\\]', 0) NOT LIKE '%*%'),
dc AS ({decl_sql('SELECT * FROM one', 'instance_id')}),
hits AS (SELECT one.instance_id, count(DISTINCT dc.rel) AS ambiguity, bool_or(dc.rel = rel_type) AS known
  FROM one JOIN dc ON one.instance_id = dc.instance_id AND dc.label_a = least(lb[1], lb[2]) AND dc.label_b = greatest(lb[1], lb[2])
  WHERE len(lb) >= 2 GROUP BY ALL),
oh AS (SELECT one.instance_id, CAST(ambiguity AS INT) AS ambiguity, rel_type, [least(lb[1], lb[2]), greatest(lb[1], lb[2])] AS labels,
  CAST({d.norm_ws_query('pd')} = {d.norm_ws_query('r')} AS INT) AS direct_em,
  CAST({d.norm_ws_query('pc')} = {d.norm_ws_query('r')} AS INT) AS cot_em,
  CAST(list_contains({d.relations('pd')}, rel_type) AS INT) AS direct_correct_rel,
  CAST(list_contains({d.relations('pc')}, rel_type) AS INT) AS cot_correct_rel
  FROM one JOIN hits USING (instance_id) WHERE known)
"""


# Verdicts of the orders whose number is the instance's: not every instance was executed.
ONE_HOP_EXEC_SQL = (
    OUTCOMES_SQL.rstrip() + "," + ONE_HOP_SQL.strip().removeprefix("WITH").replace("oh AS (", "oh0 AS (")
    + """, oh AS (SELECT oh0.*, x.exec_match::INT AS direct_exec, y.exec_match::INT AS cot_exec FROM oh0
  LEFT JOIN (SELECT * FROM outc WHERE arm = 'direct') x ON x.instance_id = oh0.instance_id
  LEFT JOIN (SELECT * FROM outc WHERE arm = 'cot') y ON y.instance_id = oh0.instance_id)"""
)


@query(
    "ambiguity_exec_board",
    ONE_HOP_EXEC_SQL
    + """ SELECT CAST(least(ambiguity, 4) AS INT) AS ambiguity, count(*) AS n, count(direct_exec) AS n_exec,
  avg(direct_exec::DOUBLE) AS direct_exec, avg(cot_exec::DOUBLE) AS cot_exec, avg(cot_exec::DOUBLE) - avg(direct_exec::DOUBLE) AS delta_exec
FROM oh GROUP BY 1""",
)
def ambiguity_exec_board(spark, sf):
    """Execution match of one-hop questions by ambiguity; n_exec counts those that were executed."""
    done = outcomes(spark, sf)
    paired = paired_queries(spark, sf)
    for arm in ("direct", "cot"):
        flags = fx.arm(done, arm).select("instance_id", F.col("exec_match").cast("int").alias(f"{arm}_exec"))
        paired = paired.join(flags, "instance_id", "left")
    rows = op.one_hop_rows(paired, "instance_id", REF, "schema_text", schemas=schemas(spark, sf))
    board = op.ambiguity_board(rows, ["exec"])
    bucket = F.least(F.col("ambiguity"), F.lit(op.AMBIGUITY_CAP)).alias("ambiguity")
    return board.join(rows.groupBy(bucket).agg(F.count("direct_exec").alias("n_exec")), "ambiguity")


@query("one_hop_rows", ONE_HOP_SQL + "SELECT * REPLACE (array_to_string(labels, ',') AS labels) FROM oh")
def one_hop_rows(spark, sf):
    return one_hop(spark, sf).withColumn("labels", F.array_join("labels", ","))


@query(
    "ambiguity_board",
    ONE_HOP_SQL
    + """SELECT CAST(least(ambiguity, 4) AS INT) AS ambiguity, count(*) AS n, avg(direct_em::DOUBLE) AS direct_em, avg(cot_em::DOUBLE) AS cot_em,
  avg(cot_em::DOUBLE) - avg(direct_em::DOUBLE) AS delta_em, avg(direct_correct_rel::DOUBLE) AS direct_correct_rel,
  avg(cot_correct_rel::DOUBLE) AS cot_correct_rel, avg(cot_correct_rel::DOUBLE) - avg(direct_correct_rel::DOUBLE) AS delta_correct_rel
FROM oh GROUP BY 1""",
)
def ambiguity_board(spark, sf):
    return op.ambiguity_board(one_hop(spark, sf))


@query(
    "ambiguity_penalty",
    ONE_HOP_SQL
    + """, a AS (SELECT ambiguity, 'direct' AS arm, direct_correct_rel::DOUBLE AS v FROM oh
  UNION ALL SELECT ambiguity, 'cot', cot_correct_rel::DOUBLE FROM oh)
SELECT arm, avg(CASE WHEN ambiguity = 1 THEN v END) AS unambiguous, avg(CASE WHEN ambiguity >= 2 THEN v END) AS ambiguous,
  avg(CASE WHEN ambiguity >= 2 THEN v END) - avg(CASE WHEN ambiguity = 1 THEN v END) AS penalty FROM a GROUP BY arm""",
)
def ambiguity_penalty(spark, sf):
    return op.ambiguity_penalty(one_hop(spark, sf))


@query(
    "relations_used",
    f"""WITH p AS ({P}), u AS (SELECT instance_id, arm, {d.relations(PRED)} AS rs FROM p)
SELECT instance_id, arm, CAST(generate_subscripts(rs, 1) - 1 AS INT) AS pos, unnest(rs) AS rel FROM u""",
)
def relations_used(spark, sf):
    return op.relations_used(fx.predictions(spark, sf), ["instance_id", "arm"], PRED)


@query(
    "relation_counts",
    f"""WITH p AS ({P}), u AS (SELECT arm, unnest(list_distinct({d.relations(PRED)})) AS rel FROM p)
SELECT arm, rel, count(*) AS n_queries FROM u GROUP BY ALL""",
)
def relation_counts(spark, sf):
    return op.relation_counts(fx.predictions(spark, sf), ["arm"], PRED)


HOPS = {c: d.count_rx(c, r"-\[") for c in (PRED, REF)}


@query(
    "hop_board",
    f"""WITH p AS ({P})
SELECT arm, CAST({HOPS[REF]} AS INT) AS hops, count(*) AS n, {d.rate(EM)} AS em,
  avg(({HOPS[REF]} - {HOPS[PRED]})::DOUBLE) AS hop_deficit FROM p GROUP BY arm, 2""",
)
def hop_board(spark, sf):
    em = norm_ws(F.col(PRED)) == norm_ws(F.col(REF))
    return op.hop_board(fx.predictions(spark, sf), em, PRED, REF)


# Instances that direct solves and cot does not, with the cot prediction.
FAIL_SQL = f"""fails AS (SELECT b.* FROM p a JOIN p b ON a.instance_id = b.instance_id
  WHERE a.arm = 'direct' AND b.arm = 'cot' AND {d.norm_ws('a.' + PRED)} = {d.norm_ws('a.' + REF)}
  AND {d.norm_ws('b.' + PRED)} <> {d.norm_ws('b.' + REF)})"""

RC_SQL = f"""rc AS (SELECT *, {d.relations(PRED)} AS pr, {d.relations(REF)} AS rr FROM {{src}}),
rx AS (SELECT rid, arm, max(np) AS np, max(nr) AS nr, sum(least(cp, cr)) AS sh FROM
  (SELECT rid, arm, len(pr) AS np, len(rr) AS nr, len(list_filter(pr, lambda z: z = x)) AS cp,
     len(list_filter(rr, lambda z: z = x)) AS cr FROM (SELECT *, unnest(CASE WHEN len(pr) + len(rr) = 0 THEN [''] ELSE list_distinct(pr || rr) END) AS x FROM
       (SELECT instance_id || arm AS rid, arm, pr, rr FROM rc))) GROUP BY rid, arm),
st AS (SELECT rid, arm, CASE WHEN np = nr AND sh = nr THEN 'same' WHEN sh = np AND np < nr THEN 'dropped'
  WHEN sh = nr AND nr < np THEN 'added' WHEN sh = 0 THEN 'disjoint' ELSE 'overlap' END AS structure FROM rx)"""


def wrong(spark, sf):
    """Wrong predictions of both arms."""
    return fx.predictions(spark, sf).filter(norm_ws(F.col(PRED)) != norm_ws(F.col(REF)))


def cot_failures(spark, sf):
    """cot predictions that are wrong where direct is right."""
    preds = fx.predictions(spark, sf).withColumn("em", norm_ws(F.col(PRED)) == norm_ws(F.col(REF)))
    solved = fx.arm(preds, "direct").filter("em").select("instance_id")
    return fx.arm(preds, "cot").filter("NOT em").join(solved, "instance_id", "left_semi")


@query(
    "failure_structure",
    f"""WITH p AS ({P}), {FAIL_SQL}, {RC_SQL.replace('{src}', 'fails')},
names AS (SELECT unnest(['same', 'dropped', 'added', 'disjoint', 'overlap']) AS structure)
SELECT structure, {d.count_if('rid IS NOT NULL')} AS n,
  {d.count_if('rid IS NOT NULL')}::DOUBLE / (SELECT count(*) FROM st) AS share
FROM names LEFT JOIN st USING (structure) GROUP BY structure""",
)
def failure_structure(spark, sf):
    return op.failure_structure(cot_failures(spark, sf), PRED, REF)


def _matches(c):
    return d.count_rx(c, r"(?i)\bMATCH\b")


@query(
    "fragmentation",
    f"""WITH p AS ({P}) SELECT arm, data_source, count(*) AS n, {d.rate(f'{_matches(PRED)} >= 2')} AS fragmented_share
FROM p WHERE {_matches(REF)} = 1 GROUP BY ALL""",
)
def fragmentation(spark, sf):
    return op.fragmentation(fx.predictions(spark, sf), ["arm", "data_source"], PRED, REF)


SUBPATH_SQL = f"""
WITH p AS ({P}), {RC_SQL.replace('{src}', 'p')},
dp AS (SELECT rc.instance_id, rc.arm, pr, rr FROM rc JOIN st ON st.rid = rc.instance_id || rc.arm WHERE structure = 'dropped'),
sc AS (SELECT *, list_reduce(list_prepend({{'taken': 0, 'pos': 0, 'missed': -1, 'rel': ''}},
   list_transform(rr, lambda x: {{'taken': 0, 'pos': 0, 'missed': -1, 'rel': x}})),
   lambda a, x: {{'taken': a.taken + CASE WHEN coalesce(pr[a.taken + 1] = x.rel, false) THEN 1 ELSE 0 END,
     'pos': a.pos + 1,
     'missed': CASE WHEN coalesce(pr[a.taken + 1] = x.rel, false) OR a.missed >= 0 THEN a.missed ELSE a.pos END, 'rel': ''}}) AS s FROM dp)
SELECT instance_id, arm, s.taken = len(pr) AS clean,
  CASE WHEN s.missed = 0 THEN 'start' WHEN s.missed = len(rr) - 1 THEN 'end' ELSE 'mid' END AS missing_at,
  CAST(len(rr) - len(pr) AS INT) AS n_missing FROM sc"""


@query("clean_subpath", SUBPATH_SQL)
def clean_subpath(spark, sf):
    return op.clean_subpath(fx.predictions(spark, sf), ["instance_id", "arm"], PRED, REF)


@query(
    "subpath_board",
    f"""WITH q AS ({SUBPATH_SQL}) SELECT arm, missing_at, count(*) AS n, {d.rate('clean')} AS clean_share FROM q GROUP BY ALL""",
)
def subpath_board(spark, sf):
    return op.subpath_board(
        op.clean_subpath(fx.predictions(spark, sf), ["instance_id", "arm"], PRED, REF)
    )


PLAN_SQL = f"""
WITH p AS ({P}), c AS (SELECT * FROM p WHERE arm = 'cot'),
r AS (SELECT instance_id, arm, reasoning, unnest({d.relations(REF)}) AS rel FROM c),
q AS (SELECT instance_id, unnest({d.relations(PRED)}) AS rel FROM c),
n AS (SELECT instance_id, arm, reasoning, rel, count(*) AS n_ref FROM r GROUP BY ALL),
m AS (SELECT instance_id, rel, count(*) AS n_pred FROM q GROUP BY ALL),
l AS (SELECT n.*, unnest(range(0, greatest(n_ref - coalesce(n_pred, 0), 0))) AS i FROM n LEFT JOIN m USING (instance_id, rel))
SELECT instance_id, arm, rel, NOT regexp_matches(reasoning, '(^|\\W)' || rel || '(\\W|$)') AS absent_from_plan FROM l"""


@query("plan_vs_query", PLAN_SQL)
def plan_vs_query(spark, sf):
    cot = fx.arm(fx.predictions(spark, sf), "cot")
    return op.plan_vs_query(cot, ["instance_id", "arm"], PRED, REF, "reasoning")


@query(
    "plan_board",
    f"WITH l AS ({PLAN_SQL}) SELECT arm, count(*) AS n_lost, {d.rate('absent_from_plan')} AS planning_share FROM l GROUP BY arm",
)
def plan_board(spark, sf):
    return op.plan_board(plan_vs_query(spark, sf))


def _lits(c):
    return (
        f"list_distinct(list_transform(regexp_extract_all({c}, '''([^'']*)''|\"([^\"]*)\"'), lambda q: substr(q, 2, len(q) - 2)))"
    )


VALUES_SQL = f"""
WITH p AS ({P}), l AS (SELECT instance_id, arm, reasoning, {_lits(PRED)} AS pl, {_lits(REF)} AS rl FROM p),
m AS (SELECT *, list_filter(pl, lambda x: NOT list_contains(rl, x)) AS nw, list_filter(rl, lambda x: NOT list_contains(pl, x)) AS ls FROM l)
SELECT instance_id, arm, CASE WHEN len(ls) = 0 AND len(nw) = 0 THEN 'same' WHEN len(nw) = 0 THEN 'dropped'
  WHEN len(ls) = 0 THEN 'added' ELSE 'swapped' END AS change,
  len(list_filter(nw, lambda v: v <> '' AND contains(reasoning, v))) > 0 AS wrong_in_reasoning FROM m"""


@query("filter_values", VALUES_SQL)
def filter_values(spark, sf):
    return op.filter_values(fx.predictions(spark, sf), ["instance_id", "arm"], PRED, REF, "reasoning")


@query(
    "filter_value_board",
    f"""WITH v AS ({VALUES_SQL})
SELECT arm, change, count(*) AS n, {d.count_if('wrong_in_reasoning')} AS n_wrong_in_reasoning FROM v GROUP BY ALL""",
)
def filter_value_board(spark, sf):
    return op.filter_value_board(filter_values(spark, sf))


def _return_sql(e):
    tail = f"regexp_extract({e}, '(?is)\\bRETURN\\b(.*)$', 1)"
    return d.norm_ws(d.rx(tail, r"(?is)\b(ORDER\s+BY|LIMIT|SKIP)\b.*$", ""))


@query(
    "error_attribution",
    f"""WITH p0 AS ({P}), p AS (SELECT * FROM p0 WHERE NOT {EM}), {RC_SQL.replace('{src}', 'p')},
f AS (SELECT rc.arm, structure = 'dropped' AS cut, list_sort({_lits(PRED)}) <> list_sort({_lits(REF)}) AS v,
  {_return_sql(PRED)} <> {_return_sql(REF)} AS rt FROM rc JOIN st ON st.rid = rc.instance_id || rc.arm)
SELECT arm, count(*) AS n, {d.rate('cut AND NOT (v OR rt)')} AS truncation_alone, {d.rate('cut AND (v OR rt)')} AS truncation_with_others,
  {d.rate('v')} AS wrong_value, {d.rate('rt')} AS wrong_return FROM f GROUP BY arm""",
)
def error_attribution(spark, sf):
    return op.error_attribution(wrong(spark, sf), PRED, REF, return_part)


# Five arms of an ablation: verdicts of the candidates, one arm per sample.
ARMS = ["direct", "qdecomp", "holistic", "enum", "forward"]
LADDER = f"""
WITH c AS ({fx.CANDIDATES})
SELECT instance_id, CASE cand_idx WHEN 0 THEN 'direct' WHEN 1 THEN 'qdecomp' WHEN 2 THEN 'holistic' WHEN 3 THEN 'enum' ELSE 'forward' END AS arm,
  CASE WHEN k % 2 = 0 THEN 'iid' ELSE 'length' END AS split, candidate, reference_cypher, candidate = reference_cypher AS exec_match FROM c"""


@query(
    "ladder_board",
    f"""WITH o AS ({LADDER}),
cm AS (SELECT * FROM o WHERE instance_id IN (SELECT instance_id FROM o GROUP BY 1 HAVING count(DISTINCT arm) = 5)),
a AS (SELECT split, arm, {d.rate('exec_match')} AS accuracy, count(DISTINCT instance_id) AS n FROM cm GROUP BY ALL),
b AS (SELECT split, max(CASE WHEN arm = 'qdecomp' THEN accuracy END) AS base, max(CASE WHEN arm = 'direct' THEN accuracy END) AS ceil FROM a GROUP BY ALL)
SELECT a.split, a.n, a.arm, accuracy, accuracy - base AS delta_to_base,
  CASE WHEN ceil - base <> 0 THEN (accuracy - base) / (ceil - base) END AS recovered_share FROM a JOIN b ON a.split = b.split""",
)
def ladder_board(spark, sf):
    return op.ladder_board(fx.fixture(spark, sf, LADDER), ARMS, base="qdecomp", ceiling="direct")
