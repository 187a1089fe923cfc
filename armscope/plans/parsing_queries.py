"""Registered queries for parsing and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from armscope.operators import parsing as op
from armscope.plans import duck as d
from armscope.plans import fixtures as fx
from armscope.plans.registry import query


def _unfence(e: str) -> str:
    opened = d.rx(d.strip_blank(e), f"^```(?:cypher)?{d.WS}*", "")
    return d.strip_blank(d.rx(opened, f"\\n?```{d.WS}*$", ""))


_HAS_R = "regexp_matches(raw_text, '(?is)(?:reasoning|thinking|explanation)\\s*:')"
_HAS_Q = "regexp_matches(raw_text, '(?is)(?:cypher|query)\\s*(?:output)?\\s*:')"
_FREE_R = d.rx("regexp_extract(raw_text, '(?is)(?:reasoning|thinking|explanation)\\s*:\\s*(.*)$', 1)", r"(?is)(?:cypher|query)\s*:.*$", "")
_FREE_Q = "regexp_extract(raw_text, '(?is)(?:cypher|query)\\s*(?:output)?\\s*:\\s*(.*)$', 1)"
_KEYWORDS = " OR ".join(f"contains(upper(q), '{k}')" for k in ["MATCH", "RETURN", "CALL", "CREATE", "MERGE"])

PARSED_SQL = f"""
WITH w AS ({fx.RAW_REPLIES}), t AS (SELECT *, regexp_extract(raw_text, '(?s)<reasoning>(.*?)</reasoning>', 1) AS rt,
  regexp_extract(raw_text, '(?s)<cypher>(.*?)</cypher>', 1) AS qt FROM w),
f AS (SELECT *, {_HAS_R} AND {_HAS_Q} AS free,
  CASE WHEN contains(raw_text, '</reasoning>') THEN {d.strip_blank("str_split(raw_text, '</reasoning>')[-1]")} ELSE '' END AS aft,
  CASE WHEN contains(raw_text, '<cypher>') THEN {d.strip_blank("str_split(raw_text, '<cypher>')[1]")} ELSE '' END AS bef FROM t),
x AS (SELECT *, CASE WHEN rt <> '' THEN {d.strip_blank('rt')} WHEN qt <> '' THEN bef WHEN free THEN {d.strip_blank(_FREE_R)} ELSE '' END AS r,
  CASE WHEN qt <> '' THEN {_unfence('qt')} WHEN rt <> '' THEN {_unfence('aft')} WHEN free THEN {_unfence(_FREE_Q)} ELSE '' END AS q FROM f),
parsed AS (SELECT instance_id, r AS reasoning, q AS "query", CASE WHEN rt = '' AND qt = '' AND NOT free THEN 'No XML tags or recognizable markers found'
  WHEN (rt <> '' AND qt = '' AND aft = '') OR (qt <> '' AND rt = '' AND bef = '') THEN 'Could not extract both reasoning and cypher'
  WHEN len(r) < 20 THEN 'Reasoning too short (' || len(r) || ' chars)' WHEN len(q) < 5 THEN 'Cypher too short (' || len(q) || ' chars)'
  WHEN NOT ({_KEYWORDS}) THEN 'Cypher missing expected keywords (MATCH/RETURN/CALL/CREATE/MERGE)' END AS parse_error FROM x)
"""


@query("parse_traces", PARSED_SQL + "SELECT *, parse_error IS NULL AS ok FROM parsed")
def parse_traces(spark, sf):
    return op.parse_traces(fx.fixture(spark, sf, fx.RAW_REPLIES)).drop("raw_text")


@query(
    "parse_trace_errors",
    PARSED_SQL + "SELECT coalesce(parse_error, 'ok') AS status, count(*) AS n FROM parsed GROUP BY 1",
)
def parse_trace_errors(spark, sf):
    parsed = op.parse_traces(fx.fixture(spark, sf, fx.RAW_REPLIES))
    return parsed.groupBy(F.coalesce("parse_error", F.lit("ok")).alias("status")).agg(
        F.count("*").alias("n")
    )


_SET = "'`' || chr(10) || ' '"


def _marked_sql(raw: str, marker: str, fence: str) -> str:
    s = f"trim(str_split({raw}, '{marker}')[-1], {_SET})"
    head = f"left({s}, {len(fence) + 1})"
    if fence != "cypher":
        head = f"lower({head})"
    s = f"trim(CASE WHEN {head} = '{fence}' || chr(10) THEN substr({s}, {len(fence) + 2}) ELSE {s} END, {_SET})"
    if fence == "cypher":
        for tail in ["'**Explanation:**'", "chr(10) || chr(10) || 'Explanation:'", "chr(10) || chr(10) || 'Note:'"]:
            s = f"str_split({s}, {tail})[1]"
    return d.strip_blank(s)


@query(
    "parse_marked_output",
    f"""WITH m AS ({fx.MARKED}) SELECT instance_id, arm, {_marked_sql('raw_output', 'Cypher output:', 'cypher')} AS cypher,
  {_marked_sql('raw_sql', 'SQL output:', 'sql')} AS sql_text FROM m""",
)
def parse_marked_output(spark, sf):
    rows = fx.fixture(spark, sf, fx.MARKED)
    both = op.parse_marked_output(rows, "raw_output", "cypher", "cypher")
    return op.parse_marked_output(both, "raw_sql", "sql_text", "sql").select(
        "instance_id", "arm", "cypher", "sql_text"
    )


_BEFORE = "left(raw_sql, len(raw_sql) - len(str_split(raw_sql, 'SQL output:')[-1]) - len('SQL output:'))"
_HEAD = d.strip_blank(_BEFORE)


@query(
    "parse_marked_trace",
    f"""WITH m AS ({fx.MARKED}), h AS (SELECT *, contains(raw_sql, 'SQL output:') AS found, {_HEAD} AS hd FROM m)
SELECT instance_id, arm, CASE WHEN NOT found THEN '' WHEN lower(left(hd, 10)) = 'reasoning:' THEN {d.strip_blank('substr(hd, 11)')} ELSE hd END AS reasoning,
  CASE WHEN found THEN {d.strip_blank("trim(" + d.strip_blank("str_split(raw_sql, 'SQL output:')[-1]") + ", '`')")} ELSE '' END AS generated FROM h""",
)
def parse_marked_trace(spark, sf):
    return op.parse_marked_trace(fx.fixture(spark, sf, fx.MARKED), "raw_sql", "sql").select(
        "instance_id", "arm", "reasoning", "generated"
    )


@query(
    "clean_plain_output",
    f"""WITH m AS ({fx.MARKED}) SELECT instance_id, arm,
  trim(ltrim(trim(str_split(raw_output, '**Explanation:**')[1], '`' || chr(10)), 'cypher' || chr(10)), {_SET}) AS cleaned FROM m""",
)
def clean_plain_output(spark, sf):
    return op.clean_plain_output(fx.fixture(spark, sf, fx.MARKED), "raw_output", "cleaned").select(
        "instance_id", "arm", "cleaned"
    )


# Three question fields, some missing or still a template.
RAW_PAIRS = """
SELECT CAST(c_custkey AS STRING) AS instance_id,
  CASE c_custkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN concat('Where is ', chr(123), 'x', chr(125)) ELSE concat(' Where is ', c_name, '? ') END AS q1,
  CASE c_custkey % 3 WHEN 0 THEN 'NULL' ELSE concat('Who is ', c_name) END AS q2,
  CASE c_custkey % 7 WHEN 0 THEN NULL ELSE concat('What about ', c_name) END AS q3,
  CASE c_custkey % 11 WHEN 0 THEN '  ' ELSE concat('SELECT ', c_custkey) END AS sparql,
  CASE c_custkey % 13 WHEN 0 THEN '' ELSE concat('table ', c_mktsegment) END AS schema_text
FROM {customer}
"""


def _usable(c: str) -> str:
    s = d.strip_blank(f"coalesce({c}, '')")
    return f"CASE WHEN {s} <> '' AND lower({s}) NOT IN ('n/a', 'na', 'null', 'none') AND NOT contains({s}, chr(123)) AND NOT contains({s}, chr(125)) THEN {s} END"


@query(
    "clean_pairs",
    f"""WITH p AS ({RAW_PAIRS}), u AS (SELECT instance_id, coalesce({_usable('q1')}, {_usable('q2')}, {_usable('q3')}) AS question,
  {d.strip_blank('sparql')} AS sparql, {d.strip_blank('schema_text')} AS schema_text FROM p)
SELECT * FROM u WHERE question IS NOT NULL AND sparql <> '' AND schema_text <> ''""",
)
def clean_pairs(spark, sf):
    rows = fx.fixture(spark, sf, RAW_PAIRS)
    return op.clean_pairs(rows, ["q1", "q2", "q3"], "sparql", "schema_text").select(
        "instance_id", "question", "sparql", "schema_text"
    )


ALTERNATIVES = f"""WITH s AS ({fx.SQL_PREDICTIONS}) SELECT instance_id, arm, CASE WHEN k % 3 = 0 THEN '' ELSE predicted_sql END AS predicted_sql,
  CASE WHEN k % 3 = 0 THEN predicted_sql END AS prediction, CASE WHEN k % 2 = 0 THEN reference_sql END AS sql,
  reference_sql AS reference FROM s"""


@query(
    "resolve_fields",
    f"""WITH a AS ({ALTERNATIVES}) SELECT instance_id, arm, coalesce(nullif(predicted_sql, ''), nullif(prediction, ''), '') AS predicted_sql,
  coalesce(nullif(sql, ''), nullif(reference, ''), '') AS reference_sql FROM a""",
)
def resolve_fields(spark, sf):
    rows = fx.fixture(spark, sf, ALTERNATIVES)
    return op.resolve_fields(
        rows,
        {
            "predicted_sql": ["predicted_sql", "predicted", "prediction"],
            "reference_sql": ["reference_sql", "sql", "reference"],
        },
    ).select("instance_id", "arm", "predicted_sql", "reference_sql")


@query(
    "trainable",
    f"""WITH t AS ({fx.TRACES}) SELECT 'matched' AS mode, instance_id FROM t WHERE NOT {d.is_blank('reasoning')}
UNION ALL SELECT 'direct', instance_id FROM t WHERE NOT {d.is_blank('generated_cypher')}
UNION ALL SELECT 'cot', instance_id FROM t WHERE NOT {d.is_blank('reasoning')} AND NOT {d.is_blank('generated_cypher')}""",
)
def trainable(spark, sf):
    traces = fx.traces(spark, sf)
    modes = {
        "matched": op.trainable(traces, "direct", "generated_cypher"),
        "direct": op.trainable(traces, "direct", "generated_cypher", matched=False),
        "cot": op.trainable(traces, "cot", "generated_cypher", matched=False, need_query=True),
    }
    out = None
    for mode, rows in modes.items():
        part = rows.select(F.lit(mode).alias("mode"), "instance_id")
        out = part if out is None else out.unionByName(part)
    return out


ALIASES = "SELECT concat('demo_', lower(n_name)) AS alias, n_name AS db_name FROM {nation} WHERE n_regionkey <> 3"
ALIASED = """SELECT CAST(c_custkey AS STRING) AS instance_id, concat('demo_', lower(n_name)) AS alias_name
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""


@query(
    "db_reachable",
    f"WITH a AS ({ALIASES}), r AS ({ALIASED}) SELECT instance_id, alias_name, db_name FROM r JOIN a ON alias_name = alias",
)
def db_reachable(spark, sf):
    return op.db_reachable(fx.fixture(spark, sf, ALIASED), fx.fixture(spark, sf, ALIASES), "alias_name")


@query(
    "db_reach_counts",
    f"""WITH a AS ({ALIASES}), r AS ({ALIASED}) SELECT alias_name, {d.count_if('db_name IS NOT NULL')} AS n_mapped,
  {d.count_if('db_name IS NULL')} AS n_unmapped FROM r LEFT JOIN a ON alias_name = alias GROUP BY GROUPING SETS ((alias_name), ())""",
)
def db_reach_counts(spark, sf):
    return op.db_reach_counts(fx.fixture(spark, sf, ALIASED), fx.fixture(spark, sf, ALIASES), "alias_name")
