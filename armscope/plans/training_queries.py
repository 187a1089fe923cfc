"""Registered queries for training-set construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from armscope.functions.text import words
from armscope.operators import training as op
from armscope.operators.pairing import target_mismatches
from armscope.plans import duck as d
from armscope.plans import fixtures as fx
from armscope.plans.registry import query
from armscope.plans.source_queries import ID_LISTS, SCHEMA_TEXT_SQL, _POLE, schema_texts
from armscope.sources.records import label_split

SYSTEM = "Explain how the question leads to the query."
EXEMPLARS = [
    {
        "schema": "(:Person)-[:KNOWS]->(:Person)",
        "question": "Whom does Ann know?",
        "query": "MATCH (a:Person)-[:KNOWS]->(b:Person) WHERE a.name = 'Ann' RETURN b.name",
        "reasoning": "Ann is a Person; KNOWS leads to the others.",
    },
    {
        "schema": "(:Person)-[:LIVES_IN]->(:City)",
        "question": "How many people live in Oslo?",
        "query": "MATCH (p:Person)-[:LIVES_IN]->(c:City) WHERE c.name = 'Oslo' RETURN count(p)",
        "reasoning": "One hop, LIVES_IN, and a count.",
    },
]


def _lit(text: str) -> str:
    parts = text.replace("'", "''").split("\n")
    return "('" + "' || chr(10) || '".join(parts) + "')"


def _sql_template(template: str, names: dict[str, str] | None = None) -> str:
    """A turn format as an SQL expression, by default over schema_text, question and reference_cypher."""
    out, rest = [], template
    names = names or {"schema": "schema_text", "question": "question", "query": "reference_cypher"}
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            out.append(_lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        out.append(names[name])
    return " || ".join(out)


def _derived(query: str, style: str) -> str:
    chain = query.split("[:")[1].split("]")[0]
    return op.EXEMPLAR_TEXT[style].format(path=query.split("RETURN")[0].strip(), n=1, chain=chain)

def _system(style: str) -> str:
    """Styles without a schema in the user turn show it in the system turn."""
    return SYSTEM if "{schema}" in op.USER_TURNS[style] else SYSTEM + "\n\nSchema:\n{schema}"


def _transcript(style: str) -> str:
    turns = [""]
    for ex in EXEMPLARS:
        ex = dict(ex)
        if style in op.EXEMPLAR_TEXT:
            ex["reasoning"] = _derived(ex["query"], style)
        turns.append("user: " + op.USER_TURNS[style].format(**ex))
        turns.append("assistant: " + op.ASSISTANT_TURNS[style].format(**ex))
    return "\n---\n".join(turns) + "\n---\nuser: "


STYLES = list(op.USER_TURNS)


@query(
    "request_messages",
    f"WITH p AS ({fx.PREDICTIONS}) "
    + " UNION ALL ".join(
        f"SELECT instance_id, '{s}' AS style, {2 + 2 * len(EXEMPLARS)}::INT AS n_messages, "
        f"{_sql_template('system: ' + _system(s))} || {_lit(_transcript(s))} || {_sql_template(op.USER_TURNS[s])} AS transcript FROM p WHERE arm = 'cot'"
        for s in STYLES
    ),
)
def request_messages(spark, sf):
    rows = fx.arm(fx.predictions(spark, sf), "cot").select(
        "instance_id", "question", F.col("schema_text").alias("schema"), F.col("reference_cypher").alias("query")
    )
    out = None
    for style in STYLES:
        asked = op.request_messages(rows, style, _system(style), EXEMPLARS)
        lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
        part = asked.select(
            "instance_id", F.lit(style).alias("style"), F.size("messages").alias("n_messages"),
            F.array_join(lines, "\n---\n").alias("transcript"),
        )
        out = part if out is None else out.unionByName(part)
    return out


_PATH = d.strip_blank("str_split(reference_cypher, 'RETURN')[1]")
_RELS = "regexp_extract_all(reference_cypher, '-\\[:?(\\w+)', 1)"


_SHOWN = {"path": "pa", "n": "len(rs)", "chain": "CASE WHEN len(rs) > 0 THEN array_to_string(rs, ' -> ') ELSE '(none)' END"}


@query(
    "exemplar_reasoning",
    f"""WITH p AS ({fx.PREDICTIONS}), e AS (SELECT instance_id, {_PATH} AS pa, {_RELS} AS rs FROM p WHERE arm = 'cot')
SELECT instance_id, {_sql_template(op.EXEMPLAR_TEXT['holistic'], _SHOWN)} AS holistic,
  {_sql_template(op.EXEMPLAR_TEXT['enum'], _SHOWN)} AS enum FROM e""",
)
def exemplar_reasoning(spark, sf):
    rows = fx.arm(fx.predictions(spark, sf), "cot")
    both = op.with_exemplar_reasoning(rows, "reference_cypher", "holistic", "holistic")
    return op.with_exemplar_reasoning(both, "reference_cypher", "enum", "enum").select(
        "instance_id", "holistic", "enum"
    )


_PROMPT = (
    "'Generate Cypher statement to query a graph database.' || chr(10) || 'Use only the provided relationship types and properties in the schema.'"
    " || chr(10) || 'Schema: ' || schema || chr(10) || 'Question: ' || question || chr(10) || 'Cypher output:'"
)
SFT_SQL = f"""WITH t0 AS ({fx.TRACES}), t AS (SELECT * FROM t0 WHERE NOT {d.is_blank('reasoning')})
SELECT instance_id, 'direct' AS arm, {_PROMPT} AS "user", cypher AS assistant FROM t
UNION ALL SELECT instance_id, 'cot', {_PROMPT}, 'Reasoning:' || chr(10) || reasoning || chr(10) || chr(10) || 'Cypher output: ' || cypher FROM t"""


def sft_both(spark, sf):
    from armscope.operators.parsing import trainable

    traces = trainable(fx.traces(spark, sf), "cot")
    arms = [op.sft_rows(traces, a).withColumn("arm", F.lit(a)) for a in ("direct", "cot")]
    return arms[0].unionByName(arms[1]).select("instance_id", "arm", "user", "assistant")


@query("sft_rows", SFT_SQL)
def sft_rows(spark, sf):
    return sft_both(spark, sf)


@query(
    "matched_targets",
    f"""WITH s AS ({SFT_SQL}), p AS (SELECT a."user" AS ua, b."user" AS ub, a.assistant AS ta, b.assistant AS tb
  FROM s a JOIN s b ON a.instance_id = b.instance_id WHERE a.arm = 'direct' AND b.arm = 'cot')
SELECT count(*) AS n_ids, {d.count_if('ua <> ub')} AS n_other_prompt, {d.count_if('NOT ends_with(tb, ta)')} AS n_other_query FROM p""",
)
def matched_targets(spark, sf):
    return target_mismatches(sft_both(spark, sf))


MAX_LEN = 400
_TOKENS = d.words('"user" || chr(10) || \'<answer> \' || assistant')


@query(
    "loss_spans",
    f"""WITH s AS ({SFT_SQL}), k AS (SELECT instance_id, arm, ({_TOKENS})[1:{MAX_LEN}] AS t FROM s), p AS (
  SELECT *, coalesce(list_position(t, '<answer>'), 0) AS a, len(t) AS n FROM k)
SELECT instance_id, arm, CAST(n AS INT) AS n_tokens, CAST(CASE WHEN a > 0 THEN a ELSE n END AS INT) AS loss_from,
  CAST(n - CASE WHEN a > 0 THEN a ELSE n END AS INT) AS n_loss, a = 0 AS masked FROM p""",
)
def loss_spans(spark, sf):
    rows = sft_both(spark, sf).withColumn(
        "text", F.concat("user", F.lit("\n<answer> "), "assistant")
    )
    return op.loss_spans(rows, "text", "<answer>", MAX_LEN).drop("text", "user", "assistant")


@query(
    "loss_board",
    f"""WITH p AS ({fx.TRACES}), k AS (SELECT data_source, ({d.words("question || ' ' || raw || ' <answer> ' || cypher")})[1:{MAX_LEN}] AS t
  FROM (SELECT *, coalesce(reasoning, '') AS raw FROM p)),
s AS (SELECT data_source, coalesce(list_position(t, '<answer>'), 0) AS a, len(t) AS n FROM k)
SELECT data_source, count(*) AS n, {d.count_if('a = 0')} AS n_masked, CAST(sum(s.n) AS BIGINT) AS n_tokens,
  CAST(sum(CASE WHEN a > 0 THEN s.n - a ELSE 0 END) AS BIGINT) AS n_loss_tokens FROM s GROUP BY data_source""",
)
def loss_board(spark, sf):
    rows = fx.traces(spark, sf).select(
        "data_source", F.concat_ws(" ", "question", "reasoning", F.lit("<answer>"), "cypher").alias("text")
    )
    return op.loss_board(op.loss_spans(rows, "text", "<answer>", MAX_LEN), ["data_source"])


@query(
    "truncation_report",
    f"""WITH s AS ({SFT_SQL}), k AS (SELECT arm, len({d.words('"user"')}) AS p, len({d.words('assistant')}) AS t FROM s)
SELECT arm, count(*) AS n, {d.rate('p + t > 300')} AS over_share, {d.rate('p >= 300')} AS target_lost_share,
  sum(p)::DOUBLE / sum(t)::DOUBLE AS prompt_target_ratio FROM k GROUP BY arm""",
)
def truncation_report(spark, sf):
    return op.truncation_report(sft_both(spark, sf), ["arm"], "user", "assistant", 300)


@query(
    "pack_blocks",
    f"""WITH t AS ({fx.TRACES}), k AS (SELECT instance_id, len({d.words('reasoning')}) AS n FROM t),
z AS (SELECT *, sum(n) OVER (ORDER BY {d.digest_order('instance_id')}) - n AS f FROM k WHERE n > 0),
e AS (SELECT *, unnest(range(CAST(f // 1600 AS BIGINT), CAST((f + n - 1) // 1600 AS BIGINT) + 1)) AS block_id FROM z)
SELECT block_id, instance_id, CAST(greatest(0, block_id * 1600 - f) AS BIGINT) AS row_from,
  CAST(least(n, (block_id + 1) * 1600 - f) AS BIGINT) AS row_to,
  CAST(f + greatest(0, block_id * 1600 - f) - block_id * 1600 AS BIGINT) AS block_from FROM e""",
)
def pack_blocks(spark, sf):
    traces = fx.traces(spark, sf)
    return op.pack_blocks(traces, "instance_id", F.size(words(F.col("reasoning"))))


@query(
    "format_eval_set",
    f"""WITH p AS ({_POLE}), s AS ({SCHEMA_TEXT_SQL})
SELECT id AS instance_id, schema_text AS schema, nl_gold_linked AS question, mr AS reference_cypher, num_nodes,
  CASE WHEN nk < 8 THEN 'iid' WHEN nk < 18 THEN 'compositional' ELSE 'unknown' END AS split, type AS query_type,
  'pole_' || CASE WHEN nk < 8 THEN 'iid' WHEN nk < 18 THEN 'compositional' ELSE 'unknown' END AS data_source
FROM p JOIN s ON id = graph_id""",
)
def format_eval_set(spark, sf):
    rows = label_split(fx.fixture(spark, sf, _POLE), fx.fixture(spark, sf, ID_LISTS))
    rows = rows.withColumn("graph_id", F.col("id")).withColumnRenamed("type", "query_type")
    return op.format_eval_set(
        rows, schema_texts(spark, sf), "graph_id", ["nl_gold_linked", "nl"], "mr", "pole_"
    )
