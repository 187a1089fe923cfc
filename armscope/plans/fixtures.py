"""Input tables for the registered queries, derived from the given tables.

Every rule is SQL that Spark and DuckDB read alike and covers its whole source
tables.  ``{customer}`` and the like name the source tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

#: Tables of a few rows at every scale.
DIMENSIONS = ("region", "nation")

Q = "chr(39)"
NL = "chr(10)"

def each(column: str, values: list[str]) -> str:
    """One row per value, after a FROM item; each engine has its own spelling."""
    return f"<<{column}:{','.join(values)}>>"


_EACH = re.compile(r"<<(\w+):([^>]*)>>")


# One graph query per customer; the shape goes by the customer number.
_BASE = f"""
SELECT CAST(c_custkey AS STRING) AS instance_id, c_custkey AS k, c_mktsegment AS data_source,
       n_name AS db_name, n_nationkey, n_regionkey, r_name,
       c_custkey % 4 AS shape,
       CAST(floor(c_custkey / 4) AS BIGINT) % 12 AS kd,
       CAST(floor(c_custkey / 48) AS BIGINT) AS turn,
       CASE c_custkey % 4
         WHEN 0 THEN concat('What is the balance of ', c_name, '?')
         WHEN 1 THEN concat('Which nation is ', c_name, ' in?')
         WHEN 2 THEN concat('How many customers per region for ', n_name, '?')
         ELSE concat('Who supplies ', c_name, ' in ', r_name, '?') END AS question,
       CASE c_custkey % 4
         WHEN 0 THEN concat('MATCH (c:Customer) WHERE c.name = ', {Q}, c_name, {Q}, ' RETURN c.acctbal')
         WHEN 1 THEN concat('MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE c.name = ', {Q}, c_name, {Q}, ' RETURN n.name')
         WHEN 2 THEN concat('MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE n.name = ', {Q}, n_name, {Q}, ' RETURN r.name AS region, count(c) AS total ORDER BY total DESC LIMIT 5')
         ELSE concat('MATCH (s:Supplier)-[:SUPPLIED_BY]->(c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE c.name = ', {Q}, c_name, {Q}, ' RETURN DISTINCT s.name') END AS ref,
       concat('Node properties:', {NL}, '- **Customer**', {NL}, 'The relationships:', {NL},
         '(:Customer)-[:IN_NATION]->(:Nation)', {NL}, '(:Nation)-[:IN_REGION]->(:Region)', {NL},
         '(:Supplier)-[:SUPPLIED_BY]->(:Customer)', {NL},
         CASE WHEN n_regionkey >= 1 THEN concat('(:Customer)-[:BASED_IN]->(:Nation)', {NL}) ELSE '' END,
         CASE WHEN n_regionkey >= 2 THEN concat('(:Nation)-[:HOSTS]->(:Customer)', {NL}) ELSE '' END,
         CASE WHEN n_regionkey >= 3 THEN concat('(:Customer)-[:BORN_IN]->(:Nation)', {NL}) ELSE '' END,
         CASE WHEN n_regionkey >= 4 THEN concat('(:Customer)-[:PAYS_IN]->(:Nation)', {NL}) ELSE '' END) AS schema_text
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
JOIN {{region}} ON n_regionkey = r_regionkey
"""

# The reference changed by kind: 0-3 equal, 4 spaces, 5 case, 6 semicolon, 7 other
# relation, 8 a hop less, 9 other literal, 10 split pattern, 11 other return.
_PREDICTED = """
CASE kind
  WHEN 4 THEN replace(ref, ' ', '  ')
  WHEN 5 THEN lower(ref)
  WHEN 6 THEN concat(ref, ' ;')
  WHEN 7 THEN replace(ref, ':IN_NATION', ':BASED_IN')
  WHEN 8 THEN CASE
    WHEN shape = 1 THEN replace(ref, '-[:IN_NATION]->(n:Nation)', '')
    WHEN shape = 3 AND turn % 3 = 0 THEN replace(ref, '(s:Supplier)-[:SUPPLIED_BY]->', '')
    WHEN shape = 3 AND turn % 3 = 1 THEN replace(ref, '-[:IN_NATION]->(n:Nation)', '')
    WHEN shape = 2 AND turn % 3 = 2 THEN replace(ref, '(c:Customer)-[:IN_NATION]->', '')
    ELSE replace(ref, '-[:IN_REGION]->(r:Region)', '') END
  WHEN 9 THEN replace(replace(ref, '#0', '#9'), 'NATION_', 'NATION_9')
  WHEN 10 THEN replace(ref, '(n:Nation)-[:IN_REGION]', '(n:Nation) MATCH (n)-[:IN_REGION]')
  WHEN 11 THEN CASE WHEN shape = 2 THEN replace(ref, ' AS region', ' AS area')
    ELSE replace(ref, ' RETURN ', ' RETURN c.name, ') END
  ELSE ref END
"""

PREDICTIONS = f"""
WITH base AS ({_BASE}),
arms AS (
  SELECT *, CASE WHEN arm = 'direct' THEN kd ELSE (kd * 5 + turn) % 12 END AS kind
  FROM base{each('arm', ["'direct'", "'cot'"])}),
made AS (SELECT *, {_PREDICTED} AS predicted FROM arms)
SELECT instance_id, k, arm, question, schema_text, predicted AS predicted_cypher, ref AS reference_cypher,
  data_source, db_name, n_nationkey, n_regionkey, shape, kind,
  CASE WHEN arm = 'direct' THEN '' ELSE concat('Plan: use the pattern ',
    CASE WHEN k % 3 = 0 THEN ref ELSE predicted END, ' to answer it.') END AS reasoning
FROM made
"""

CANDIDATES = f"""
WITH base AS ({_BASE}),
spread AS (
  SELECT *, (kd + turn * cand_idx + cand_idx * cand_idx) % 12 AS kind
  FROM base{each('cand_idx', ['0', '1', '2', '3', '4'])}),
made AS (SELECT *, {_PREDICTED} AS predicted FROM spread)
SELECT instance_id, k, cand_idx, predicted AS candidate, ref AS reference_cypher, db_name, question,
  schema_text, data_source,
  concat('Plan: use the pattern ', predicted, ' to answer it.') AS reasoning
FROM made
"""

# Teacher replies in six styles; every seventh customer has a short reasoning.
RAW_REPLIES = f"""
WITH p AS ({PREDICTIONS}),
t AS (SELECT instance_id, k, predicted_cypher AS qy,
  CASE WHEN k % 7 = 0 THEN 'Too short.' ELSE reasoning END AS rs FROM p WHERE arm = 'cot')
SELECT instance_id, CASE k % 6
  WHEN 0 THEN concat('<reasoning>', {NL}, rs, {NL}, '</reasoning>', {NL}, '<cypher>', {NL}, qy, {NL}, '</cypher>')
  WHEN 1 THEN concat('<reasoning>', rs, '</reasoning>', {NL}, qy)
  WHEN 2 THEN concat(rs, {NL}, '<cypher>', qy, '</cypher>')
  WHEN 3 THEN concat('Reasoning: ', replace(rs, ':', ' '), {NL}, 'Cypher output: ', replace(qy, ':', ' '))
  WHEN 4 THEN concat('<reasoning>', rs, '</reasoning><cypher>', '```cypher', {NL}, qy, {NL}, '```', '</cypher>')
  ELSE qy END AS raw_text
FROM t
"""

# Model output with no, one or two markers, fences and tails.
MARKED = f"""
WITH p AS ({PREDICTIONS})
SELECT instance_id, arm, k, CASE k % 5
  WHEN 0 THEN concat('Reasoning:', {NL}, reasoning, {NL}, {NL}, 'Cypher output: ', predicted_cypher)
  WHEN 1 THEN predicted_cypher
  WHEN 2 THEN concat('Cypher output: none', {NL}, 'Cypher output:', {NL}, '```cypher', {NL}, predicted_cypher, {NL}, '```')
  WHEN 3 THEN concat('Cypher output: ', predicted_cypher, {NL}, {NL}, 'Explanation: it reads the graph.')
  ELSE concat(predicted_cypher, '**Explanation:** plain words') END AS raw_output,
  CASE k % 3
  WHEN 0 THEN concat('Reasoning:', {NL}, reasoning, {NL}, {NL}, 'SQL output: ', predicted_cypher)
  WHEN 1 THEN concat('reasoning: think. SQL output: no. SQL output: `', predicted_cypher, '`')
  ELSE predicted_cypher END AS raw_sql
FROM p
"""

SQL_PREDICTIONS = f"""
WITH base AS (
  SELECT CAST(o_orderkey AS STRING) AS instance_id, o_orderkey AS k, o_orderpriority AS sql_complexity,
    o_orderstatus AS db_id,
    concat(CASE o_orderkey % 3 WHEN 0 THEN concat('SELECT ', chr(34), 'o--price /* net */', chr(34)) ELSE 'SELECT o_totalprice' END,
      ' FROM orders WHERE o_orderstatus = ', {Q}, o_orderstatus, {Q}, ' AND o_orderkey = ', CAST(o_orderkey AS STRING)) AS reference_sql,
    o_orderkey % 10 AS kd, (o_orderkey * 7 + CAST(floor(o_orderkey / 10) AS BIGINT)) % 10 AS kc
  FROM {{orders}}),
arms AS (SELECT *, CASE WHEN arm = 'direct' THEN kd ELSE kc END AS kind FROM base{each('arm', ["'direct'", "'cot'"])})
SELECT instance_id, k, arm, db_id, sql_complexity, reference_sql, CASE kind
  WHEN 0 THEN replace(reference_sql, '--price', '--cost')
  WHEN 1 THEN replace(reference_sql, chr(34), '`')
  WHEN 2 THEN concat(reference_sql, ';')
  WHEN 3 THEN concat(reference_sql, ' ;')
  WHEN 4 THEN lower(reference_sql)
  WHEN 5 THEN replace(reference_sql, ' ', '  ')
  WHEN 6 THEN replace(reference_sql, ' = ', '=')
  WHEN 7 THEN concat(reference_sql, '9')
  WHEN 8 THEN concat(reference_sql, ' -- by key')
  WHEN 9 THEN ''
  ELSE reference_sql END AS predicted_sql
FROM arms
"""

# One trace per document; some have no reasoning and an error instead.
TRACES = f"""
WITH base AS (
  SELECT CAST(doc_id AS STRING) AS instance_id, doc_id AS k, text, lang, source, n_chars,
    concat('What is said in ', lang, ' by ', source, '?') AS question,
    concat('MATCH (d:Doc) WHERE d.lang = ', {Q}, lang, {Q}, ' RETURN d.id') AS cypher FROM {{documents}})
SELECT instance_id, k, question, concat('Doc ', lang, ' text') AS schema, cypher,
  CASE WHEN n_chars % 11 = 0 THEN '' ELSE text END AS reasoning,
  CASE WHEN n_chars % 11 = 0 THEN '' ELSE CASE n_chars % 7
    WHEN 1 THEN replace(cypher, ' ', '  ') WHEN 2 THEN lower(cypher) WHEN 3 THEN concat(cypher, ';')
    WHEN 4 THEN replace(cypher, 'd.id', 'd.text') ELSE cypher END END AS generated_cypher,
  CASE WHEN n_chars % 11 = 0 THEN CASE n_chars % 3
    WHEN 0 THEN 'No XML tags or recognizable markers found' WHEN 1 THEN 'Reasoning too short (3 chars)'
    ELSE 'API error: 429' END END AS parse_error,
  CASE WHEN n_chars % 11 = 0 THEN text END AS raw_response,
  source AS data_source, lang AS database_reference_alias,
  n_chars AS prompt_tokens, n_chars % 300 AS completion_tokens
FROM base
"""

# Whole texts of a document and of the document after it.
TEXT_PAIRS = """
SELECT CAST(a.doc_id AS STRING) AS instance_id, a.source AS data_source, a.lang, b.text AS predicted, a.text AS reference
FROM {documents} a JOIN {documents} b ON a.doc_id + 1 = b.doc_id
"""

# Labelled documents are the test side, all others the train side.
LEAK_SIDES = """
SELECT CAST(d.doc_id AS STRING) AS instance_id, d.text AS question, d.lang AS query, d.source,
  CASE WHEN l.doc_id IS NULL THEN 'train' ELSE 'test' END AS side,
  l.quality, l.toxic
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""


#: A double quote and braces, which a fixture rule cannot hold as they are.
MARKS = "concat(chr(34), chr(123), chr(125))"


def result_rows_sql(arm: str) -> str:
    """Result rows of every order; the predicted side is changed by kind.

    0 same, 1 other number text in maps, 2 number as text, 3 other names, 4 other row order, 5 a row
    less, 6 other value, 7 other column order.
    """
    shift = {"direct": 0, "cot": 3}[arm]
    return f"""
WITH li AS (
  SELECT CAST(l_orderkey AS STRING) AS instance_id, (l_orderkey + {shift}) % 8 AS kind,
    l_linenumber AS ln, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS qty,
    CAST(CAST(l_quantity AS BIGINT) + 1 AS STRING) AS qty2, l_returnflag AS flag FROM {{lineitem}}),
sides AS (SELECT * FROM li{each('side', ["'ref'", "'pred'"])}),
numbered AS (SELECT *, CASE WHEN side = 'pred' AND kind = 1 THEN CASE ln WHEN 3 THEN '1' ELSE '1234567890123456789012345678901234567891' END
  ELSE CASE ln WHEN 3 THEN '1.0' ELSE '1234567890123456789012345678901234567890' END END AS num FROM sides)
SELECT instance_id, '{arm}' AS arm, side,
  CASE WHEN side = 'pred' AND kind = 4 THEN 100 - ln ELSE ln END AS row_no,
  CASE WHEN side = 'pred' AND kind = 3 THEN 'a' WHEN side = 'pred' AND kind = 7 THEN 'qty' ELSE 'line' END AS n1,
  CASE WHEN side = 'pred' AND kind = 7 THEN qty ELSE CAST(ln AS STRING) END AS v1,
  CASE WHEN side = 'pred' AND kind = 3 THEN 'b' WHEN side = 'pred' AND kind = 7 THEN 'line' ELSE 'qty' END AS n2,
  CASE WHEN side = 'pred' AND kind = 7 THEN CAST(ln AS STRING)
       WHEN side = 'pred' AND kind = 2 THEN concat(chr(34), qty, chr(34))
       WHEN side = 'pred' AND kind = 6 AND ln = 1 THEN qty2 ELSE qty END AS v2,
  CASE WHEN side = 'pred' AND kind = 3 THEN 'c' ELSE 'flag' END AS n3,
  CASE WHEN ln % 3 <> 0 THEN concat(chr(34), flag, chr(34))
       WHEN side = 'ref' THEN translate(concat('<^n^: ', num, ', ^f^: [^', flag, ', 2^, <^b^:null, ^a^:^1.0^>]>'), '^<>', {MARKS})
       ELSE translate(concat('<^f^:[^', flag, ', 2^,<^a^:^1.0^,^b^: null>],^n^:', num, '>'), '^<>', {MARKS}) END AS v3,
  CASE WHEN ln % 3 <> 0 THEN concat(chr(34), flag, chr(34))
       ELSE translate(concat('<^f^:[^', flag, ', 2^,<^a^:^1.0^,^b^:null>],^n^:', num, '>'), '^<>', {MARKS}) END AS c3
FROM numbered WHERE NOT (side = 'pred' AND kind = 5 AND ln = 1)
"""


def runs_sql(arm: str) -> str:
    """One reference and one predicted run per order, some with errors."""
    shift = {"direct": 0, "cot": 5}[arm]
    return f"""
WITH o AS (
  SELECT CAST(o_orderkey AS STRING) AS instance_id, o_orderkey AS k, o_orderkey + {shift} AS s, n_name AS db_name,
    o_orderpriority AS split, o_custkey % 4 AS num_nodes,
    CASE WHEN o_orderkey % 2 = 0 THEN 'SELECT line, qty, flag FROM t ORDER BY line'
         ELSE 'SELECT line, qty, flag FROM t' END AS reference_query
  FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey),
sides AS (SELECT * FROM o{each('side', ["'ref'", "'pred'"])})
SELECT instance_id, '{arm}' AS arm, side, db_name, split, num_nodes, reference_query,
  CASE WHEN side = 'ref' AND k % 37 = 0 THEN 'db: gone'
       WHEN side = 'pred' AND s % 29 = 0 THEN 'syntax: bad token'
       WHEN side = 'pred' AND s % 31 = 0 THEN 'too_many_rows: >10000'
       WHEN side = 'pred' AND s % 43 = 0 THEN 'memory_error' END AS error,
  s % 41 = 0 AS skipped
FROM sides
"""


def both_arms(make) -> str:
    return f"SELECT * FROM ({make('direct')}) x1 UNION ALL SELECT * FROM ({make('cot')}) x2"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if name in DIMENSIONS else spread(df)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a table that is a single small split.

    The work here is per row and heavy on the processor, so one split would
    keep one core busy.  A table with enough splits is left as it is: at scale
    this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture rule over the parquet tables of ``sf_dir``."""
    used = {t: read_table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    sql = _EACH.sub(r" LATERAL VIEW explode(array(\2)) t_\1 AS \1", sql)
    return spark.sql(sql, **used)


def oracle_text(sql: str) -> str:
    """The same rule with plain table names, for DuckDB."""
    sql = _EACH.sub(r", unnest([\2]) AS t_\1(\1)", sql)
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, PREDICTIONS)


def arm(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("arm") == name)


def result_rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Result rows with their cells as an array of (name, value)."""
    flat = fixture(spark, sf_dir, sql)
    cells = F.array(
        *[F.struct(F.col(f"n{i}").alias("name"), F.col(f"v{i}").alias("value")) for i in (1, 2, 3)]
    )
    return flat.select("instance_id", "arm", "side", "row_no", cells.alias("cols"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces with their generation metadata as a struct."""
    flat = fixture(spark, sf_dir, TRACES)
    meta = F.struct(
        F.lit("teacher").alias("model"), F.col("prompt_tokens"), F.col("completion_tokens")
    )
    return flat.withColumn("generation_metadata", meta).drop("prompt_tokens", "completion_tokens")
