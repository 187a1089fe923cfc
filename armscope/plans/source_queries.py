"""Registered queries for sources, sinks and resumption."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from armscope.operators.scoring import exact_match_board
from armscope.plans import duck as d
from armscope.plans import fixtures as fx
from armscope.plans.registry import query
from armscope.plans.scoring_queries import EM_BOARD_SQL
from armscope.session import work_dir
from armscope.sources import graph_schema as gs
from armscope.sources import records as op

RECORD = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("data_source", T.StringType()),
    ]
)


def written_records(spark, sf):
    """Traces as JSON lines; a line of a failed trace is broken off."""
    rows = fx.traces(spark, sf)
    whole = F.to_json(F.struct("instance_id", "question", "reasoning", "data_source"))
    line = F.when(F.col("parse_error").isNull(), whole).otherwise(
        F.substr(whole, F.lit(1), F.length(whole) - 2)
    )
    path = work_dir(spark, "records")
    rows.select(line.alias("value")).write.mode("overwrite").text(path)
    return op.read_records(spark, path, RECORD)


@query(
    "read_records",
    f"WITH t AS ({fx.TRACES}) SELECT instance_id, question, reasoning, data_source FROM t WHERE parse_error IS NULL",
)
def read_records(spark, sf):
    return op.good_records(written_records(spark, sf))


@query(
    "record_counts",
    f"""WITH t AS ({fx.TRACES}) SELECT {d.count_if('parse_error IS NULL')} AS n_good, {d.count_if('parse_error IS NOT NULL')} AS n_bad FROM t""",
)
def record_counts(spark, sf):
    return op.record_counts(written_records(spark, sf))


_POLE = """SELECT CAST(c_custkey AS STRING) AS id, concat('Who is ', chr(34), c_name, chr(34), ', please?', chr(10), 'Now') AS nl,
  concat('Who is [Person] = ', c_name, '?') AS nl_gold_linked, concat('MATCH (x0:Person) RETURN ', c_custkey) AS mr,
  CAST(c_custkey % 5 + 1 AS STRING) AS num_nodes, concat('t', c_custkey % 9) AS template_id, c_mktsegment AS type, c_nationkey AS nk
FROM {customer}"""
POLE_COLUMNS = ["id", "nl", "nl_gold_linked", "mr", "num_nodes", "template_id", "type"]
# Two files that overlap in nations 10 to 14.
FIRST_FILE = f"SELECT * FROM ({_POLE}) p WHERE nk < 15"
SECOND_FILE = f"SELECT * FROM ({_POLE}) p WHERE nk >= 10"


@query(
    "read_split_csv",
    f"""WITH p AS ({_POLE}) SELECT id, nl, nl_gold_linked, mr, CAST(num_nodes AS INT) AS num_nodes,
  CASE WHEN nk < 15 THEN template_id ELSE 'second' END AS template_id, type FROM p""",
)
def read_split_csv(spark, sf):
    base = work_dir(spark, "csv")
    for name, sql in (("a", FIRST_FILE), ("b", SECOND_FILE)):
        rows = fx.fixture(spark, sf, sql).select(*POLE_COLUMNS)
        if name == "b":
            rows = rows.withColumn("template_id", F.lit("second"))
        rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option(
            "escape", '"'
        ).csv(f"{base}/{name}")
    return op.read_split_csv(spark, [f"{base}/a", f"{base}/b"], POLE_COLUMNS)


# One small graph schema per customer, as JSON text (chr(123) and chr(125) are braces).
_L, _R = "chr(123)", "chr(125)"
SCHEMA_JSON = f"""SELECT CAST(c_custkey AS STRING) AS graph_id, concat(
  {_L}, '"classes":', {_L}, '"Person":', {_L}, '"description":"', c_name, '"', {_R}, ',"Area":', {_L}, '"description":"Areas"', {_R}, {_R},
  ',"properties":', {_L}, '"age":', {_L}, '"description":"age","type":"INTEGER"', {_R}, ',"code":', {_L}, '"description":"code"', {_R}, {_R},
  ',"relations":', {_L}, '"LIVES_IN":', {_L}, '"domain":"Person","range":"Area","description":"', c_mktsegment, '","reverse_description":"has"', {_R}, {_R}, {_R}
) AS schema_json FROM {{customer}}"""


def schemas(spark, sf):
    return gs.parse_schemas(fx.fixture(spark, sf, SCHEMA_JSON))


@query(
    "graph_schema_tables",
    """SELECT CAST(c_custkey AS STRING) AS graph_id, 'node' AS kind, 0 AS pos, 'Person' AS name, c_name AS info FROM customer
UNION ALL SELECT CAST(c_custkey AS STRING), 'node', 1, 'Area', 'Areas' FROM customer
UNION ALL SELECT CAST(c_custkey AS STRING), 'property', 0, 'age', 'INTEGER' FROM customer
UNION ALL SELECT CAST(c_custkey AS STRING), 'property', 1, 'code', 'STRING' FROM customer
UNION ALL SELECT CAST(c_custkey AS STRING), 'relation', 0, 'LIVES_IN', 'Person>Area:' || c_mktsegment FROM customer""",
)
def graph_schema_tables(spark, sf):
    parsed = schemas(spark, sf)
    nodes = gs.node_table(parsed).select(
        "graph_id", F.lit("node").alias("kind"), "pos", F.col("node").alias("name"), F.col("description").alias("info")
    )
    props = gs.property_table(parsed).select(
        "graph_id", F.lit("property").alias("kind"), "pos", F.col("property").alias("name"), F.col("type").alias("info")
    )
    rels = gs.relation_table(parsed).select(
        "graph_id", F.lit("relation").alias("kind"), "pos", F.col("rel").alias("name"),
        F.concat("domain", F.lit(">"), "range", F.lit(":"), "description").alias("info"),
    )
    return nodes.unionByName(props).unionByName(rels)


def schema_texts(spark, sf):
    parsed = schemas(spark, sf)
    nodes = gs.node_table(parsed)
    owned = nodes.filter(F.col("node") == "Person").select(
        "graph_id", "node",
        F.posexplode(F.array(F.lit("age"), F.lit("code"), F.lit("nhs_no"))).alias("prop_pos", "property"),
    )
    return gs.graph_schema_text(nodes, gs.property_table(parsed), gs.relation_table(parsed), owned)


SCHEMA_TEXT_SQL = """SELECT CAST(c_custkey AS STRING) AS graph_id, 'Node properties:' || chr(10) || '- **Person** (' || c_name || ')' || chr(10)
  || '  - `age`: INTEGER' || chr(10) || '  - `code`: STRING' || chr(10) || '  - `nhs_no`: STRING' || chr(10) || '- **Area** (Areas)' || chr(10) || chr(10)
  || 'Relationship types:' || chr(10) || '- **Person** -[:LIVES_IN]-> **Area** (' || c_mktsegment || ')' AS schema_text FROM customer"""


@query("graph_schema_text", SCHEMA_TEXT_SQL)
def graph_schema_text(spark, sf):
    return schema_texts(spark, sf)


REL_SCHEMAS = """SELECT CAST(s_suppkey AS STRING) AS db_id, concat('supplier : s_suppkey (number) , ', s_name) AS schema_values,
  CASE s_suppkey % 3 WHEN 0 THEN 'None' WHEN 1 THEN ' supplier.s_nationkey = nation.n_nationkey ' END AS fk FROM {supplier}"""


@query(
    "relational_schema_text",
    f"""WITH s AS ({REL_SCHEMAS}) SELECT db_id, schema_values || CASE WHEN trim(coalesce(fk, '')) <> '' AND lower(trim(fk)) <> 'none'
  THEN ' | foreign keys: ' || trim(fk) ELSE '' END AS schema_text FROM s""",
)
def relational_schema_text(spark, sf):
    return gs.relational_schema_text(fx.fixture(spark, sf, REL_SCHEMAS), "schema_values", "fk").select(
        "db_id", "schema_text"
    )


ID_LISTS = """SELECT 'iid' AS split, CAST(c_custkey AS STRING) AS id FROM {customer} WHERE c_nationkey < 8
UNION ALL SELECT 'compositional' AS split, CAST(c_custkey AS STRING) AS id FROM {customer} WHERE c_nationkey >= 6 AND c_nationkey < 18"""


@query(
    "label_split",
    """SELECT CAST(c_custkey AS STRING) AS id, c_mktsegment AS type, CASE WHEN c_nationkey < 8 THEN 'iid'
  WHEN c_nationkey < 18 THEN 'compositional' ELSE 'unknown' END AS split FROM customer""",
)
def label_split(spark, sf):
    rows = fx.fixture(spark, sf, _POLE).select("id", "type")
    return op.label_split(rows, fx.fixture(spark, sf, ID_LISTS))


# Work: all documents.  Done: the traces of labelled documents.
DONE = f"SELECT t.instance_id, t.reasoning FROM ({fx.TRACES}) t JOIN {{labels}} l ON t.k = l.doc_id"


@query(
    "pending",
    f"""WITH t AS ({fx.TRACES}), dn AS ({DONE}) SELECT instance_id, data_source FROM t
WHERE instance_id NOT IN (SELECT instance_id FROM dn)""",
)
def pending(spark, sf):
    work = fx.traces(spark, sf).select("instance_id", "data_source")
    return op.pending(work, fx.fixture(spark, sf, DONE))


@query(
    "pending_with_retry",
    f"""WITH t AS ({fx.TRACES}), dn AS ({DONE}) SELECT instance_id, data_source FROM t
WHERE instance_id NOT IN (SELECT instance_id FROM dn WHERE NOT {d.is_blank('reasoning')})""",
)
def pending_with_retry(spark, sf):
    work = fx.traces(spark, sf).select("instance_id", "data_source")
    return op.pending(work, fx.fixture(spark, sf, DONE), retry_failed=True)


LOG = "SELECT CAST(o_custkey AS STRING) AS instance_id, o_orderkey, o_orderstatus, o_orderdate FROM {orders}"


@query(
    "latest_per_id",
    f"""WITH g AS ({LOG}) SELECT instance_id, o_orderkey, o_orderstatus FROM
  (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM g) WHERE rn = 1""",
)
def latest_per_id(spark, sf):
    log = fx.fixture(spark, sf, LOG)
    return op.latest_per_id(log, "instance_id", F.struct("o_orderdate", "o_orderkey")).drop("o_orderdate")


@query(
    "write_metrics_table",
    EM_BOARD_SQL,
)
def write_metrics_table(spark, sf):
    """The EM board written as JSON and read again."""
    board = exact_match_board(
        fx.predictions(spark, sf), ["arm"], "data_source", "predicted_cypher", "reference_cypher"
    )
    path = work_dir(spark, "metrics")
    op.write_table(board, path, "json")
    return spark.read.schema(board.schema).json(path)


@query(
    "nested_metrics",
    f"""WITH b AS ({EM_BOARD_SQL}), o AS (SELECT * FROM b WHERE arm = 'cot' AND data_source IS NULL)
SELECT o.n AS total, o.em AS total_em, b.data_source, b.n, b.n_match, b.em FROM b JOIN o ON b.arm = o.arm
WHERE b.data_source IS NOT NULL""",
)
def nested_metrics(spark, sf):
    """Overall EM and the groups' metrics as one JSON object, written and opened again for the check."""
    board = exact_match_board(
        fx.arm(fx.predictions(spark, sf), "cot"), ["arm"], "data_source", "predicted_cypher", "reference_cypher"
    )
    path = work_dir(spark, "nested")
    op.write_nested_metrics(board, "data_source", ["n", "n_match", "em"], path)
    one = "n BIGINT, n_match BIGINT, em DOUBLE"
    nested = spark.read.schema(f"{one}, per_group MAP<STRING, STRUCT<{one}>>").json(path)
    return nested.select(
        F.col("n").alias("total"), F.col("em").alias("total_em"), F.explode("per_group").alias("data_source", "m")
    ).select("total", "total_em", "data_source", "m.n", "m.n_match", "m.em")
