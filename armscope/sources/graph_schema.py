"""Graph schemas: from JSON to tables, and from tables to prompt text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_JSON = (
    "classes MAP<STRING, STRUCT<description: STRING>>, "
    "properties MAP<STRING, STRUCT<description: STRING, type: STRING>>, "
    "relations MAP<STRING, STRUCT<domain: STRING, range: STRING, description: STRING, "
    "reverse_description: STRING>>"
)


def parse_schemas(schemas: DataFrame, json_col: str = "schema_json") -> DataFrame:
    """Typed columns ``classes``, ``properties`` and ``relations`` of a JSON schema."""
    return schemas.withColumn("_s", F.from_json(json_col, SCHEMA_JSON)).select(
        *[c for c in schemas.columns if c != json_col], "_s.*"
    )


def node_table(parsed: DataFrame, graph: str = "graph_id") -> DataFrame:
    return parsed.select(graph, F.posexplode("classes").alias("pos", "node", "_v")).select(
        graph, "pos", "node", F.col("_v.description").alias("description")
    )


def property_table(parsed: DataFrame, graph: str = "graph_id") -> DataFrame:
    return parsed.select(graph, F.posexplode("properties").alias("pos", "property", "_v")).select(
        graph, "pos", "property", F.coalesce("_v.type", F.lit("STRING")).alias("type"),
        F.col("_v.description").alias("description"),
    )


def relation_table(parsed: DataFrame, graph: str = "graph_id") -> DataFrame:
    return parsed.select(graph, F.posexplode("relations").alias("pos", "rel", "_v")).select(
        graph, "pos", "rel", F.col("_v.domain").alias("domain"),
        F.col("_v.range").alias("range"), F.col("_v.description").alias("description"),
    )


def graph_schema_text(
    nodes: DataFrame,
    properties: DataFrame,
    relations: DataFrame,
    node_properties: DataFrame,
    graph: str = "graph_id",
) -> DataFrame:
    """Prompt text per graph: node lines with their properties, then relation lines.

    ``node_properties`` (graph, node, prop_pos, property) says which property
    belongs to which node; a property without a declared type is a STRING.
    """
    node_lines = nodes.select(
        graph, F.lit(1).alias("sec"), "pos", F.lit(-1).alias("sub"),
        F.format_string("- **%s** (%s)", "node", "description").alias("line"),
    )
    types = properties.select(graph, "property", "type")
    prop_lines = (
        nodes.select(graph, "node", "pos")
        .join(node_properties, [graph, "node"])
        .join(types, [graph, "property"], "left")
        .select(
            graph, F.lit(1).alias("sec"), "pos", F.col("prop_pos").alias("sub"),
            F.format_string(
                "  - `%s`: %s", "property", F.coalesce("type", F.lit("STRING"))
            ).alias("line"),
        )
    )
    rel_lines = relations.select(
        graph, F.lit(3).alias("sec"), "pos", F.lit(0).alias("sub"),
        F.format_string(
            "- **%s** -[:%s]-> **%s** (%s)", "domain", "rel", "range", "description"
        ).alias("line"),
    )
    heads = nodes.select(graph).distinct().select(
        graph,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("sec"), F.lit("Node properties:").alias("line")),
                F.struct(F.lit(2).alias("sec"), F.lit("\nRelationship types:").alias("line")),
            )
        ).alias("h"),
    ).select(
        graph, F.col("h.sec").alias("sec"), F.lit(0).alias("pos"), F.lit(0).alias("sub"),
        F.col("h.line").alias("line"),
    )
    lines = heads.unionByName(node_lines).unionByName(prop_lines).unionByName(rel_lines)
    return join_lines(lines, graph, ["sec", "pos", "sub"])


def join_lines(lines: DataFrame, graph: str, order: list[str]) -> DataFrame:
    """Lines of every graph as one text, whatever their number: it is one prompt."""
    return lines.groupBy(graph).agg(
        F.sort_array(F.collect_list(F.struct(*order, "line"))).alias("_l")
    ).select(graph, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("schema_text"))


def relational_schema_text(schemas: DataFrame, text_col: str, fk_col: str) -> DataFrame:
    """Schema text of a relational database, with its foreign keys when it has any."""
    fk = F.trim(F.coalesce(F.col(fk_col), F.lit("")))
    has_fk = (fk != "") & (F.lower(fk) != "none")
    return schemas.withColumn(
        "schema_text",
        F.concat(F.col(text_col), F.when(has_fk, F.concat(F.lit(" | foreign keys: "), fk)).otherwise("")),
    )
