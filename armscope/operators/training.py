"""Building training sets: requests, exemplar reasoning, target rows, blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.functions.graphtext import REL_ORDERED
from armscope.functions.keys import BUCKET_ROWS, running_total
from armscope.functions.text import is_blank, strip_blank, words
from armscope.operators.parsing import MARKERS

# Turn formats per request style.  {..} are column names.
USER_TURNS = {
    "qdecomp": "Schema:\n{schema}\n\nQuestion: {question}\n\nReference Cypher: {query}",
    "holistic": "Schema:\n{schema}\n\nQuestion: {question}\n\nReference Cypher: {query}",
    "forward": "Schema:\n{schema}\n\nQuestion: {question}",
    "pole": "Question: {question}\n\nReference Cypher: {query}",
    "holistic_pole": "Question: {question}\n\nReference Cypher: {query}",
    "enum": "Question: {question}\n\nReference Cypher: {query}",
    "sql": (
        "Schema: {schema}\nQuestion: {question}\nReference SQL: {query}\n\n"
        "Produce the reasoning and restate the SQL query in the required format."
    ),
    "sparql": (
        "Question: {question}\nReference SPARQL: {query}\n\n"
        "Produce the reasoning and restate the SPARQL query in the required format."
    ),
}
TAGGED_ANSWER = "<reasoning>\n{reasoning}\n</reasoning>\n<cypher>\n{query}\n</cypher>"
ASSISTANT_TURNS = {
    **{s: TAGGED_ANSWER for s in ("qdecomp", "holistic", "forward", "pole", "holistic_pole", "enum")},
    "sql": "{reasoning}\n\nSQL output: {query}",
    "sparql": "{reasoning}\n\nSPARQL output: {query}",
}
# User prompt of a training row, per language and arm.
TRAIN_PROMPT = {
    "cypher": (
        "Generate Cypher statement to query a graph database.\n"
        "Use only the provided relationship types and properties in the schema.\n"
        "Schema: {schema}\nQuestion: {question}\nCypher output:"
    ),
    "sql": "Schema: {schema}\nQuestion: {question}\nSQL output:",
    "sparql": "Question: {question}\nSPARQL output:",
}

# Reasoning of an exemplar per style; {path}, {n} and {chain} come from its query.
EXEMPLAR_TEXT = {
    "holistic": (
        "1. Connected path: {path}\n2. Filters/return as in the query.\n"
        "3. Cypher preserves the full connected path in a single MATCH."
    ),
    "holistic_pole": (
        "1. Connected path: {path}\n2. Filters are inline in the path above; return/count as in the query.\n"
        "3. Cypher keeps the whole connected path in a single MATCH."
    ),
    "enum": (
        "1. Relationships needed ({n}): {chain}\n2. Connected path: {path}\n"
        "3. Filters are inline; return/count as in the query.\n"
        "4. Cypher uses exactly those {n} relationships in one connected MATCH."
    ),
}

#: Tokens of one packed block.
BLOCK_TOKENS = 1600


def fill(template: str, values: dict[str, Column]) -> Column:
    """A text template with {name} places as a Column expression."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(F.coalesce(values[name], F.lit("")))
    return F.concat(*parts)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def request_messages(
    examples: DataFrame,
    style: str,
    system: str,
    exemplars: Sequence[dict[str, str]] = (),
    question: str = "question",
    query: str = "query",
    schema: str = "schema",
) -> DataFrame:
    """Add ``messages``: system text, few-shot turns, and the example's own turn.

    ``system`` may name {schema}, {question} and {query}: styles whose user turn has no
    schema show it there.  An exemplar has question, query, reasoning and (for styles that show it)
    schema.  Holistic and enumerating styles derive an exemplar's reasoning
    from its query.  Exemplars are a handful of constants in the plan.
    """
    user, assistant = USER_TURNS[style], ASSISTANT_TURNS[style]
    own = {
        "question": F.col(question),
        "query": F.col(query) if query in examples.columns else F.lit(""),
        "schema": F.col(schema) if schema in examples.columns else F.lit(""),
    }
    turns = [_message("system", fill(system, own))]
    for ex in exemplars:
        consts = {k: F.lit(v) for k, v in ex.items()}
        if style in EXEMPLAR_TEXT:
            consts["reasoning"] = exemplar_reasoning(F.lit(ex["query"]), EXEMPLAR_TEXT[style])
        turns.append(_message("user", fill(user, consts)))
        turns.append(_message("assistant", fill(assistant, consts)))
    turns.append(_message("user", fill(user, own)))
    return examples.withColumn("messages", F.array(*turns))


def exemplar_reasoning(query: Column, template: str) -> Column:
    """A reasoning template filled with what a query shows: its path, and its relations in order."""
    rels = F.regexp_extract_all(query, F.lit(REL_ORDERED), 1)
    return fill(template, {
        "path": strip_blank(F.substring_index(query, "RETURN", 1)),
        "n": F.size(rels).cast("string"),
        "chain": F.when(F.size(rels) > 0, F.concat_ws(" -> ", rels)).otherwise("(none)"),
    })


def with_exemplar_reasoning(traces: DataFrame, query_col: str, style: str, out: str = "derived") -> DataFrame:
    return traces.withColumn(out, exemplar_reasoning(F.col(query_col), EXEMPLAR_TEXT[style]))


def sft_rows(
    traces: DataFrame,
    arm: str,
    lang: str = "cypher",
    query_col: str = "cypher",
    prompt: str | None = None,
) -> DataFrame:
    """Add ``user`` and ``assistant``; the target query is always the reference."""
    values = {c: F.col(c) for c in ("schema", "question") if c in traces.columns}
    values.setdefault("schema", F.lit(""))
    user = fill(prompt or TRAIN_PROMPT[lang], values)
    query = F.col(query_col)
    if arm == "cot":
        target = F.concat(
            F.lit("Reasoning:\n"), F.col("reasoning"), F.lit(f"\n\n{MARKERS[lang]} "), query
        )
    else:
        target = query
    return traces.withColumn("user", user).withColumn("assistant", target)


def loss_spans(
    rows: DataFrame, text_col: str, marker: str, max_len: int, full_sequence: bool = False
) -> DataFrame:
    """Add the token span that carries loss: after the first response marker.

    Tokens are blank-separated words, and the marker may be several of them; the
    row is cut at ``max_len`` tokens first.  Without a marker in what is left,
    the whole row is masked.  ``full_sequence``: every token carries loss.
    """
    mark = marker.split()
    tokens = rows.withColumn("_t", F.slice(words(F.col(text_col)), 1, max_len)).withColumn("n_tokens", F.size("_t"))
    wanted = F.array(*[F.lit(m) for m in mark])
    starts = F.filter(
        F.transform("_t", lambda _, i: i),
        lambda i: (F.get("_t", i) == mark[0]) & (F.slice("_t", i + 1, len(mark)) == wanted),
    )
    at = F.lit(0) if full_sequence else F.get(starts, F.lit(0)) + len(mark)
    return (
        tokens.withColumn("_at", at)
        .withColumn("loss_from", F.coalesce("_at", "n_tokens"))
        .withColumn("n_loss", F.col("n_tokens") - F.col("loss_from"))
        .withColumn("masked", F.col("_at").isNull())
        .drop("_t", "_at")
    )


def loss_board(spans: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    return spans.groupBy(*group_cols).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("masked"), 1)).alias("n_masked"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_loss").alias("n_loss_tokens"),
    )


def truncation_report(
    rows: DataFrame, group_cols: Sequence[str], prompt_col: str, target_col: str, max_len: int
) -> DataFrame:
    """Share of rows over the limit, of rows whose target is lost, and prompt:target ratio."""
    sized = rows.select(
        *group_cols, F.size(words(F.col(prompt_col))).alias("_p"), F.size(words(F.col(target_col))).alias("_t")
    )
    over, lost = F.col("_p") + F.col("_t") > max_len, F.col("_p") >= max_len
    return sized.groupBy(*group_cols).agg(
        F.count("*").alias("n"),
        F.avg(over.cast("double")).alias("over_share"),
        F.avg(lost.cast("double")).alias("target_lost_share"),
        (F.sum("_p") / F.sum("_t")).alias("prompt_target_ratio"),
    )


def pack_blocks(
    rows: DataFrame, id_col: str, n_tokens: Column, block: int = BLOCK_TOKENS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Lay all rows end to end and cut the stream into blocks of ``block`` tokens.

    One row per piece: (block_id, id, row_from, row_to, block_from).  The order
    of the rows is (md5 of id, id); offsets come from prefix sums on two levels, so the
    borders are those of one sequential pass in that order, whatever the number of ranges.
    """
    sized = rows.select(id_col, n_tokens.cast("bigint").alias("_n")).filter(F.col("_n") > 0)
    placed = running_total(sized, id_col, "_n", "_from", bucket_rows)
    width = F.lit(block).cast("bigint")
    first = F.floor(F.col("_from") / width)
    last = F.floor((F.col("_from") + F.col("_n") - 1) / width)
    pieces = placed.select("*", F.explode(F.sequence(first, last)).alias("block_id"))
    row_from = F.greatest(F.lit(0).cast("bigint"), F.col("block_id") * width - F.col("_from"))
    row_to = F.least(F.col("_n"), (F.col("block_id") + 1) * width - F.col("_from"))
    return pieces.select(
        "block_id", id_col, row_from.alias("row_from"), row_to.alias("row_to"),
        (F.col("_from") + row_from - F.col("block_id") * width).alias("block_from"),
    )


def format_eval_set(
    rows: DataFrame,
    schema_texts: DataFrame,
    graph_col: str,
    question_cols: Sequence[str],
    query_col: str,
    source_prefix: str,
) -> DataFrame:
    """Test rows as model input: linked question, schema text, split, and data source.

    ``schema_texts`` has one text per graph, so every row comes out once.
    """
    question = F.coalesce(*[F.when(~is_blank(F.col(c)), F.col(c)) for c in question_cols])
    split = F.coalesce("split", F.lit("unknown"))
    return rows.join(schema_texts.select(graph_col, "schema_text"), graph_col).select(
        F.col("id").alias("instance_id"),
        F.col("schema_text").alias("schema"),
        question.alias("question"),
        F.col(query_col).alias("reference_cypher"),
        "num_nodes",
        split.alias("split"),
        "query_type",
        F.concat(F.lit(source_prefix), split).alias("data_source"),
    )
