"""Model output to fields: tagged traces, marked output, cleaning, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.functions.text import (
    BLANK, after_last, before_last, cut_at, first_filled, is_blank, strip_blank, strip_chars,
    text_or_empty,
)

# Least lengths, accepted keywords and messages of a parsed trace.
MIN_REASONING = 20
MIN_QUERY = 5
QUERY_KEYWORDS = ["MATCH", "RETURN", "CALL", "CREATE", "MERGE"]
NO_MARKERS = "No XML tags or recognizable markers found"
NOT_BOTH = "Could not extract both reasoning and cypher"
NO_KEYWORD = "Cypher missing expected keywords (MATCH/RETURN/CALL/CREATE/MERGE)"

# The word before a section in an untagged reply.
REASONING_WORDS = "reasoning|thinking|explanation"
QUERY_WORDS = "cypher|query"

# Marker and code-fence name per query language.
MARKERS = {"cypher": "Cypher output:", "sql": "SQL output:", "sparql": "SPARQL output:"}
CYPHER_TAILS = ["**Explanation:**", "\n\nExplanation:", "\n\nNote:"]

# Question texts that mean "missing".
MISSING_TEXT = ["n/a", "na", "null", "none"]


def _unfence(c: Column) -> Column:
    opened = F.regexp_replace(strip_blank(c), rf"^```(?:cypher)?{BLANK}*", "")
    return strip_blank(F.regexp_replace(opened, rf"\n?```{BLANK}*$", ""))


def _tag(raw: Column, tag: str) -> Column:
    """Text of the first <tag>..</tag>; an absent or empty one is ''."""
    return F.regexp_extract(raw, f"(?s)<{tag}>(.*?)</{tag}>", 1)


def parse_traces(raw: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Add ``reasoning``, ``query``, ``ok`` and ``parse_error`` to raw replies.

    ``ok`` splits accepted rows from rejects; a reject says why.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tagged = raw.withColumn("_rt", _tag(text, "reasoning")).withColumn("_qt", _tag(text, "cypher"))
    has_r, has_q = F.col("_rt") != "", F.col("_qt") != ""

    after = F.when(text.contains("</reasoning>"), strip_blank(after_last(text, "</reasoning>"))).otherwise("")
    before = F.when(text.contains("<cypher>"), strip_blank(cut_at(text, "<cypher>"))).otherwise("")
    free_reasoning_re = (
        rf"(?is)(?:{REASONING_WORDS}){BLANK}*:{BLANK}*(.*?)(?=(?:{QUERY_WORDS}){BLANK}*:|\z)"
    )
    free_query_re = rf"(?is)(?:{QUERY_WORDS}){BLANK}*(?:output)?{BLANK}*:{BLANK}*(.*)\z"
    both_free = F.regexp_like(text, F.lit(rf"(?is)(?:{REASONING_WORDS}){BLANK}*:")) & F.regexp_like(
        text, F.lit(rf"(?is)(?:{QUERY_WORDS}){BLANK}*(?:output)?{BLANK}*:")
    )

    reasoning = (
        F.when(has_r, strip_blank(F.col("_rt")))
        .when(has_q, before)
        .when(both_free, strip_blank(F.regexp_extract(text, free_reasoning_re, 1)))
        .otherwise("")
    )
    query = (
        F.when(has_q, _unfence(F.col("_qt")))
        .when(has_r, _unfence(after))
        .when(both_free, _unfence(F.regexp_extract(text, free_query_re, 1)))
        .otherwise("")
    )
    parsed = tagged.withColumn("reasoning", reasoning).withColumn("query", query)

    # A partial reply is rejected on its raw parts, before fences are removed.
    partial_fail = (has_r & ~has_q & (after == "")) | (has_q & ~has_r & (before == ""))
    n_r, n_q = F.length("reasoning"), F.length("query")
    upper = F.upper("query")
    has_kw = F.lit(False)
    for kw in QUERY_KEYWORDS:
        has_kw = has_kw | upper.contains(kw)
    error = (
        F.when(~has_r & ~has_q & ~both_free, NO_MARKERS)
        .when(partial_fail, NOT_BOTH)
        .when(n_r < MIN_REASONING, F.format_string("Reasoning too short (%d chars)", n_r))
        .when(n_q < MIN_QUERY, F.format_string("Cypher too short (%d chars)", n_q))
        .when(~has_kw, NO_KEYWORD)
    )
    return (
        parsed.withColumn("parse_error", error)
        .withColumn("ok", F.col("parse_error").isNull())
        .drop("_rt", "_qt")
    )


def marked_query(raw: Column, lang: str = "cypher") -> Column:
    """Query after the last output marker, without fences and explanation tails."""
    text = strip_chars(after_last(text_or_empty(raw), MARKERS[lang]), "`\n ")
    fence = f"{lang}\n"
    # Only the Cypher form compares its fence name in exact case.
    head = F.substring(text, 1, len(fence))
    head = head if lang == "cypher" else F.lower(head)
    text = strip_chars(
        F.when(head == fence, F.substring(text, len(fence) + 1, 2**31 - 1)).otherwise(text), "`\n "
    )
    if lang == "cypher":
        for tail in CYPHER_TAILS:
            text = cut_at(text, tail)
    return strip_blank(text)


def parse_marked_output(rows: DataFrame, raw_col: str, out_col: str, lang: str = "cypher") -> DataFrame:
    return rows.withColumn(out_col, marked_query(F.col(raw_col), lang))


def parse_marked_trace(rows: DataFrame, raw_col: str, lang: str = "sql") -> DataFrame:
    """Add ``reasoning`` and ``generated``; both empty without a marker."""
    marker, raw = MARKERS[lang], text_or_empty(F.col(raw_col))
    head = strip_blank(before_last(raw, marker))
    label = "reasoning:"
    head = F.when(
        F.lower(F.substring(head, 1, len(label))) == label,
        strip_blank(F.substring(head, len(label) + 1, 2**31 - 1)),
    ).otherwise(head)
    tail = strip_blank(strip_chars(strip_blank(after_last(raw, marker)), "`"))
    found = raw.contains(marker)
    return rows.withColumn("reasoning", F.when(found, head).otherwise("")).withColumn(
        "generated", F.when(found, tail).otherwise("")
    )


def clean_plain_output(rows: DataFrame, raw_col: str, out_col: str) -> DataFrame:
    """Output without explanation; leading letters of the fence name go one by one."""
    text = strip_chars(cut_at(text_or_empty(F.col(raw_col)), "**Explanation:**"), "`\n")
    text = F.regexp_replace(text, r"^[cypher\n]+", "")
    return rows.withColumn(out_col, strip_chars(text, "`\n "))


def usable_question(c: Column) -> Column:
    """The stripped question, or null when it is missing or still a template."""
    text = strip_blank(text_or_empty(c))
    bad = (text == "") | F.lower(text).isin(*MISSING_TEXT) | text.contains("{") | text.contains("}")
    return F.when(~bad, text)


def clean_pairs(
    rows: DataFrame,
    question_cols: Sequence[str],
    query_col: str,
    schema_col: str | None = None,
) -> DataFrame:
    """Rows with a question, a query and (if named) a schema.

    With several question columns the first usable one is taken and template
    texts are refused; a single column only has to be non-blank.
    """
    if len(question_cols) > 1:
        question = F.coalesce(*[usable_question(F.col(c)) for c in question_cols])
    else:
        only = strip_blank(text_or_empty(F.col(question_cols[0])))
        question = F.when(only != "", only)
    out = rows.withColumn("question", question).withColumn(
        query_col, strip_blank(text_or_empty(F.col(query_col)))
    )
    keep = F.col("question").isNotNull() & (F.col(query_col) != "")
    if schema_col:
        out = out.withColumn(schema_col, strip_blank(text_or_empty(F.col(schema_col))))
        keep = keep & (F.col(schema_col) != "")
    return out.filter(keep)


def resolve_fields(rows: DataFrame, alternatives: dict[str, Sequence[str]]) -> DataFrame:
    """Each target column takes the first non-empty of the named columns that exist."""
    for target, names in alternatives.items():
        present = [F.col(n) for n in names if n in rows.columns]
        value = first_filled(*present) if present else F.lit("")
        rows = rows.withColumn(f"_new_{target}", value)
    for target in alternatives:
        rows = rows.drop(target).withColumnRenamed(f"_new_{target}", target)
    return rows


def trainable(
    rows: DataFrame, arm: str, query_col: str = "cypher", matched: bool = True, need_query: bool = False
) -> DataFrame:
    """Training rows of an arm; ``matched`` gives both arms the reasoning filter.

    ``need_query`` also asks the cot filter for a query (SQL and SPARQL sets).
    """
    has_reasoning = ~is_blank(F.col("reasoning"))
    has_query = ~is_blank(F.col(query_col))
    cot = has_reasoning & has_query if need_query else has_reasoning
    return rows.filter(cot if matched or arm == "cot" else has_query)


def db_reachable(rows: DataFrame, alias_map: DataFrame, alias_col: str) -> DataFrame:
    """Rows whose alias maps to a database, with ``db_name``."""
    names = alias_map.select(F.col("alias").alias(alias_col), "db_name")
    return rows.join(names, alias_col)


def db_reach_counts(rows: DataFrame, alias_map: DataFrame, alias_col: str) -> DataFrame:
    """Mapped and unmapped rows per alias (missing: "unknown") and overall (alias null)."""
    known = F.coalesce(F.col(alias_col), F.lit("unknown")).alias(alias_col)
    per_alias = rows.groupBy(known).agg(F.count("*").alias("n"))
    names = alias_map.select(F.col("alias").alias(alias_col), "db_name")
    tagged = per_alias.join(names, alias_col, "left")
    mapped = F.col("db_name").isNotNull()
    return tagged.groupingSets([[alias_col], []], alias_col).agg(
        F.sum(F.when(mapped, F.col("n")).otherwise(0)).alias("n_mapped"),
        F.sum(F.when(~mapped, F.col("n")).otherwise(0)).alias("n_unmapped"),
    )
