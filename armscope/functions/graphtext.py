"""Structure of graph-query text, read with regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches decide what counts as a hop, a label, a
# declared relation or a literal.
REL_USED = r"(?U)-\[(?::|[a-zA-Z_]\w*:)([A-Za-z_]\w*)\s*(?:\*[^\]]*)?\]"
REL_ORDERED = r"(?U)-\[:?(\w+)"
NODE_LABEL = r"(?U)\(\s*[a-zA-Z_]?\w*\s*:\s*([A-Za-z_]\w*)"
SCHEMA_ARROW = r"(?U)\(:([A-Za-z_]\w*)\)-\[:([A-Za-z_]\w*)\]->\(:([A-Za-z_]\w*)\)"
SCHEMA_BOLD = r"(?U)\*\*(\w+)\*\* -\[:(\w+)\]-> \*\*(\w+)\*\*"
#: The forms in which schema texts declare a relation.
SCHEMA_FORMS = (SCHEMA_ARROW, SCHEMA_BOLD)
QUOTED = r"'([^']*)'|\"([^\"]*)\""

# Query features and the pattern that shows each of them.
FEATURES = [
    ("UNION", r"(?iU)\bUNION\b"),
    ("VAR_LENGTH_PATH", r"\[[^\]]*\*[^\]]*\]"),
    ("CASE", r"(?iU)\bCASE\b"),
    ("COLLECT", r"(?iU)\bCOLLECT\s*\("),
    ("WHERE", r"(?iU)\bWHERE\b"),
    ("EXISTS", r"(?iU)\bEXISTS\b"),
    ("WITH", r"(?iU)\bWITH\b"),
    ("DISTINCT", r"(?iU)\bDISTINCT\b"),
    ("AGGREGATION", r"(?iU)\b(AVG|SUM|MIN|MAX)\s*\("),
    ("WRITE", r"(?iU)\b(CREATE|MERGE|SET|DELETE|REMOVE)\b"),
    ("COUNT", r"(?iU)\bCOUNT\s*\("),
    ("ORDER BY", r"(?iU)\bORDER\s+BY\b"),
    ("LIMIT", r"(?iU)\bLIMIT\b"),
    ("UNWIND", r"(?iU)\bUNWIND\b"),
    ("OPTIONAL MATCH", r"(?iU)\bOPTIONAL\s+MATCH\b"),
]


def relations(query: Column) -> Column:
    """Relation types in order of use, repeats kept."""
    return F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(REL_USED), 1)


def hop_count(query: Column) -> Column:
    """Number of relation markers ``-[``."""
    return F.regexp_count(F.coalesce(query, F.lit("")), F.lit(r"-\["))


def match_count(query: Column) -> Column:
    return F.regexp_count(F.coalesce(query, F.lit("")), F.lit(r"(?iU)\bMATCH\b"))


def labels(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(NODE_LABEL), 1)


def literals(query: Column) -> Column:
    """Distinct quoted literals, sorted."""
    text = F.coalesce(query, F.lit(""))
    quoted = F.regexp_extract_all(text, F.lit(QUOTED), 0)
    inner = F.transform(quoted, lambda q: F.substr(q, F.lit(2), F.length(q) - 2))
    return F.array_sort(F.array_distinct(inner))


def declared(schema: Column, pattern: str = SCHEMA_ARROW) -> Column:
    """Array of (a, rel, b) declared in a schema text; the pair is unordered."""
    text = F.coalesce(schema, F.lit(""))
    sources = F.regexp_extract_all(text, F.lit(pattern), 1)
    names = F.regexp_extract_all(text, F.lit(pattern), 2)
    targets = F.regexp_extract_all(text, F.lit(pattern), 3)
    return F.transform(
        F.arrays_zip(sources.alias("s"), names.alias("r"), targets.alias("t")),
        lambda x: F.struct(
            F.least(x["s"], x["t"]).alias("label_a"),
            x["r"].alias("rel"),
            F.greatest(x["s"], x["t"]).alias("label_b"),
        ),
    )


def shape(query: Column) -> Column:
    """How often a query unites, matches optionally, matches, takes a hop, and takes a starred hop."""
    text = F.coalesce(query, F.lit(""))

    def times(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    return F.struct(
        times(r"(?iU)\bUNION\b").alias("unions"),
        times(r"(?iU)\bOPTIONAL\s+MATCH\b").alias("optional"),
        match_count(query).alias("matches"),
        hop_count(query).alias("hops"),
        times(r"-\[[^\]]*\*").alias("starred"),
    )


#: The shape of a query whose answer lies one relation away.
ONE_HOP = {"unions": 0, "optional": 0, "matches": 1, "hops": 1, "starred": 0}


def is_one_hop(query: Column) -> Column:
    """One plain MATCH with one relation of fixed length."""
    seen, same = shape(query), F.lit(True)
    for name, wanted in ONE_HOP.items():
        same = same & (seen[name] == wanted)
    return same


def words_in(text: Column) -> Column:
    """The distinct words of a text, cut at non-word characters."""
    return F.array_distinct(F.split(F.coalesce(text, F.lit("")), r"(?U)\W+"))
