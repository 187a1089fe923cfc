import public_tokenizers
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Column names that the operators use or add themselves.
CLASHES = ["_f", "kept", "rate", "score", "_tree", "_way", "component_id", "print", "_xt", "_host", "n_tokens", "_kept", "b"]


@pytest.fixture(scope="session")
def model_path():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts or (text, lang, source); ids from 0; with columns of clashing names if asked."""

    def make(rows, clash=False):
        full = []
        for i, r in enumerate(rows):
            text, lang, source = r if isinstance(r, tuple) else (r, "en", "src0")
            full.append((i, text, lang, source, len(text) if text is not None else None))
        df = spark.createDataFrame(full, DOCS)
        if clash:
            df = df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHES])
        return df

    return make


EDGES = [
    None, "", " ", "\n\n", "a", "a", "One two three.", "word " * 30_000, "x" * 50_000, None,
    "Ünïcödé 梦 ▁   text </s>", "the cat sat\nthe cat sat\nthe cat sat",
]


@pytest.fixture(scope="session")
def edges():
    """Nulls, empty, blank, long, repeated and odd texts."""
    return list(EDGES)
