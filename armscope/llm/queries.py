"""The queries of this package, one per operator, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armscope.llm import (
    alignment, chat_format, compression, html_text, line_dedup, merkle, mixing, packing, pieces, quality_rules, search,
    simhash, token_counts,
)
from armscope.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file of the installed ``public_tokenizers``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


@_query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document; SQL has no XXH64, tests compare with brute force."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _print_sql(text: str) -> str:
    """The fingerprint of a text; RE2 reads the piece pattern as Java does."""
    tree = f"""list_transform(string_split({text}, chr(10) || chr(10)), lambda s:
  list_transform(string_split(s, chr(10)), lambda p:
  list_transform(regexp_extract_all(p, '{merkle.PIECES}'), lambda x: sha256(x))))"""
    root = (
        f"sha256(array_to_string(list_transform({tree}, lambda s: sha256(array_to_string("
        "list_transform(s, lambda p: sha256(array_to_string(p, ''))), ''))), ''))"
    )
    short = (
        f"array_to_string(list_transform({tree}, lambda s: array_to_string(list_transform(s, lambda p: "
        f"array_to_string(list_transform(p, lambda x: substr(x, 1, {merkle.DIGITS})), ',')), ';')), '/')"
    )
    return f"{root} || '/' || {short}"


def _likeness_sql(a: str, b: str) -> str:
    def parts(c: str) -> str:
        return f"list_distinct(list_filter(regexp_split_to_array(substr({c}, 66), '[/;,]'), lambda x: x <> ''))"

    sizes = f"(len({parts(a)}) + len({parts(b)}))"
    return (
        f"CASE WHEN substr({a}, 1, 64) = substr({b}, 1, 64) THEN 1.0::DOUBLE WHEN {sizes} = 0 THEN 0.0::DOUBLE "
        f"ELSE (2 * len(list_intersect({parts(a)}, {parts(b)})))::DOUBLE / {sizes} END"
    )


@_query("op2_merkle_fingerprints", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nxt FROM d),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(nxt, 1, length(text) // 2) AS edit FROM n),
f AS (SELECT *, {_print_sql('text')} AS fingerprint, {_print_sql('edit')} AS edited_fingerprint,
  {_print_sql('nxt')} AS next_fingerprint FROM e)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edit) AS edited_sha256, fingerprint, edited_fingerprint,
  {_likeness_sql('fingerprint', 'edited_fingerprint')} AS near_edited,
  {_likeness_sql('fingerprint', 'next_fingerprint')} AS near_next
FROM f""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and of its edit by the next one."""
    return merkle.neighbour_edits(table(spark, sf_dir, "documents"))


_BARE = "trim(regexp_replace(x, '[\\t\\r]', ' ', 'g'))"


@_query("op3_line_dedup", f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS lines FROM documents),
t AS (SELECT host, count(*) AS n_pages FROM d GROUP BY host),
k AS (SELECT host, unnest(list_distinct(list_filter(list_transform(lines, lambda x: {_BARE}), lambda x: x <> ''))) AS line FROM d),
b AS (SELECT host, line FROM (SELECT host, line, count(*) AS n FROM k GROUP BY host, line) c JOIN t USING (host)
  WHERE n >= {line_dedup.MIN_PAGES} AND n > {line_dedup.RATIO} * n_pages),
l AS (SELECT host, list(line) AS bad FROM b GROUP BY host),
r AS (SELECT doc_id, text, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(bad, {_BARE}), false)) AS stay
  FROM d LEFT JOIN l USING (host))
SELECT doc_id, CASE WHEN len(stay) < len(lines) THEN array_to_string(stay, chr(10)) ELSE text END AS text,
  CAST(coalesce(len(lines) - len(stay), 0) AS BIGINT) AS n_lines_dropped FROM r""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on over a tenth of their source's documents."""
    docs = table(spark, sf_dir, "documents")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "text", "n_lines_dropped")


def _rake_sql(sweeps: int, temper: float) -> str:
    """The sweeps as a chain of common tables."""
    keys = ("source", "lang", "topic")
    ctes = []
    for by in keys:
        ctes.append(f"goal_{by} AS MATERIALIZED (SELECT {by}, p / sum(p) OVER () AS target FROM (SELECT {by}, "
                    f"pow(sum(tokens)::DOUBLE, {temper}::DOUBLE) AS p FROM cells GROUP BY {by}))")
    ctes.append("w0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS w FROM cells)")
    n = 0
    for _ in range(sweeps):
        for by in keys:
            ctes.append(
                f"w{n + 1} AS MATERIALIZED (SELECT c.* EXCLUDE (w), CASE WHEN now > 0 THEN w * (target / now) ELSE 0 END AS w FROM "
                f"(SELECT *, sum(w) OVER (PARTITION BY {by}) AS now FROM w{n}) c JOIN goal_{by} USING ({by}))"
                .replace("c.* EXCLUDE (w)", "c.* EXCLUDE (w, now)")
            )
            n += 1
    ctes.append(f"rates AS (SELECT source, lang, topic, coalesce(w / nullif(tokens, 0) / max(w / nullif(tokens, 0)) OVER (), 1.0) AS rate FROM w{n})")
    return ",\n".join(ctes)


#: Sweeps of the twin: more than the operator needs on the given tables, so both have converged.
RAKE_SWEEPS = 24


@_query("op4_mix_sources", f"""
WITH raw AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
  coalesce(text, '') AS t FROM documents),
base AS (SELECT doc_id, source, lang, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS tokens,
  CASE WHEN length(trim(t)) = 0 THEN 'empty'
       WHEN (length(t) - length(replace(t, '|', ''))) * 25 > length(t) THEN 'list'
       WHEN (length(t) - length(replace(t, '!', ''))) * 25 > length(t) THEN 'shout'
       WHEN (length(t) - length(translate(t, '#*$%&', ''))) * 25 > length(t) THEN 'symbols'
       WHEN (length(t) - length(replace(t, chr(10), ''))) * 150 > length(t) THEN 'verse' ELSE 'prose' END AS topic
  FROM raw),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM base GROUP BY ALL),
{_rake_sql(RAKE_SWEEPS, mixing.TEMPER)}
SELECT doc_id, topic, base.tokens::BIGINT AS tokens, round(rate, 6) AS rate,
  ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < rate AS drawn
FROM base JOIN rates USING (source, lang, topic)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its raked rate and whether it is drawn; targets are tempered natural shares."""
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "topic", F.col("tokens").cast("bigint").alias("tokens"), F.round("rate", 6).alias("rate"), "drawn")


@_query("op5_compression_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = compression.learn(docs, table(spark, sf_dir, "labels"))
    return compression.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", compression.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def _escape_sql(e: str) -> str:
    out = f"replace({e}, chr(92), chr(92) || chr(92))"
    for mark in chat_format.CONTROLS:
        out = f"replace({out}, '{mark}', '{mark[0]}' || chr(92) || '{mark[1:]}')"
    return out


#: Conversation -1: both turns hold control strings of common templates.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@_query("op6_chat_examples", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
s AS (SELECT *, length('<s>[INST]' || {_escape_sql('role')} || '[/INST]' || {_escape_sql('text')} || '</s>') AS size,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
  count(*) OVER (PARTITION BY conv_id) AS n FROM t),
r AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM s)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the training examples of every conversation, read back from their formatted texts, say."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat_format.digest(chat_format.prefix_targets(turns.unionByName(planted)))


@_query("op7_piece_segmentations")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pieces of every document and its next best segmentations, with the round trip checked."""
    return pieces.with_pieces(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), keep=["doc_id"])


@_query("op8_html_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html_text.with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@_query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, tokenizer_file("piece_bpe_32k.model")).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit"
    )


@_query("op10_weak_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and posterior verdict of every document."""
    judged = quality_rules.judged(table(spark, sf_dir, "documents"), keep=["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(
        "doc_id", *[F.col(f"_f.{n}").alias(n) for n in names], "base_failed", "kept", F.round("posterior", 6).alias("posterior")
    )


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query("op11_term_pipeline_search", f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_FOLDED}, '{_TERMS}') AS ts FROM documents),
s AS (SELECT count(*) AS N, sum(len(ts))::BIGINT AS L FROM d WHERE len(ts) > 0),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, N),
i AS (SELECT item_id, row_number() OVER () AS k, {_FOLDED} AS text FROM benchmark),
q AS (SELECT item_id, k, unnest(list_distinct(regexp_extract_all(text, '{_TERMS}'))) AS term FROM i),
h AS (SELECT item_id, k, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.ts) * N) // L))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), s GROUP BY item_id, k, r),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank
  FROM h JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= {search.TOP}""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every benchmark item."""
    return search.ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@_query("op12_best_fit_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence and an offset for every token piece of every document."""
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@_query("op13_cross_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment figures of every document; both byte-level files hold one vocabulary, and the rank file is read faster."""
    return alignment.aligned(
        table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_file("piece_bpe_32k.model")
    )
