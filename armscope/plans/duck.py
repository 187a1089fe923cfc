"""Text helpers for the DuckDB twins: the same rules as SQL expressions."""

from __future__ import annotations

from armscope.functions.text import PUNCT_13A

# Blanks as an RE2 class.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def rx(e: str, pattern: str, to: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"regexp_replace({e}, '{pattern}', '{to}', 'g')"


def norm_ws(e: str) -> str:
    return f"trim({rx(f'coalesce({e}, chr(32))', WS + '+', ' ')})"


def strip_blank(e: str) -> str:
    return rx(e, f"^{WS}+|{WS}+$", "")


def raw_key(e: str) -> str:
    return rx(strip_blank(f"coalesce({e}, '')"), ";+$", "")


def norm_key(e: str) -> str:
    return f"lower({rx(raw_key(e), WS + '+', ' ')})"


def norm_ws_query(e: str) -> str:
    return rx(norm_ws(e), ";+$", "")


def is_blank(e: str) -> str:
    return f"({strip_blank(f'coalesce({e}, chr(32))')} = '')"


def tokens_13a(e: str) -> str:
    s = f"coalesce({e}, '')"
    for old, new in [
        ("'<skipped>'", "''"), ("('-' || chr(10))", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"),
        ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'"),
    ]:
        s = f"replace({s}, {old}, {new})"
    s = f"' ' || {s} || ' '"
    s = rx(s, f"({PUNCT_13A})", r" \1 ")
    s = rx(s, r"([^0-9])([.,])", r"\1 \2 ")
    s = rx(s, r"([.,])([^0-9])", r" \1 \2")
    s = rx(s, r"([0-9])(-)", r"\1 \2 ")
    return words(s)


def words(e: str) -> str:
    return f"list_filter(str_split({norm_ws(e)}, ' '), lambda t: t <> '')"


def _gram_ctes(name: str, col: str) -> str:
    """Counted n-grams of a token list, from windows over its numbered tokens."""
    window = "(PARTITION BY rid ORDER BY pos)"
    parts = []
    for n in range(1, 5):
        cols = " || ' ' || ".join(["t"] + [f"t{k}" for k in range(1, n)])
        need = f" WHERE t{n - 1} IS NOT NULL" if n > 1 else ""
        parts.append(f"SELECT rid, {cols} AS g FROM {name}_w{need}")
    leads = ", ".join(f"lead(t, {k}) OVER {window} AS t{k}" for k in (1, 2, 3))
    return f"""{name}_t AS (SELECT rid, unnest({col}) AS t, generate_subscripts({col}, 1) AS pos FROM toks),
{name}_w AS (SELECT rid, t, {leads} FROM {name}_t),
{name} AS (SELECT rid, g, count(*) AS c FROM ({" UNION ALL ".join(parts)}) GROUP BY rid, g)"""


def _n_grams(col: str) -> str:
    return "(" + " + ".join(f"greatest(len({col}) - {n - 1}, 0)" for n in range(1, 5)) + ")"


def gleu_ctes(pairs: str, pred: str, ref: str) -> str:
    """CTEs that end in ``stat``: the pairs with gleu_match and gleu_all."""
    return f"""
src AS MATERIALIZED ({pairs}),
toks AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, {tokens_13a(pred)} AS tp, {tokens_13a(ref)} AS tr FROM src),
{_gram_ctes('gp', 'tp')},
{_gram_ctes('gr', 'tr')},
hit AS (SELECT rid, sum(least(gp.c, gr.c)) AS m FROM gp JOIN gr USING (rid, g) GROUP BY rid),
stat AS (SELECT toks.*, CAST(coalesce(m, 0) AS BIGINT) AS gleu_match,
  CAST(greatest({_n_grams('tp')}, {_n_grams('tr')}) AS BIGINT) AS gleu_all
  FROM toks LEFT JOIN hit USING (rid))"""


SQL_TOKEN = (
    r"--[^\n]*|(?s:/\*.*?(?:\*/|\z))|'[^']*(?:''[^']*)*(?:'|\z)" + r'|"[^"]*(?:""[^"]*)*(?:"|\z)'
    r"|`[^`]*(?:``[^`]*)*`|\[[^\]]*\]|[0-9]+(?:\.[0-9]+)?|[\p{L}_][\p{L}\p{N}_$]*|<=|>=|<>|!=|\|\||" + WS.replace("[", "[^", 1)
)


def canon_sql(e: str) -> str:
    pattern = SQL_TOKEN.replace("'", "''")
    tokens = f"""list_filter(regexp_extract_all(coalesce({e}, ''), '{pattern}'), lambda t: NOT (starts_with(t, '--') OR starts_with(t, '/*')))"""
    named = f"""list_transform({tokens}, lambda t: CASE WHEN len(t) > 1 AND left(t, 1) IN ('`', '[')
      THEN chr(34) || substr(t, 2, len(t) - 2) || chr(34) ELSE t END)"""
    # A literal next to what is no literal has no blank between; a mark that no token holds shows where.
    marked = f"""list_transform({named}, lambda t: CASE WHEN len(t) > 1 AND left(t, 1) = chr(39) THEN chr(29) || t || chr(29) ELSE chr(30) || t || chr(30) END)"""
    joined = f"""replace(replace(replace(replace(array_to_string({marked}, ''), chr(30) || chr(30), ' '), chr(29) || chr(29), ' '), chr(29), ''), chr(30), '')"""
    return f"CASE WHEN {is_blank(e)} THEN NULL ELSE lower({rx(joined, '[ ;]+$', '')}) END"


def rate(flag: str) -> str:
    return f"avg(CASE WHEN {flag} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def count_if(flag: str) -> str:
    return f"count(CASE WHEN {flag} THEN 1 END)"


REL_USED = r"-\[(?::|[a-zA-Z_]\w*:)([A-Za-z_]\w*)\s*(?:\*[^\]]*)?\]"


def relations(e: str) -> str:
    return f"regexp_extract_all({e}, '{REL_USED}', 1)"


def count_rx(e: str, pattern: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"len(regexp_extract_all({e}, '{pattern}'))"


def digest_order(key: str) -> str:
    return f"md5({key}), {key}"
