"""Column helpers for text: whitespace, normal forms, tokens.

They return Column expressions only, so they run inside the JVM and can be
used in any select, filter or aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's str.split() treats as blank.  Java's
# \s covers only part of them.  Single Latin characters are one table look-up
# for the JVM, and the others sit behind one range check.
BLANK = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)

# The same characters one by one, to trim a text without a pattern.
BLANKS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# The mteval-13a punctuation class as published.
PUNCT_13A = r"[\{-\~\[-\` -\&\(-\+\:-\@\/]"
# The same characters one by one: Java tests a list faster than this many ranges.
PUNCT_13A_LISTED = r"""[ !"#$%&()*+/:;<=>?@\[\\\]^_`{|}~]"""

# The mteval-13a rules as (pattern, replacement).
RULES_13A_LITERAL = [
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
]
# A blank is in the class too, but more blanks around it change no token, and it is by far the most frequent match.
RULES_13A_REGEX = [
    (f"({PUNCT_13A_LISTED.replace(' ', '', 1)})", r" $1 "),
    (r"([^0-9])([.,])", r"$1 $2 "),
    (r"([.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip_blank(c: Column) -> Column:
    """Drop blanks at both ends (all Unicode blanks, not only spaces)."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return ~F.regexp_like(text_or_empty(c), F.lit(f"(?!{BLANK})[\\s\\S]"))


def norm_ws(c: Column) -> Column:
    """Collapse runs of blanks to one space and strip; null becomes ''."""
    return F.trim(F.regexp_replace(text_or_empty(c), f"{BLANK}+", " "))


def norm_ws_query(c: Column) -> Column:
    """``norm_ws`` and then drop trailing semicolons (a space before one stays)."""
    return F.rtrim(norm_ws(c), F.lit(";"))


def raw_key(c: Column) -> Column:
    """Stripped text without trailing semicolons."""
    return F.rtrim(strip_blank(text_or_empty(c)), F.lit(";"))


def norm_key(c: Column) -> Column:
    """Strip, drop trailing semicolons, collapse blanks, lower case, in this order."""
    return fold_key(raw_key(c))


def fold_key(raw: Column) -> Column:
    """A raw key with blanks collapsed and in lower case."""
    return F.lower(F.regexp_replace(raw, f"{BLANK}+", " "))


def strip_chars(c: Column, chars: str) -> Column:
    """Strip any of ``chars`` from both ends, like Python's str.strip(chars)."""
    inside = "".join(_escape(ch) for ch in chars)
    return F.regexp_replace(c, f"^[{inside}]+|[{inside}]+$", "")


def _escape(ch: str) -> str:
    return {"\n": r"\n", "\\": r"\\", "]": r"\]", "^": r"\^", "-": r"\-"}.get(ch, ch)


def cut_at(c: Column, separator: str) -> Column:
    """Text before the first ``separator`` (the whole text without one)."""
    return F.substring_index(c, separator, 1)


def after_last(c: Column, marker: str) -> Column:
    """Text after the last ``marker`` (the whole text without one)."""
    return F.substring_index(c, marker, -1)


def before_last(c: Column, marker: str) -> Column:
    """Text before the last ``marker``."""
    tail = F.length(after_last(c, marker)) + F.lit(len(marker))
    return F.substr(c, F.lit(1), F.length(c) - tail)


def tokens_13a(c: Column) -> Column:
    """mteval-13a tokens as an array of strings."""
    out = text_or_empty(c)
    for old, new in RULES_13A_LITERAL:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, to in RULES_13A_REGEX:
        out = F.regexp_replace(out, pattern, to)
    # Blanks become spaces one by one: the pattern of all blanks tests every character several times.  Empty items between
    # spaces are no tokens.
    spaced = F.translate(out, BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def words(c: Column) -> Column:
    """Blank-separated words; an empty text has none."""
    return F.array_remove(F.split(norm_ws(c), " "), "")


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty, else ''."""
    return F.coalesce(*[F.when(c != "", c) for c in cols], F.lit(""))


#: Blanks and comments of an SQL text, and its tokens: literals, quoted names, numbers, names, operators, and any other
#: character. What begins first is taken whole, so a comment mark inside quotes is text and a quote inside a comment is
#: none; what is not closed goes on to the end.
SQL_SKIPPED = r"(?:" + BLANK + r"++|--[^\n]*|/\*[\s\S]*?(?:\*/|\z))"
SQL_LITERAL = r"'[^']*+(?:''[^']*+)*+(?:'|\z)"
SQL_QUOTED = r'"[^"]*+(?:""[^"]*+)*+(?:"|\z)'
SQL_BACKQUOTED, SQL_BRACKETED = r"[^`]*+(?:``[^`]*+)*+", r"[^\]]*+"
SQL_TOKEN = (
    rf"{SQL_LITERAL}|{SQL_QUOTED}|`{SQL_BACKQUOTED}`|\[{SQL_BRACKETED}\]"
    r"|[0-9]++(?:\.[0-9]++)?|[\p{L}_][\p{L}\p{N}_$]*+"
    r"|<=|>=|<>|!=|\|\||[\s\S]"
)
#: Among tokens with a blank before each: a quoted name as it is (group 1), or literals without the blanks around them.
_LITERAL = rf"(?!'\z){SQL_LITERAL}"
SQL_LITERALS = (
    rf"( ?+(?:{SQL_QUOTED}|`{SQL_BACKQUOTED}`|\[{SQL_BRACKETED}\]))|"
    rf" ({_LITERAL}(?: {_LITERAL})*+)(?: (?!'(?!\z)))?"
)
#: Text up to a name in backquotes or brackets (group 1), and what stands inside it.
SQL_OTHER_QUOTES = (
    rf"\G((?:{SQL_LITERAL}|{SQL_QUOTED}|(?!`{SQL_BACKQUOTED}`|\[{SQL_BRACKETED}\])[\s\S])*+)"
    rf"(?:`({SQL_BACKQUOTED})`|\[({SQL_BRACKETED})\])"
)


def canon_sql(c: Column) -> Column:
    """Spacing-, case- and comment-free key of an SQL text: its tokens, in lower case.

    Literals and quoted names keep what stands inside; names in backquotes or
    brackets are written in double quotes.  A semicolon at the end does not count.  A blank
    text gives null (it has no canonical form).
    """
    # One blank between tokens, but none between a literal and what is no literal.  Every pass stands once in the
    # expression, and the condition reads the column: a step that is named twice is worked out twice.
    tokens = F.regexp_replace(text_or_empty(c), f"{SQL_SKIPPED}*+({SQL_TOKEN})|{SQL_SKIPPED}++", " $1")
    spaced = F.regexp_replace(tokens, SQL_LITERALS, "$1$2")
    quoted = F.when(
        c.contains("`") | c.contains("["), F.regexp_replace(spaced, SQL_OTHER_QUOTES, '$1"$2$3"')
    ).otherwise(spaced)
    key = F.lower(F.regexp_replace(quoted, "^ |[ ;]+$", ""))
    return F.when(is_blank(c), F.lit(None).cast("string")).otherwise(key)


def canon_equal(a: Column, b: Column) -> Column:
    """Whether two SQL texts have equal canonical keys; false where one is null or blank.

    Keys are made only for texts that differ and are not told apart sooner: without a comment mark, a key keeps all
    characters but blanks, semicolons and the quotes of names, in lower case.
    """
    # The lower case of a sigma depends on what follows it.
    kept = lambda c: F.translate(F.lower(c), "\u03c2" + BLANKS + '"`[];', "\u03c3")
    commented = lambda c: c.contains("--") | c.contains("/*")
    return (
        F.when(a == b, ~is_blank(a))
        .when(~commented(a) & ~commented(b) & (kept(a) != kept(b)), F.lit(False))
        .otherwise(F.coalesce(canon_sql(a) == canon_sql(b), F.lit(False)))
    )


def code_balanced(c: Column) -> Column:
    """True when a non-blank text has as many '(' as ')'."""
    return (~is_blank(c)) & (
        F.length(F.replace(c, F.lit("("), F.lit("")))
        == F.length(F.replace(c, F.lit(")"), F.lit("")))
    )
