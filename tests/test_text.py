"""Text helpers and scores on hand-written edge cases and against plain Python."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from armscope.functions import multiset, tokens
from armscope.functions import text as tx
from armscope.functions.multiset import overlap_size
from armscope.operators import scoring


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def test_norm_order(spark):
    got = column(spark, ["SELECT 1;", "SELECT 1 ;", "select  1", None], tx.norm_key)
    assert got == ["select 1", "select 1 ", "select 1", ""]


def test_norm_ws_query_keeps_space_before_semicolon(spark):
    assert column(spark, [" a  b ;", "a b;;"], tx.norm_ws_query) == ["a b ", "a b"]


def test_unicode_blanks_match_python(spark):
    texts = ["a\u001cb", "a b", "a\u0085b", "  a\t\n b　", "a​b", "a  b"]
    assert column(spark, texts, tx.norm_ws) == [" ".join(t.split()) for t in texts]


def test_13a_cases(spark):
    texts = ["&amp;lt;", "1.5", "2,000", "a.x>=1", "it's", "3-4", "", "  ", "x-\ny", "a<skipped>b"]
    assert column(spark, texts, tx.tokens_13a) == [
        ["<"], ["1.5"], ["2,000"], ["a", ".", "x", ">", "=", "1"], ["it's"], ["3", "-", "4"], [], [],
        ["xy"], ["ab"],
    ]


def python_tokens(line):
    """An independent reading of the 13a rules."""
    for old, new in [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"),
                     ("&lt;", "<"), ("&gt;", ">")]:
        line = line.replace(old, new)
    line = re.sub(r"([^\w\s',.\-]|_)", lambda m: f" {m[0]} " if ord(m[0]) < 128 else m[0], f" {line} ", flags=re.ASCII)
    line = re.sub(r"([^0-9])([.,])", r"\1 \2 ", line)
    line = re.sub(r"([.,])([^0-9])", r" \1 \2", line)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", line).split()


def python_gleu(pred, ref):
    def grams(t):
        return Counter(tuple(t[i:i + n]) for n in range(1, 5) for i in range(len(t) - n + 1))

    p, r = grams(python_tokens(pred)), grams(python_tokens(ref))
    return sum((p & r).values()), max(sum(p.values()), sum(r.values()))


def gleu(spark, pairs):
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)], "i int, p string, r string")
    rows = scoring.gleu_stats(df, "p", "r").orderBy("i").collect()
    return [(r["gleu_match"], r["gleu_all"]) for r in rows]


def test_gleu_edges(spark):
    assert gleu(spark, [("", "a b c"), ("x", "x"), ("a b c d e", "a b c d e"), (None, "a"), ("", "")]) == [
        (0, 6), (1, 1), (14, 14), (0, 1), (0, 0)
    ]


def test_gleu_against_python(spark):
    rng = random.Random(3)
    words = ["a", "b", "MATCH", "(n)", "x.y", "1.5", "3-4", "'q'", "->", "a,b", "é"]
    pairs = [
        (" ".join(rng.choices(words, k=rng.randint(0, 60))), " ".join(rng.choices(words, k=rng.randint(0, 60))))
        for _ in range(300)
    ]
    assert gleu(spark, pairs) == [python_gleu(p, r) for p, r in pairs]


def test_gleu_of_long_text_is_linear(spark):
    """A 200,000-word text against its shuffled copy: all unigrams meet."""
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(200_000)]
    other = words[:]
    rng.shuffle(other)
    (match, total), = gleu(spark, [(" ".join(words), " ".join(other))])
    assert (match, total) == python_gleu(" ".join(words), " ".join(other))


def test_overlap_size(spark):
    df = spark.createDataFrame(
        [(["a", "a", "b"], ["a", "b", "b"]), ([], ["a"]), (["c"], ["c"])], "l array<string>, r array<string>"
    )
    got = [r["o"] for r in df.select(overlap_size(F.col("l"), F.col("r")).alias("o")).collect()]
    assert got == [2, 0, 1]


def test_corpus_gleu_is_not_a_mean_of_rows(spark):
    df = spark.createDataFrame([("a", "g", 1, 1), ("a", "g", 0, 9)], "arm string, s string, gleu_match long, gleu_all long")
    rows = scoring.corpus_gleu(df, ["arm"], "s").collect()
    assert {r["gleu"] for r in rows} == {0.1}


def test_canon_sql(spark):
    texts = ["SELECT a FROM t WHERE x = 'A  b'", "select a\nfrom t where x='A  b';", "SELECT a FROM t /* c */ WHERE x = 'a b'", " "]
    a, b, c, blank = column(spark, texts, tx.canon_sql)
    assert a == b and a != c and blank is None


def test_length_buckets_are_half_open(spark):
    got = column(spark, ["x" * n for n in (49, 50, 99, 100, 199, 200, 499, 500)], scoring.length_bucket)
    assert got == ["0-50", "50-100", "50-100", "100-200", "100-200", "200-500", "200-500", "500+"]


def test_trace_stats_uses_sample_deviation(spark):
    df = spark.createDataFrame(
        [("a" * n, "q", "q") for n in (10, 20, 30, 60)] + [("", "", "q")],
        "reasoning string, generated_cypher string, cypher string",
    )
    row = scoring.trace_stats(df).first()
    assert (row["n_total"], row["n_success"], row["median_len"], row["mean_len"]) == (5, 4, 25.0, 30.0)
    assert abs(row["stdev_len"] - 21.602468994692867) < 1e-9


def test_arm_delta_missing_side_is_zero(spark):
    board = spark.createDataFrame([("direct", "g", 0.5)], "arm string, s string, em double")
    assert scoring.arm_delta(board, "s", ["em"]).first()["delta_em"] == -0.5


def test_mismatch_kinds(spark):
    rows = [("MATCH  (n)", "MATCH (n)"), ("match (n)", "MATCH (n)"), ("MATCH (n);", "MATCH (n)"),
            ("a 'x'", "a '" + "x" * 250 + "'"), ("foo", "bar"), ("same", "same")]
    # A failed trace is no mismatch.
    rows = [(*r, "because") for r in rows] + [("foo", "bar", ""), ("foo", "bar", None)]
    df = spark.createDataFrame(rows, "g string, r string, reasoning string")
    got = {r["kind"]: r["n"] for r in scoring.trace_mismatch_kinds(df, "g", "r").collect()}
    assert got == {"whitespace": 1, "case": 1, "semicolon": 1, "truncated_literal": 1, "other": 1}


def test_both_forms_of_the_13a_class_take_the_same_characters(spark):
    chars = [chr(i) for i in range(1, 0x250)]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    plain, listed = (df.select(F.regexp_like("c", F.lit(p))).collect() for p in (tx.PUNCT_13A, tx.PUNCT_13A_LISTED))
    assert plain == listed and sum(r[0] for r in plain) == 29


def test_13a_tokens_match_blanks_neither_as_punctuation_nor_by_the_pattern_of_all_blanks(spark):
    """F11, F16: both took a match or many tests for every character of a text; the tokens are those of the plain rules."""
    assert not any(re.search(p, " ") for p, _ in tx.RULES_13A_REGEX[:1])
    plan = spark.range(1).select(tx.tokens_13a(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert r"\u1680" not in plan
    rng = random.Random(31)
    parts = [*tx.BLANKS, "  ", "-\n", ".", ",", "..", "-", "1", "2", "a", "\u00e9", "\u200b", "&amp;", "<skipped>", "(", "'", "_", "~"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    assert column(spark, texts, tx.tokens_13a) == [python_tokens(t) for t in texts]


def test_canon_sql_keeps_literals_that_look_like_comments(spark):
    got = column(spark, ["x = 'k--1'", "x = 'k--2'", "x = 'a/*b*/c'", "x = 'ac'", "x=1 -- c", "X = 1 /* '*/", "a 'it''s --' b"], tx.canon_sql)
    assert got[0] != got[1] and got[2] != got[3] and got[4] == got[5] == "x = 1" and got[6] == "a'it''s --'b"


def test_canon_sql_keeps_what_stands_in_quotes(spark):
    """Comment marks, blanks and doubled quotes inside quoted names and literals are text."""
    apart = [
        'n = "x--1"', 'n = "x--2"', 'n = "a  b"', 'n = "a b"', 'n = "a/*b*/c"', 'n = "ac"', "n = 'a''--b'", "n = 'a''--c'",
        "n = 'a' 'b'", "n = 'a''b'", "n = `x;1`", "n = [x;2]", "n = 1.5", "n = 1 . 5", "a<=b", "a< =b", "n = 'open", "n = 'open --",
    ]
    assert len(set(column(spark, apart, tx.canon_sql))) == len(apart)
    one, two, three = column(spark, ['SELECT "a b",`c` FROM [t]/* x\n */ ;', 'select "A B" , [c]\u00a0from "t" -- y', "SELECT `a b`,\n\"c\" FROM `t`;;"], tx.canon_sql)
    assert one == two == three
    assert column(spark, ["a /* open", "a"], tx.canon_sql)[0] == "a"
    long = column(spark, ["x = '" + "it''s " * 20_000 + "'"], tx.canon_sql)[0]
    assert len(long) == 6 * 20_000 + 5


def test_canon_sql_joins_tokens_without_a_list(spark):
    cases = {
        "SELECT `a``b`, [c d], \"x`y\" FROM t -- it's [gone]\n WHERE n='it''s [ok]`' /* ' */ 'z' ;": (
            'select "a``b" , "c d" , "x`y" from t where n =\'it\'\'s [ok]`\' \'z\''
        ),
        "'a' '": "'a''", "` '1' [": "`'1'[", "'open ;": "'open", "-- only": "", "a  .  b": "a . b",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    column = tx.canon_sql(F.col("t"))
    assert [r["k"] for r in df.select("i", column.alias("k")).orderBy("i").collect()] == list(cases.values())
    assert "lambda" not in df.select(column.alias("k"))._jdf.queryExecution().optimizedPlan().toString()


def test_canon_sql_of_a_long_text(spark):
    row = spark.range(1).select(tx.canon_sql(F.repeat(F.lit("a='x' , `q` "), 20_000)).alias("k")).first()
    assert row["k"] == " ".join(["a ='x', \"q\""] * 20_000)


ODD_PARTS = [
    *tx.BLANKS, "  ", "-\n", ".", ",", "..", "...", ",.", "-", "--", "1", "2", "a", "\u00e9", "\u200b", "\u68a6", "&amp;", "&amp;lt;",
    "&quot;", "<skipped>", "(", "'", "_", "~", "x.", "1.", ",5",
]


@pytest.mark.parametrize("step", [64, tokens.STEP])
def test_digests_of_13a_tokens_stand_for_the_tokens_of_the_plain_rules(monkeypatch, step):
    """texts of a batch are cut into tokens together, whatever part of them is handled at a time."""
    monkeypatch.setattr(tokens, "STEP", step)
    rng = random.Random(7)
    texts = ["".join(rng.choice(ODD_PARTS) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [None, "", "x" * 9000, "y" * 9000]
    digests, at = tokens.digests_13a(pa.array(["cut off", *texts])[1:])
    assert len(at) == len(texts) + 1
    by_digest, by_token = {}, {}
    for i, text in enumerate(texts):
        got, want = digests[at[i] : at[i + 1]].tolist(), python_tokens(text or "")
        assert len(got) == len(want), text
        assert all(by_digest.setdefault(g, w) == w and by_token.setdefault(w, g) == g for g, w in zip(got, want)), text
    assert len(by_token) > 300 and tokens.digests_13a(pa.array([], pa.string()))[1].tolist() == [0]


@pytest.mark.parametrize("part,rows,group", [(50, 3, 100), (multiset.PART, multiset.PART_ROWS, multiset.GROUP)])
def test_gleu_of_near_copies_does_not_depend_on_parts(monkeypatch, part, rows, group):
    """equal tokens at both ends are not sorted, the n-grams across the seam still count."""
    for name, size in (("PART", part), ("PART_ROWS", rows), ("GROUP", group)):
        monkeypatch.setattr(multiset, name, size)
    rng = random.Random(11)
    words = ["a", "b", "a", "MATCH", "(n)", "x.y", "1.5", "3-4", "\u00e9"]
    pairs = []
    for _ in range(1500):
        left = rng.choices(words, k=rng.randint(0, 25))
        right = left[:]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(right))
            right[at : at + rng.randint(0, 2)] = rng.choices(words, k=rng.randint(0, 2))
        pairs.append((" ".join(left), " ".join(right)))
    shared, most = multiset._matched(pa.array([p for p, _ in pairs]), pa.array([r for _, r in pairs]), 4)
    assert list(zip(shared.tolist(), most.tolist())) == [python_gleu(p, r) for p, r in pairs]


def test_gleu_makes_no_lists_of_tokens_in_the_plan(spark):
    """patterns over every text and lists of tokens were most of the time of both boards."""
    df = spark.createDataFrame([("a", "b")], "p string, r string")
    text = scoring.gleu_stats(df, "p", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in text and "lambda" not in text and text.count("matched(") == 1


def test_canon_equal_is_equality_of_canonical_keys(spark):
    """keys are made only where shorter tests do not settle it."""
    parts = [
        "SELECT", " ", "  ", "a", "A", "'x  y'", "'X Y'", '"q r"', "`q r`", "[q r]", "--c", "\n", "/* k */", "=", ";", " ;", "1", "1.5",
        "\u0391\u03a3", "\u03b1\u03c2", "`B`", "'", "[", "]", "\u0130", "\u00a0",
    ]
    rng, pairs = random.Random(2), [(None, "a"), ("a", None), (None, None), ("", " "), ("", ""), ("\u0391\u03a3`B`", "\u03b1\u03c2`b`")]
    for _ in range(3000):
        a = rng.choices(parts, k=rng.randint(0, 8))
        b = [rng.choice([x.lower(), x.upper(), f" {x} ", x.replace("`", '"'), rng.choice(parts)]) if rng.random() < 0.2 else x for x in a]
        pairs.append(("".join(a), "".join([*b, rng.choice(["", "", ";", " ;", " -- z"])])))
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(F.coalesce(tx.canon_sql(a) == tx.canon_sql(b), F.lit(False)).alias("want"), tx.canon_equal(a, b).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows) and 500 < sum(r["got"] for r in rows) < 2900
