from pyspark.sql import functions as F

from armscope.operators import parsing

LONG = "The person node leads to the answer."
Q = "MATCH (n) RETURN n"


def parse(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_text string")
    return parsing.parse_traces(df).orderBy("i").collect()


def test_tagged_replies(spark):
    rows = parse(spark, [
        f"<reasoning>{LONG}</reasoning><cypher>{Q}</cypher>",
        f"<reasoning>{LONG}</reasoning>\n{Q}",
        f"{LONG}\n<cypher>\n```cypher\n{Q}\n```\n</cypher>",
        f"Reasoning: {LONG}\nCypher: {Q}",
        "nothing here",
        f"<reasoning>{LONG}</reasoning>",
    ])
    assert [r["ok"] for r in rows] == [True, True, True, True, False, False]
    assert [r["query"] for r in rows[:4]] == [Q] * 4
    assert [r["reasoning"] for r in rows[:4]] == [LONG] * 4
    assert rows[4]["parse_error"] == parsing.NO_MARKERS
    assert rows[5]["parse_error"] == parsing.NOT_BOTH


def test_empty_and_blank_reasoning_tags(spark):
    empty, blank = parse(spark, [
        f"<reasoning></reasoning><cypher>{Q}</cypher>", f"<reasoning> </reasoning><cypher>{Q}</cypher>",
    ])
    assert empty["ok"] and empty["reasoning"] == "<reasoning></reasoning>"
    assert blank["parse_error"] == "Reasoning too short (0 chars)"


def test_length_limits_and_keywords(spark):
    rows = parse(spark, [
        f"<reasoning>{'x' * 19}</reasoning><cypher>{Q}</cypher>",
        f"<reasoning>{'x' * 20}</reasoning><cypher>{Q}</cypher>",
        f"<reasoning>{'x' * 20}</reasoning><cypher>CALL</cypher>",
        f"<reasoning>{'x' * 20}</reasoning><cypher>CALL x</cypher>",
        f"<reasoning>{'x' * 20}</reasoning><cypher>SELECT 1</cypher>",
    ])
    assert [r["parse_error"] for r in rows] == [
        "Reasoning too short (19 chars)", None, "Cypher too short (4 chars)", None, parsing.NO_KEYWORD
    ]


def test_marked_query(spark):
    texts = [
        "SELECT 1", "Cypher output: a\nCypher output: b", f"Cypher output:\n```cypher\n{Q}\n```",
        f"{Q}\n\nExplanation: it reads.", f"{Q}**Explanation:** x", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    rows = parsing.parse_marked_output(df, "raw", "q").orderBy("i").collect()
    assert [r["q"] for r in rows] == ["SELECT 1", "b", Q, Q, Q, ""]


def test_marked_query_fence_case(spark):
    df = spark.createDataFrame([("SQL output: ```SQL\nSELECT 1\n```",)], "raw string")
    assert parsing.parse_marked_output(df, "raw", "q", "sql").first()["q"] == "SELECT 1"


def test_marked_trace(spark):
    df = spark.createDataFrame([("Reasoning: think\nSQL output: `SELECT 1`",), ("no marker",)], "raw string")
    rows = parsing.parse_marked_trace(df, "raw", "sql").collect()
    assert [(r["reasoning"], r["generated"]) for r in rows] == [("think", "SELECT 1"), ("", "")]


def test_plain_output_strips_a_character_set(spark):
    df = spark.createDataFrame([("```cypher\ncreate (n)```",)], "raw string")
    assert parsing.clean_plain_output(df, "raw", "q").first()["q"] == "ate (n)"


def test_clean_pairs_takes_first_usable_question(spark):
    df = spark.createDataFrame(
        [("n/a", "What {x}?", "Who?", "q"), ("A?", "B?", "C?", "q"), ("", "null", "{", "q"), ("A?", "", "", " ")],
        "a string, b string, c string, sparql string",
    )
    rows = parsing.clean_pairs(df, ["a", "b", "c"], "sparql").collect()
    assert [r["question"] for r in rows] == ["Who?", "A?"]


def test_db_reach_counts_keep_unmapped_rows(spark):
    rows = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], "id string, al string")
    names = spark.createDataFrame([("x", "db")], "alias string, db_name string")
    total = parsing.db_reach_counts(rows, names, "al").filter(F.col("al").isNull()).first()
    assert (total["n_mapped"], total["n_unmapped"]) == (2, 1)
