from pyspark.sql import functions as F

from armscope.functions import graphtext as g
from armscope.operators import structure, training
from armscope.operators.scoring import query_features

SCHEMA = "(:A)-[:R]->(:B)\n(:B)-[:S]->(:A)\n(:A)-[:T]->(:C)"


def test_one_hop_exclusions(spark):
    refs = [
        "MATCH (a:A)-[:R]->(b:B) RETURN a", "MATCH (a:A) OPTIONAL MATCH (a)-[:R]->(b:B) RETURN a",
        "MATCH (a:A)-[:R]->(b:B) RETURN a UNION MATCH (a:A) RETURN a", "MATCH (a:A)-[:R*1..3]->(b:B) RETURN a",
        "MATCH (a:A)-[:R]->(b:B)-[:S]->(c:A) RETURN a", "MATCH (a:A)-[:X]->(b:B) RETURN a", "MATCH (a:A)-[:R]->() RETURN a",
    ]
    df = spark.createDataFrame([(str(i), r, SCHEMA, r + ";", "MATCH (a:A)-[:S]->(b:B) RETURN a") for i, r in enumerate(refs)],
                               "id string, ref string, schema string, direct_pred string, cot_pred string")
    row, = structure.one_hop_rows(df, "id", "ref", "schema").collect()
    assert (row["id"], row["ambiguity"], row["rel_type"], row["labels"]) == ("0", 2, "R", ["A", "B"])
    assert (row["direct_em"], row["cot_em"], row["direct_correct_rel"], row["cot_correct_rel"]) == (1, 0, 1, 0)


def q(*rels):
    return "MATCH (a)" + "".join(f"-[:{r}]->(x)" for r in rels) + " RETURN a"


def test_relation_change_is_a_multiset_test(spark):
    cases = [(("R", "R"), ("R",), "added"), (("R",), ("R", "R"), "dropped"), (("R", "S"), ("S", "R"), "same"),
             (("X",), ("R",), "disjoint"), (("R", "X"), ("R", "S"), "overlap"), ((), ("R",), "dropped"), ((), (), "same")]
    df = spark.createDataFrame([(i, q(*p), q(*r)) for i, (p, r, _) in enumerate(cases)], "i int, p string, r string")
    rows = structure.with_relations(df, "p", "r").select("i", structure.relation_change().alias("k")).orderBy("i").collect()
    assert [r["k"] for r in rows] == [c[2] for c in cases]


def test_clean_subpath_positions(spark):
    ref = ("A1", "B1", "C1", "D1")
    preds = [("B1", "C1", "D1"), ("A1", "B1", "C1"), ("A1", "C1", "D1"), ("C1", "A1"), ("A1", "B1")]
    df = spark.createDataFrame([(i, q(*p), q(*ref)) for i, p in enumerate(preds)], "i int, p string, r string")
    rows = structure.clean_subpath(df, ["i"], "p", "r").orderBy("i").collect()
    assert [r["clean"] for r in rows] == [True, True, True, False, True]
    assert [r["missing_at"] for r in rows] == ["start", "end", "mid", "start", "mid"]


def test_literals(spark):
    df = spark.createDataFrame([("x = 'a' AND y = \"b\" AND z = 'a'",)], "t string")
    assert df.select(g.literals(F.col("t")).alias("l")).first()["l"] == ["a", "b"]


def test_filter_values(spark):
    df = spark.createDataFrame(
        [("1", "x='a'", "x='a'", ""), ("2", "x=1", "x='a'", ""), ("3", "x='a' AND y='v'", "x='a'", "use v"), ("4", "x='b'", "x='a'", "use a")],
        "id string, p string, r string, why string",
    )
    rows = structure.filter_values(df, ["id"], "p", "r", "why").orderBy("id").collect()
    assert [(r["change"], r["wrong_in_reasoning"]) for r in rows] == [("same", False), ("dropped", False), ("added", True), ("swapped", False)]


def test_plan_vs_query_matches_whole_words(spark):
    df = spark.createDataFrame([("1", q("R"), q("R", "IN"), "follow IN_X"), ("2", q("R"), q("R", "IN"), "follow IN, then")],
                               "id string, p string, r string, why string")
    rows = structure.plan_vs_query(df, ["id"], "p", "r", "why").orderBy("id").collect()
    assert [(r["rel"], r["absent_from_plan"]) for r in rows] == [("IN", True), ("IN", False)]


def test_features(spark):
    df = spark.createDataFrame([("MATCH (a)-[:R*1..2]->(b) OPTIONAL MATCH (b) WITH a WHERE a.x RETURN DISTINCT count(a), avg(a.y) ORDER BY a LIMIT 3",)], "t string")
    got = set(df.select(query_features(F.col("t")).alias("f")).first()["f"])
    assert got == {"1-hop", "VAR_LENGTH_PATH", "WHERE", "WITH", "DISTINCT", "AGGREGATION", "COUNT", "ORDER BY", "LIMIT", "OPTIONAL MATCH"}


def test_bold_schema_form(spark):
    df = spark.createDataFrame([("- **A** -[:R]-> **B** (x)",)], "s string")
    row = structure.schema_relations(df, "s", g.SCHEMA_BOLD).first()
    assert (row["label_a"], row["rel"], row["label_b"]) == ("A", "R", "B")


def test_schemas_are_parsed_once_each_in_any_form(spark):
    both = "(:A)-[:R]->(:B) then **A** -[:S]-> **C**"
    rows = spark.createDataFrame([(both,)] * 500 + [("**B** -[:R]-> **A**",), ("none",), (None,)], "s string")
    found = structure.schema_dictionary(rows, "s")
    assert sorted(sorted((x["label_a"], x["rel"], x["label_b"]) for x in r["declared"]) for r in found.collect()) == [
        [], [("A", "R", "B")], [("A", "R", "B"), ("A", "S", "C")],
    ]
    # The texts collapse before they are parsed: the patterns stand in the results of the aggregate, not below it.
    top, *below = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert top.startswith("Aggregate [_s") and "regexp" in top and not any("regexp" in line for line in below)


def test_one_hop_rows_know_both_forms_and_miss_null_schemas(spark):
    ref = "MATCH (a:A)-[:R]->(b:B) RETURN b"
    rows = [("1", "(:A)-[:R]->(:B)\n(:B)-[:Q]->(:A)"), ("2", "**A** -[:R]-> **B**"), ("3", None), ("4", "(:A)-[:X]->(:B)")]
    df = spark.createDataFrame([(i, ref, s, ref, "x") for i, s in rows], "id string, r string, s string, direct_pred string, cot_pred string")
    got = {r["id"]: (r["ambiguity"], r["direct_em"], r["cot_em"]) for r in structure.one_hop_rows(df, "id", "r", "s").collect()}
    assert got == {"1": (2, 1, 0), "2": (1, 1, 0)}


def test_ladder(spark):
    rows = [(str(i), a, "s", v) for i in range(4) for a, v in (("direct", i < 3), ("qdecomp", i < 1), ("holistic", i < 2))]
    rows += [("9", "direct", "s", True)]
    df = spark.createDataFrame(rows, "instance_id string, arm string, split string, exec_match boolean")
    got = {r["arm"]: (r["n"], r["accuracy"], r["recovered_share"]) for r in structure.ladder_board(df, ["direct", "qdecomp", "holistic"], "qdecomp", "direct").collect()}
    assert got == {"direct": (4, 0.75, 1.0), "qdecomp": (4, 0.25, 0.0), "holistic": (4, 0.5, 0.5)}


def test_loss_span_after_first_marker(spark):
    df = spark.createDataFrame([("a b <m> c d <m> e",), ("a b",), ("a b c d e f <m> g",)], "t string")
    rows = training.loss_spans(df, "t", "<m>", 6).collect()
    assert [(r["n_tokens"], r["loss_from"], r["n_loss"], r["masked"]) for r in rows] == [(6, 3, 3, False), (2, 2, 0, True), (6, 6, 0, True)]


def test_packing_covers_every_token_once(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("id"), (F.col("id") * 37 % 5000).alias("n"))
    pieces = training.pack_blocks(df, "id", F.col("n"), 1600).collect()
    total = sum(i * 37 % 5000 for i in range(300))
    assert sum(p["row_to"] - p["row_from"] for p in pieces) == total
    spots = sorted((p["block_id"] * 1600 + p["block_from"], p["row_to"] - p["row_from"]) for p in pieces)
    at = 0
    for start, width in spots:
        assert start == at
        at += width
    assert all(p["block_from"] + p["row_to"] - p["row_from"] <= 1600 for p in pieces)


def test_forward_requests_hide_the_reference(spark):
    df = spark.createDataFrame([("S", "Q?", "MATCH (secret) RETURN 1")], "schema string, question string, query string")
    msgs = training.request_messages(df, "forward", "sys", [{"schema": "s", "question": "q", "query": "MATCH (e) RETURN e", "reasoning": "r"}]).first()["messages"]
    assert [m["role"] for m in msgs] == ["system", "user", "assistant", "user"]
    assert "secret" not in str(msgs[-1]) and "MATCH (e)" in msgs[2]["content"]


def test_a_hop_lost_once_of_two_is_lost_once(spark):
    df = spark.createDataFrame([("1", q("K"), q("K", "K"), "uses K.L"), ("2", q("K"), q("S", "K", "S"), "only K")], "id string, p string, r string, w string")
    got = sorted((r["id"], r["rel"], r["absent_from_plan"]) for r in structure.plan_vs_query(df, ["id"], "p", "r", "w").collect())
    assert got == [("1", "K", False), ("2", "S", True), ("2", "S", True)]


def test_union_at_a_line_end_is_no_single_hop(spark):
    df = spark.createDataFrame([("MATCH (a)-[:R]->(b) RETURN a\nUNION\nRETURN 1",), ("MATCH (a)-[:R]->(b) RETURN a",)], "r string")
    assert [r[0] for r in df.select(g.is_one_hop(F.col("r"))).collect()] == [False, True]


def test_loss_after_a_marker_of_two_words_and_full_sequence(spark):
    df = spark.createDataFrame([("a Cypher b Cypher output: c d",), ("no marker",)], "t string")
    rows = training.loss_spans(df, "t", "Cypher output:", 100).collect()
    assert [(r["loss_from"], r["n_loss"], r["masked"]) for r in rows] == [(5, 2, False), (2, 0, True)]
    rows = training.loss_spans(df, "t", "Cypher output:", 100, full_sequence=True).collect()
    assert [(r["loss_from"], r["n_loss"], r["masked"]) for r in rows] == [(0, 7, False), (0, 2, False)]
