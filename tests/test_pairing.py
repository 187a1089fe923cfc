import pytest
from pyspark.sql import functions as F

from armscope.operators import pairing


def arm(spark, rows):
    return spark.createDataFrame(rows, "id string, em boolean")


def test_strict_fails_and_inner_keeps_common(spark):
    d, c = arm(spark, [("1", True), ("2", False)]), arm(spark, [("1", False), ("3", True)])
    assert pairing.pair_arms(d, c, "id", ["em"]).count() == 1
    with pytest.raises(Exception, match="join mismatch at id"):
        pairing.pair_arms(d, c, "id", ["em"], strict=True).collect()
    same = arm(spark, [("1", True), ("2", False)])
    assert pairing.pair_arms(d, same, "id", ["em"], strict=True).count() == 2


def test_leakage_levels(spark):
    cols = "id string, question string, query string"
    train = spark.createDataFrame([("1", "a  b", "q1"), ("2", "c", "q2")], cols)
    test = spark.createDataFrame([("1", "x", "q"), ("7", "a b", "other"), ("8", "c ", " q2"), ("9", "new", "q")], cols)
    got = {r["level"]: r["n_seen"] for r in pairing.leakage_audit(train, test, "id", "question", "query").collect()}
    assert got == {"id": 1, "question": 2, "pair": 1}


def test_decontaminate(spark):
    cols = "id string, question string, query string"
    train = spark.createDataFrame([("1", "a  b", "q1"), ("2", "c", "q2")], cols)
    test = spark.createDataFrame([("7", "a b", "other"), ("2", "z", "q")], cols)
    left = {
        level: sorted(r["id"] for r in pairing.decontaminate(train, test, level, "id", "question", "query").collect())
        for level in ("id", "question", "pair")
    }
    assert left == {"id": ["1"], "question": ["2"], "pair": ["1", "2"]}


def test_overlap_matrix(spark):
    df = spark.createDataFrame([("a", "s"), ("b", "s"), ("b", "t"), ("b", "t"), ("c", "u")], "k string, sp string")
    got = {(r["split_a"], r["split_b"]): r["n_shared"] for r in pairing.cross_split_overlap(df, F.col("k"), "sp").collect()}
    assert got[("s", "s")] == 2 and got[("t", "t")] == 1 and got[("s", "t")] == got[("t", "s")] == 1 and got[("s", "u")] == 0
    assert len(got) == 9


def test_candidates_in_sample_order(spark):
    df = spark.range(2051).select(F.lit("1").alias("id"), F.col("id").alias("idx"), F.col("id").cast("string").alias("t"))
    whole = pairing.collect_candidates(df.orderBy(F.desc("idx")), "id", "idx", "t").collect()
    assert [r["candidates"] for r in whole] == [[str(i) for i in range(2051)]]
    parts = pairing.collect_candidates(df, "id", "idx", "t", width=1000).orderBy("part").collect()
    assert [len(r["candidates"]) for r in parts] == [1000, 1000, 51]


def test_a_further_split_and_a_missing_one_count(spark):
    df = spark.createDataFrame([(str(i % 3), f"s{i}" if i else None) for i in range(70)], "k string, sp string")
    got = pairing.cross_split_overlap(df, F.col("k"), "sp").collect()
    assert len(got) == 70 * 70 and {r["split_a"] for r in got} >= {"unknown", "s69"}


def test_seen_unseen(spark):
    train = spark.createDataFrame([("q1",), ("q1",)], "question string")
    paired = spark.createDataFrame([("q1", True, False), ("q2", True, True), ("q2", False, True)], "question string, direct_em boolean, cot_em boolean")
    got = {r["seen"]: (r["n"], r["direct_em"], r["cot_em"], r["direct_only"], r["cot_only"]) for r in pairing.seen_unseen_scores(train, paired).collect()}
    assert got == {True: (1, 1.0, 0.0, 1, 0), False: (2, 0.5, 1.0, 0, 1)}


def test_strict_pairing_fails_for_an_id_that_an_arm_has_twice(spark):
    import pytest

    one = spark.createDataFrame([("1", 1), ("2", 1)], "id string, v int")
    assert pairing.pair_arms(one, one, "id", ["v"], strict=True).count() == 2
    with pytest.raises(Exception, match="join mismatch at id 2"):
        pairing.pair_arms(one, one.union(one.filter("id = 2")), "id", ["v"], strict=True).collect()


def test_matched_targets(spark):
    rows = [("1", "direct", "u", "q"), ("1", "cot", "u", "because q"), ("2", "direct", "u", "q"), ("2", "cot", "v", "because r"), ("3", "cot", "u", "q")]
    df = spark.createDataFrame(rows, "instance_id string, arm string, user string, assistant string")
    assert tuple(pairing.target_mismatches(df).first()) == (2, 1, 1)
