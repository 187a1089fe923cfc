import numpy as np
from pyspark.sql import functions as F

from armscope.functions.keys import dense_index, running_total
from armscope.operators import stats
from armscope.operators.resampling import pair_bootstrap, replicate_sums


def flags(spark, n11, n01, n10, n00):
    rows = [(True, True)] * n11 + [(False, True)] * n01 + [(True, False)] * n10 + [(False, False)] * n00
    return spark.createDataFrame(rows, "d boolean, c boolean")


def numpy_interval(d, c, reps=4000):
    rng = np.random.default_rng(0)
    idx = rng.integers(0, len(d), size=(reps, len(d)))
    return np.percentile(c[idx].mean(axis=1) - d[idx].mean(axis=1), [2.5, 97.5])


def test_both_methods_agree_with_numpy(spark):
    pairs = flags(spark, 120, 60, 100, 220).withColumn("id", F.monotonically_increasing_id())
    d = np.array([1] * 120 + [0] * 60 + [1] * 100 + [0] * 220)
    c = np.array([1] * 180 + [0] * 320)
    lo, hi = numpy_interval(d, c)
    for key in (None, "id"):
        row = stats.bootstrap_binary(pairs, "d", "c", 4000, key=key).first()
        assert abs(row["delta"] + 0.08) < 1e-12 and row["n"] == 500
        assert abs(row["lo"] - lo) < 0.006 and abs(row["hi"] - hi) < 0.006


def test_draws_are_even_and_independent(spark):
    """Every block is drawn about equally often, and two places of a replicate agree as often as chance has it."""
    rows = spark.range(400).selectExpr("id AS b", "explode(sequence(0, 1023)) AS j").select(
        "b", "j", stats.drawn_block(F.col("b"), F.col("j")).alias("k")
    ).toPandas()
    counts = np.bincount(rows["k"], minlength=stats.BLOCKS)
    assert abs(counts.std() / 20 - 1) < 0.1 and counts.min() > 300
    table = rows.pivot(index="b", columns="j", values="k").to_numpy()
    assert abs((table[:, 1:] == table[:, :-1]).mean() * stats.BLOCKS - 1) < 0.15
    assert abs((table[1:] == table[:-1]).mean() * stats.BLOCKS - 1) < 0.15


def test_same_seed_same_interval(spark):
    pairs = flags(spark, 10, 5, 9, 20)
    one, two = (stats.bootstrap_binary(pairs.repartition(k), "d", "c", 300).first() for k in (1, 7))
    assert one == two


def ratio_pairs(spark, n=400):
    rng = np.random.default_rng(5)
    rows = [
        (str(i), int(rng.integers(0, 20)), 20 + int(rng.integers(0, 9)), int(rng.integers(0, 18)), 20 + int(rng.integers(0, 9)))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "id string, m_d long, a_d long, m_c long, a_c long")


def test_ratio_methods_agree_with_numpy(spark):
    rows, df = ratio_pairs(spark)
    x = np.array([r[1:] for r in rows], dtype=float)
    idx = np.random.default_rng(0).integers(0, len(x), size=(3000, len(x)))
    s = x[idx].sum(axis=1)
    lo, hi = np.percentile(s[:, 2] / s[:, 3] - s[:, 0] / s[:, 1], [2.5, 97.5])
    t = x.sum(axis=0)
    row = stats.bootstrap_ratio(df, "id", replicates=3000).first()
    assert abs(row["delta"] - (t[2] / t[3] - t[0] / t[1])) < 1e-12 and row["n"] == 400
    assert abs(row["lo"] - lo) < 0.004 and abs(row["hi"] - hi) < 0.004


def test_numpy_draws_are_the_column_draws(spark):
    rows = spark.createDataFrame([(b, j) for b in (0, 7, 9_999) for j in range(1024)], "b long, j long")
    want = [r[0] for r in rows.coalesce(1).select(stats.drawn_block(F.col("b"), F.col("j"))).collect()]
    assert stats.drawn_blocks(np.array([0, 7, 9_999])).ravel().tolist() == want


def test_board_of_many_is_each_alone(spark):
    """One draw for all gives the figures of single intervals; null flags and missing subsets do not count."""
    _, df = ratio_pairs(spark)
    pairs = df.withColumn("d", F.col("m_d") > 9).withColumn("c", F.when(F.col("m_c") != 3, F.col("m_c") > 9))
    even = F.col("id").cast("int") % 2 == 0
    flag = lambda name: stats.flag_entry(name, F.col("d"), F.col("c"))
    rows = stats.compared(
        pairs, "id", flag("all"), F.when(even, flag("even")), F.when(F.col("id") == "x", flag("none")),
        stats.ratio_entry("ratio", *[F.col(x) for x in ("m_d", "a_d", "m_c", "a_c")]),
    )
    got = {r["comparison"]: tuple(r)[1:5] for r in stats.ci_board(rows, 700).collect()}
    alone = {
        "all": stats.bootstrap_binary(pairs, "d", "c", 700, key="id"),
        "even": stats.bootstrap_binary(pairs.filter(even), "d", "c", 700, key="id"),
        "ratio": stats.bootstrap_ratio(pairs, "id", replicates=700),
    }
    assert got == {name: tuple(df.first()) for name, df in alone.items()}
    assert got["all"][3] == pairs.filter("c IS NOT NULL").count() and got["ratio"][3] == 400


def test_empty_pairs_give_nulls(spark):
    empty = spark.createDataFrame([], "id string, d boolean, c boolean")
    assert tuple(stats.bootstrap_binary(empty, "d", "c", 100, key="id").first()) == (None,) * 4


def test_dense_index_and_running_total(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("v"))
    idx = sorted(r["i"] for r in dense_index(df, "k", "i").collect())
    assert idx == list(range(5000))
    rows = running_total(df, "k", "v", "before").orderBy("before").collect()
    total = 0
    for r in sorted(rows, key=lambda r: (r["before"], r["v"])):
        assert r["before"] == total
        total += r["v"]


def test_prefix_sums_do_not_depend_on_the_ranges(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 5).alias("v"))
    found = [
        sorted((r["k"], r["before"]) for r in running_total(df, "k", "v", "before", rows).collect())
        for rows in (10_000, 700, 9)
    ]
    assert found[0] == found[1] == found[2]
    assert running_total(df.filter("false"), "k", "v", "before").count() == 0


def test_a_hot_amount_and_large_keys_stay_in_even_ranges(spark):
    """One row holds nearly all of the amount: offsets behind it are right, and no range holds it with all others."""
    df = spark.range(1000).select(F.concat(F.lit("x" * 50), "id").alias("k"), F.when(F.col("id") == 3, 10**12).otherwise(1).alias("v"))
    rows = sorted((r["before"], r["v"]) for r in running_total(df, "k", "v", "before", 50).collect())
    total = 0
    for before, v in rows:
        assert before == total
        total += v


def test_pair_bootstrap_agrees_with_numpy_and_with_blocks(spark):
    rows, df = ratio_pairs(spark, 600)
    x = np.array([r[1:] for r in rows], dtype=float)
    idx = np.random.default_rng(0).integers(0, len(x), size=(4000, len(x)))
    t, s = x.sum(axis=0), x[idx].sum(axis=1)
    lo, hi = np.percentile(s[:, 2] / s[:, 3] - s[:, 0] / s[:, 1], [2.5, 97.5])
    blocks = stats.bootstrap_ratio(df, "id", replicates=4000).first()
    for leaf_kinds in (4096, 40):  # one leaf, and a tree of some 16 leaves
        row = pair_bootstrap(df, replicates=4000, leaf_kinds=leaf_kinds).first()
        assert abs(row["delta"] - (t[2] / t[3] - t[0] / t[1])) < 1e-12 and row["n"] == 600
        assert abs(row["lo"] - lo) < 0.003 and abs(row["hi"] - hi) < 0.003
        assert abs(row["lo"] - blocks["lo"]) < 0.004 and abs(row["hi"] - blocks["hi"]) < 0.004


def test_every_replicate_draws_as_many_pairs_as_there_are(spark):
    """However the tree splits the draws, none is lost or made twice, and the result repeats."""
    kinds = spark.range(3000).selectExpr("id AS m_d", "1L AS a_d", "id % 7 AS m_c", "2L AS a_c", "1 + id % 3 AS w")
    n = kinds.agg(F.sum("w")).first()[0]
    for leaf_kinds in (4096, 1000, 100):
        rows = replicate_sums(kinds, 600, 42, leaf_kinds).orderBy("b").collect()
        assert [r["b"] for r in rows] == list(range(600))
        assert all(r["a_d"] == n and r["a_c"] == 2 * n for r in rows)
        assert len({r["m_d"] for r in rows}) > 590
    assert replicate_sums(kinds.repartition(7), 600, 42, 100).orderBy("b").collect() == rows


def test_pair_bootstrap_edges(spark):
    schema = "m_d long, a_d long, m_c long, a_c long"
    none = pair_bootstrap(spark.createDataFrame([], schema), replicates=50).first()
    assert tuple(none) == (None, None, None, 0)
    hot = spark.createDataFrame([(1, 2, 1, 2)] * 500 + [(None, 1, 1, None)], schema)
    row = pair_bootstrap(hot, replicates=200, leaf_kinds=1).first()
    assert row["n"] == 501 and abs(row["delta"] - (501 / 1000 - 500 / 1001)) < 1e-12


def test_flag_text(spark):
    df = spark.createDataFrame([("True",), ("False",), ("true",), (None,)], "v string")
    assert [r[0] for r in df.select(F.coalesce(stats.as_flag(F.col("v")), F.lit(False))).collect()] == [True, False, True, False]


def test_published_deltas_follow_from_counts():
    assert round((631 - 735) / 2471, 5) == -0.04209
    assert round((289 - 551) / 1253, 4) == -0.2091


def test_check_reported(spark):
    board = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "arm string, em double")
    want = spark.createDataFrame([("a", 0.5009), ("b", 0.502), ("c", 0.1)], "arm string, em double")
    got = {r["arm"]: r["ok"] for r in stats.check_reported(board, want, "arm", "em").collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_correlation_without_variance_is_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 1)], "x int, d int")
    assert stats.correlation_board(df, "x", F.col("d")).first()["pearson"] == 0.0
