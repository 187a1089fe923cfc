"""Joining arms, schemas and candidates; overlap between train and test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.functions.keys import text_key
from armscope.functions.text import norm_ws



def pair_arms(
    direct: DataFrame,
    cot: DataFrame,
    key: str,
    values: Sequence[str],
    strict: bool = False,
    shared: Sequence[str] = (),
) -> DataFrame:
    """One row per id with ``direct_<v>`` and ``cot_<v>``, and the ``shared`` columns.

    Shared columns (schema, question, reference) are equal in both arms, so
    they travel through the shuffle on the direct side only.
    ``strict`` fails the job at the first id that only one arm has, or that an arm
    has twice; otherwise only common ids are kept.  Ids are unique in each arm
    (see latest_per_id).
    """
    d = direct.select(key, *shared, *[F.col(v).alias(f"direct_{v}") for v in values])
    c = cot.select(key, *[F.col(v).alias(f"cot_{v}") for v in values])
    if not strict:
        return d.join(c, key)

    def counted(side: DataFrame, n: str) -> DataFrame:
        """One row per id with its count: the join below deals rows out by the same key."""
        return side.groupBy(key).agg(F.count("*").alias(n), *[F.first(x).alias(x) for x in side.columns if x != key])

    both = counted(d, "_d").join(counted(c, "_c"), key, "full_outer")
    complete = (F.coalesce("_d", F.lit(0)) == 1) & (F.coalesce("_c", F.lit(0)) == 1)
    checked = F.when(complete, F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit("join mismatch at id "), F.col(key).cast("string"))).cast(
            both.schema[key].dataType
        )
    )
    return both.withColumn(key, checked).drop("_d", "_c")


def arm_mismatches(
    rows: DataFrame, n_arms: int, key: str = "instance_id", arm_col: str = "arm"
) -> DataFrame:
    """Per arm: ids, and ids that some other arm lacks (all zero when matched)."""
    per_id = rows.groupBy(key).agg(F.collect_set(arm_col).alias("_arms"))
    return (
        per_id.select(F.explode("_arms").alias(arm_col), (F.size("_arms") < n_arms).alias("_short"))
        .groupBy(arm_col)
        .agg(
            F.count("*").alias("n_ids"),
            F.count(F.when(F.col("_short"), 1)).alias("n_unmatched"),
        )
    )


def target_mismatches(
    rows: DataFrame, key: str = "instance_id", arm_col: str = "arm", prompt: str = "user", target: str = "assistant"
) -> DataFrame:
    """One row: ids of both arms, those whose prompts differ, and those whose cot target does not end in the direct one.

    Matched training sets differ in nothing but the target, and there only in what
    stands before the query.  Prompts travel as digests.
    """
    direct, cot = F.col(arm_col) == "direct", F.col(arm_col) == "cot"
    per_id = rows.groupBy(key).agg(
        F.countDistinct(arm_col).alias("_arms"),
        F.countDistinct(text_key(F.col(prompt))).alias("_prompts"),
        F.max(F.when(direct, F.col(target))).alias("_d"), F.max(F.when(cot, F.col(target))).alias("_c"),
    ).filter(F.col("_arms") == 2)
    return per_id.agg(
        F.count("*").alias("n_ids"),
        F.count(F.when(F.col("_prompts") != 1, 1)).alias("n_other_prompt"),
        F.count(F.when(~F.endswith("_c", F.col("_d")), 1)).alias("n_other_query"),
    )


def attach_schema(examples: DataFrame, schemas: DataFrame, db_col: str, text_col: str) -> DataFrame:
    """Examples with their schema text; an unknown or empty schema drops the row.

    No hint: Spark broadcasts the schema side when its measured size is under
    the threshold, and otherwise sorts, splitting skewed databases.
    """
    known = schemas.filter(F.coalesce(F.col(text_col), F.lit("")) != "")
    return examples.join(known.select(db_col, text_col), db_col)


def collect_candidates(
    samples: DataFrame, id_col: str, idx_col: str, text_col: str, width: int | None = None
) -> DataFrame:
    """Candidates of an id as an array in sample order: a view for reading.

    Votes and clusters read the long table, so an id with very many samples
    is never gathered there.  ``width`` cuts the arrays: a row per so many sample
    numbers, numbered by ``part``.
    """
    part = F.floor(F.col(idx_col) / F.lit(width)).cast("bigint") if width else F.lit(0).cast("bigint")
    return (
        samples.withColumn("part", part).groupBy(id_col, "part")
        .agg(F.array_sort(F.collect_list(F.struct(idx_col, text_col))).alias("_c"))
        .select(id_col, "part", F.transform("_c", lambda x: x[text_col]).alias("candidates"))
    )


def question_key(c: Column) -> Column:
    return text_key(norm_ws(c))


def pair_key(question: Column, query: Column) -> Column:
    return text_key(F.concat_ws("\u0000", norm_ws(question), norm_ws(query)))


def _level_keys(rows: DataFrame, id_col: str, question_col: str, query_col: str) -> DataFrame:
    """One narrow row per input row and level: digests instead of texts."""
    levels = F.array(
        F.struct(F.lit("id").alias("level"), text_key(F.col(id_col).cast("string")).alias("key")),
        F.struct(F.lit("question").alias("level"), question_key(F.col(question_col)).alias("key")),
        F.struct(
            F.lit("pair").alias("level"),
            pair_key(F.col(question_col), F.col(query_col)).alias("key"),
        ),
    )
    return rows.select(F.explode(levels).alias("_l")).select("_l.level", "_l.key")


def leakage_audit(
    train: DataFrame, test: DataFrame, id_col: str, question_col: str, query_col: str
) -> DataFrame:
    """Share of test rows seen in train, by id, by question and by (question, query).

    One shuffle of (level, digest): copies collapse map-side, so a text that
    makes up a third of the rows is one row per task.
    """
    tagged = _level_keys(train, id_col, question_col, query_col).select(
        "level", "key", F.lit(1).alias("in_train"), F.lit(0).cast("bigint").alias("n_test")
    ).unionByName(
        _level_keys(test, id_col, question_col, query_col).select(
            "level", "key", F.lit(0).alias("in_train"), F.lit(1).cast("bigint").alias("n_test")
        )
    )
    per_key = tagged.groupBy("level", "key").agg(
        F.max("in_train").alias("in_train"), F.sum("n_test").alias("n_test")
    )
    n_seen = F.sum(F.col("in_train") * F.col("n_test"))
    return per_key.groupBy("level").agg(
        F.sum("n_test").alias("n_test"),
        n_seen.alias("n_seen"),
        (n_seen / F.sum("n_test")).alias("share_seen"),
    )


def seen_unseen_scores(
    train: DataFrame, paired: DataFrame, question_col: str = "question"
) -> DataFrame:
    """EM per arm on seen and unseen questions, and wins of one arm only.

    ``paired`` has the question and boolean ``direct_em`` and ``cot_em``.
    Scores are added up per question digest before they meet the train set.
    """
    d, c = F.col("direct_em").cast("bigint"), F.col("cot_em").cast("bigint")
    sums = ["n", "d", "c", "d_only", "c_only"]
    test = paired.select(
        question_key(F.col(question_col)).alias("key"),
        F.lit(0).alias("seen"),
        F.lit(1).cast("bigint").alias("n"),
        d.alias("d"), c.alias("c"),
        (d * (1 - c)).alias("d_only"), (c * (1 - d)).alias("c_only"),
    )
    zero = F.lit(0).cast("bigint")
    known = train.select(
        question_key(F.col(question_col)).alias("key"), F.lit(1).alias("seen"),
        *[zero.alias(s) for s in sums],
    )
    per_question = test.unionByName(known).groupBy("key").agg(
        F.max("seen").alias("seen"), *[F.sum(s).alias(s) for s in sums]
    )
    return (
        per_question.groupBy((F.col("seen") == 1).alias("seen"))
        .agg(*[F.sum(s).alias(s) for s in sums])
        .filter(F.col("n") > 0)
        .select(
            "seen", "n",
            (F.col("d") / F.col("n")).alias("direct_em"),
            (F.col("c") / F.col("n")).alias("cot_em"),
            F.col("d_only").alias("direct_only"),
            F.col("c_only").alias("cot_only"),
        )
    )


def cross_split_overlap(rows: DataFrame, key: Column, split_col: str) -> DataFrame:
    """Keys shared by every pair of splits (the diagonal counts its keys).

    The splits are read from the rows; a missing one is "unknown".  A key is
    reduced to the set of splits it occurs in, and keys to counts per set; pairs
    are formed from the few sets, never from rows.
    """
    split = F.coalesce(F.col(split_col).cast("string"), F.lit("unknown"))
    sets = (
        rows.groupBy(key.alias("_k")).agg(F.sort_array(F.collect_set(split)).alias("_in"))
        .groupBy("_in").agg(F.count("*").alias("n"))
    )
    a = sets.select("n", "_in", F.explode("_in").alias("split_a"))
    shared = a.select("n", "split_a", F.explode("_in").alias("split_b")).groupBy("split_a", "split_b").agg(
        F.sum("n").alias("n_shared")
    )
    sizes = shared.filter(F.col("split_a") == F.col("split_b")).select("split_a", F.col("n_shared").alias("n_a"))
    # All pairs of names, also those that share nothing: a list of names, not of rows.
    names = sizes.agg(F.sort_array(F.collect_list("split_a")).alias("_names")).scalar()
    grid = sizes.select("split_a", "n_a", F.explode(names).alias("split_b"))
    return grid.join(shared, ["split_a", "split_b"], "left").select(
        "split_a", "split_b", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), "n_a",
        (F.coalesce("n_shared", F.lit(0)) / F.col("n_a")).alias("share_of_a"),
    )


def decontaminate(
    train: DataFrame, test: DataFrame, level: str, id_col: str, question_col: str, query_col: str
) -> DataFrame:
    """Training rows that share no key with the test rows at the given level."""

    def key() -> Column:
        if level == "id":
            return text_key(F.col(id_col).cast("string"))
        if level == "question":
            return question_key(F.col(question_col))
        return pair_key(F.col(question_col), F.col(query_col))

    known = test.select(key().alias("_k")).distinct()
    return train.withColumn("_k", key()).join(known, "_k", "left_anti").drop("_k")


def common_instances(
    rows: DataFrame, n_arms: int, key: str = "instance_id", arm_col: str = "arm"
) -> DataFrame:
    """Rows of the ids that occur in all ``n_arms`` arms."""
    full = (
        rows.select(key, arm_col)
        .distinct()
        .groupBy(key)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") == n_arms)
        .select(key)
    )
    return rows.join(full, key, "left_semi")
