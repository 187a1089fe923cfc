"""Why predictions fail: relations, paths, literals and clauses of query text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.functions import graphtext as g
from armscope.functions.multiset import overlap_size
from armscope.functions.text import norm_ws_query
from armscope.operators.pairing import common_instances
from armscope.operators.scoring import rate

#: Ambiguity from here on is one bucket.
AMBIGUITY_CAP = 4


def schema_dictionary(
    rows: DataFrame, schema_col: str, patterns: str | Sequence[str] = g.SCHEMA_FORMS
) -> DataFrame:
    """(schema_key, declared): every different schema text once, with the distinct relations it declares.

    Texts collapse map-side before any of them is parsed, so the parsing follows the number of different
    schemas.  A relation may stand in any of the forms ``patterns``; a null schema has no row.
    """
    forms = (patterns,) if isinstance(patterns, str) else patterns
    texts = rows.select(F.col(schema_col).alias("_s")).filter(F.col("_s").isNotNull()).distinct()
    found = F.concat(*[g.declared(F.col("_s"), p) for p in forms])
    return texts.select(F.sha2("_s", 256).alias("schema_key"), F.array_distinct(found).alias("declared"))


def schema_relations(
    rows: DataFrame, schema_col: str, patterns: str | Sequence[str] = g.SCHEMA_FORMS
) -> DataFrame:
    """Relations of every different schema text: (schema_key, label_a, rel, label_b)."""
    return schema_dictionary(rows, schema_col, patterns).select("schema_key", F.inline("declared"))


def one_hop_rows(
    paired: DataFrame, id_col: str, ref_col: str, schema_col: str, arms: Sequence[str] = ("direct", "cot"),
    schemas: DataFrame | None = None,
) -> DataFrame:
    """One-hop references with their ambiguity, and per arm EM and correct relation.

    ``paired`` has ``<arm>_pred``.  ``schemas`` is a ``schema_dictionary`` that knows the rows' schemas, by
    default that of ``paired``; rows join it by digest, so their texts are hashed but not parsed or shuffled.
    """
    ref = F.col(ref_col)
    known_schemas = schema_dictionary(paired, schema_col) if schemas is None else schemas
    hops = (
        paired.filter(g.is_one_hop(ref))
        .withColumn("_labels", g.labels(ref))
        .withColumn("rel_type", F.try_element_at(g.relations(ref), F.lit(1)))
        .filter((F.size("_labels") >= 2) & F.col("rel_type").isNotNull())
        .withColumn("labels", F.array_sort(F.slice("_labels", 1, 2)))
        .withColumn("schema_key", F.sha2(F.col(schema_col), 256))
        .drop(schema_col)
        .join(known_schemas.withColumnRenamed("declared", "_decl"), "schema_key")
    )
    a, b = F.col("labels")[0], F.col("labels")[1]
    of_pair = F.filter("_decl", lambda x: (x["label_a"] == a) & (x["label_b"] == b))
    known = hops.withColumn("_rels", F.array_distinct(F.transform(of_pair, lambda x: x["rel"])))
    out = known.filter(F.array_contains("_rels", F.col("rel_type"))).withColumn(
        "ambiguity", F.size("_rels")
    )
    ref_n = norm_ws_query(ref)
    for arm in arms:
        pred = F.col(f"{arm}_pred")
        out = out.withColumn(f"{arm}_em", (norm_ws_query(pred) == ref_n).cast("int")).withColumn(
            f"{arm}_correct_rel", F.array_contains(g.relations(pred), F.col("rel_type")).cast("int")
        )
    keep = [f"{arm}_{m}" for arm in arms for m in ("em", "correct_rel")]
    keep += [c for c in (f"{arm}_exec" for arm in arms) if c in paired.columns]
    return out.select(id_col, "ambiguity", "rel_type", "labels", *keep)


def ambiguity_board(rows: DataFrame, metrics: Sequence[str] = ("em", "correct_rel")) -> DataFrame:
    """Rates per arm by ambiguity (AMBIGUITY_CAP and more is one bucket)."""
    bucket = F.least(F.col("ambiguity"), F.lit(AMBIGUITY_CAP)).alias("ambiguity")
    aggs = [F.count("*").alias("n")]
    for m in metrics:
        d, c = F.avg(F.col(f"direct_{m}").cast("double")), F.avg(F.col(f"cot_{m}").cast("double"))
        aggs += [d.alias(f"direct_{m}"), c.alias(f"cot_{m}"), (c - d).alias(f"delta_{m}")]
    return rows.groupBy(bucket).agg(*aggs)


def ambiguity_penalty(rows: DataFrame, metric: str = "correct_rel") -> DataFrame:
    """Per arm: rate at ambiguity 1, rate above, and their difference."""
    arms = rows.select(
        "ambiguity",
        F.explode(F.array(*[
            F.struct(F.lit(a).alias("arm"), F.col(f"{a}_{metric}").cast("double").alias("v"))
            for a in ("direct", "cot")
        ])).alias("_x"),
    ).select("ambiguity", "_x.*")
    one = F.avg(F.when(F.col("ambiguity") == 1, F.col("v")))
    more = F.avg(F.when(F.col("ambiguity") >= 2, F.col("v")))
    return arms.groupBy("arm").agg(
        one.alias("unambiguous"), more.alias("ambiguous"), (more - one).alias("penalty")
    )


def relations_used(rows: DataFrame, id_cols: Sequence[str], query_col: str) -> DataFrame:
    """One row per relation of every query, in order of use."""
    return rows.select(*id_cols, F.posexplode(g.relations(F.col(query_col))).alias("pos", "rel"))


def relation_counts(rows: DataFrame, group_cols: Sequence[str], query_col: str) -> DataFrame:
    """Queries that use each relation type."""
    return (
        rows.select(*group_cols, F.explode(F.array_distinct(g.relations(F.col(query_col)))).alias("rel"))
        .groupBy(*group_cols, "rel").agg(F.count("*").alias("n_queries"))
    )


def hop_board(preds: DataFrame, em: Column, pred_col: str, ref_col: str) -> DataFrame:
    """Per arm and hops of the reference: EM and mean hops missing from the prediction."""
    ref_hops = g.hop_count(F.col(ref_col))
    return (
        preds.select(
            "arm", ref_hops.alias("hops"), em.alias("_em"),
            (ref_hops - g.hop_count(F.col(pred_col))).alias("_deficit"),
        )
        .groupBy("arm", "hops")
        .agg(
            F.count("*").alias("n"), rate(F.col("_em")).alias("em"),
            F.avg(F.col("_deficit").cast("double")).alias("hop_deficit"),
        )
    )


def relation_change() -> Column:
    """How the predicted relation multiset relates to the reference's (see with_relations)."""
    n_p, n_r = F.size("pred_rels"), F.size("ref_rels")
    shared = overlap_size(F.col("pred_sorted"), F.col("ref_sorted"))
    return (
        F.when((n_p == n_r) & (shared == n_r), "same")
        .when((shared == n_p) & (n_p < n_r), "dropped")
        .when((shared == n_r) & (n_r < n_p), "added")
        .when(shared == 0, "disjoint")
        .otherwise("overlap")
    )


def with_relations(rows: DataFrame, pred_col: str, ref_col: str) -> DataFrame:
    """Add relation arrays in order of use (``pred_rels``, ``ref_rels``) and sorted."""
    used = rows.withColumn("pred_rels", g.relations(F.col(pred_col))).withColumn(
        "ref_rels", g.relations(F.col(ref_col))
    )
    return used.withColumn("pred_sorted", F.sort_array("pred_rels")).withColumn(
        "ref_sorted", F.sort_array("ref_rels")
    )


def failure_structure(failures: DataFrame, pred_col: str, ref_col: str) -> DataFrame:
    """Kinds of relation change among failures, with shares."""
    kinds = with_relations(failures, pred_col, ref_col).select(
        relation_change().alias("structure")
    )
    # One row with five counters, then unfolded: no second pass for the total.
    names = ["same", "dropped", "added", "disjoint", "overlap"]
    total = F.count("*")
    cells = [
        F.struct(
            F.lit(s).alias("structure"),
            F.count(F.when(F.col("structure") == s, 1)).alias("n"),
            rate(F.col("structure") == s).alias("share"),
        )
        for s in names
    ]
    return kinds.agg(total.alias("_n"), F.array(*cells).alias("_c")).select(F.inline("_c"))


def fragmentation(preds: DataFrame, group_cols: Sequence[str], pred_col: str, ref_col: str) -> DataFrame:
    """Share of predictions that split a one-MATCH reference over several MATCH clauses."""
    single = preds.filter(g.match_count(F.col(ref_col)) == 1)
    return (
        single.select(*group_cols, (g.match_count(F.col(pred_col)) >= 2).alias("_split"))
        .groupBy(*group_cols)
        .agg(F.count("*").alias("n"), rate(F.col("_split")).alias("fragmented_share"))
    )


def subpath_scan(pred_rels: Column, ref_rels: Column) -> Column:
    """Walk the reference relations with a pointer into the predicted ones.

    Gives ``taken`` (how many predicted relations were met in order) and
    ``missed`` (first 0-based reference position that was skipped, or -1).
    """
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("taken"), F.lit(-1).alias("missed"))

    def step(acc: Column, rel: Column) -> Column:
        hit = F.coalesce(F.get(pred_rels, acc["taken"]) == rel, F.lit(False))
        return F.struct(
            (acc["pos"] + 1).alias("pos"),
            (acc["taken"] + F.when(hit, 1).otherwise(0)).alias("taken"),
            F.when(hit | (acc["missed"] >= 0), acc["missed"]).otherwise(acc["pos"]).alias("missed"),
        )

    return F.aggregate(ref_rels, start, step)


def clean_subpath(rows: DataFrame, id_cols: Sequence[str], pred_col: str, ref_col: str) -> DataFrame:
    """Rows that dropped hops: is the rest in order, and where is the first missing hop?"""
    rels = with_relations(rows, pred_col, ref_col)
    dropped = rels.filter(relation_change() == "dropped")
    scanned = dropped.withColumn("_s", subpath_scan(F.col("pred_rels"), F.col("ref_rels")))
    first = F.col("_s.missed")
    where = (
        F.when(first == 0, "start")
        .when(first == F.size("ref_rels") - 1, "end")
        .otherwise("mid")
    )
    return scanned.select(
        *id_cols,
        (F.col("_s.taken") == F.size("pred_rels")).alias("clean"),
        where.alias("missing_at"),
        (F.size("ref_rels") - F.size("pred_rels")).alias("n_missing"),
    )


def subpath_board(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("arm", "missing_at").agg(
        F.count("*").alias("n"), rate(F.col("clean")).alias("clean_share")
    )


def plan_vs_query(
    rows: DataFrame, id_cols: Sequence[str], pred_col: str, ref_col: str, reasoning_col: str
) -> DataFrame:
    """Relations the query lost: were they missing from the reasoning already?

    A relation used twice and kept once is lost once: one row per lost use.
    """
    rels = with_relations(rows, pred_col, ref_col).withColumn("_said", g.words_in(F.col(reasoning_col)))
    kinds = rels.select(*id_cols, "ref_rels", "pred_rels", "_said", F.explode(F.array_distinct("ref_rels")).alias("rel"))

    def uses(c: str) -> Column:
        return F.size(F.filter(c, lambda x: x == F.col("rel")))

    missing = uses("ref_rels") - uses("pred_rels")
    lost = kinds.filter(missing > 0).select("*", F.explode(F.array_repeat(F.lit(1), missing)))
    return lost.select(*id_cols, "rel", (~F.array_contains("_said", F.col("rel"))).alias("absent_from_plan"))


def plan_board(lost: DataFrame) -> DataFrame:
    return lost.groupBy("arm").agg(
        F.count("*").alias("n_lost"), rate(F.col("absent_from_plan")).alias("planning_share")
    )


def literal_change(pred: Column, ref: Column) -> Column:
    """How the literals of ``pred`` relate to those of ``ref`` (arrays of distinct texts)."""
    lost, new = F.size(F.array_except(ref, pred)), F.size(F.array_except(pred, ref))
    return (
        F.when((lost == 0) & (new == 0), "same")
        .when(new == 0, "dropped")
        .when(lost == 0, "added")
        .otherwise("swapped")
    )


def filter_values(
    rows: DataFrame, id_cols: Sequence[str], pred_col: str, ref_col: str, reasoning_col: str
) -> DataFrame:
    """Change of quoted literals, and whether a wrong one stands in the reasoning."""
    lits = rows.withColumn("_p", g.literals(F.col(pred_col))).withColumn("_r", g.literals(F.col(ref_col)))
    wrong = F.array_except("_p", "_r")
    reasoning = F.coalesce(F.col(reasoning_col), F.lit(""))
    return lits.select(
        *id_cols,
        literal_change(F.col("_p"), F.col("_r")).alias("change"),
        F.exists(wrong, lambda v: (v != "") & reasoning.contains(v)).alias("wrong_in_reasoning"),
    )


def filter_value_board(values: DataFrame) -> DataFrame:
    return values.groupBy("arm", "change").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("wrong_in_reasoning"), 1)).alias("n_wrong_in_reasoning"),
    )


def error_attribution(failures: DataFrame, pred_col: str, ref_col: str, return_of) -> DataFrame:
    """Non-exclusive shares of failure attributes, per arm.

    ``return_of`` gives the RETURN part of a query column.
    """
    rels = with_relations(failures, pred_col, ref_col)
    p, r = F.col(pred_col), F.col(ref_col)
    flags = rels.select(
        "arm",
        (relation_change() == "dropped").alias("cut"),
        (literal_change(g.literals(p), g.literals(r)) != "same").alias("value"),
        (return_of(p) != return_of(r)).alias("ret"),
    )
    other = F.col("value") | F.col("ret")
    return flags.groupBy("arm").agg(
        F.count("*").alias("n"),
        rate(F.col("cut") & ~other).alias("truncation_alone"),
        rate(F.col("cut") & other).alias("truncation_with_others"),
        rate(F.col("value")).alias("wrong_value"),
        rate(F.col("ret")).alias("wrong_return"),
    )


def ladder_board(
    outcomes: DataFrame, arms: Sequence[str], base: str, ceiling: str, key: str = "instance_id"
) -> DataFrame:
    """Accuracy of k arms per split on common instances.

    For every arm: its delta to ``base`` and the share of the gap between
    ``base`` and ``ceiling`` it recovers.
    """
    common = common_instances(outcomes, len(arms), key)
    wide = common.groupBy("split").agg(
        F.count_distinct(key).alias("n"),
        *[F.avg(F.when(F.col("arm") == a, F.col("exec_match").cast("double"))).alias(a) for a in arms],
    )
    gap = F.col(ceiling) - F.col(base)
    rows = F.array(*[
        F.struct(
            F.lit(a).alias("arm"), F.col(a).alias("accuracy"),
            (F.col(a) - F.col(base)).alias("delta_to_base"),
            F.when(gap != 0, (F.col(a) - F.col(base)) / gap).alias("recovered_share"),
        )
        for a in arms
    ])
    return wide.select("split", "n", F.inline(rows))
