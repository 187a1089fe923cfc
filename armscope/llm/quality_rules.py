"""Quality rules as weak supervision: rules vote or abstain, EM weighs them.

Every rule says good, bad or nothing about a text.  How often it says so of good
and of bad texts is not known; expectation-maximisation estimates it from the
votes of the whole corpus, and the posterior probability of a good text takes
the place of "passes every rule".
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.llm.common import BLANK_CHARS, free_prefix, stored, words_of

#: Words of a window that counts as repeated.
WINDOW = 5
SYMBOLS = "#*$%&|<>"
FEATURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_bars", "n_runs",
    "n_stops", "n_loud", "n_odd", "n_common",
]

#: Frequent function words of the corpus languages; running text is full of them.
COMMON = (
    "the of and to a in is it that for be this with on as was by are "
    "de la le les des du et en un une que qui est pour dans sur "
    "der die das den und zu von ist mit im für auf ein eine sich "
    "el los las y del se por con para al"
).split()


def with_features(docs: DataFrame, text: str = "text", out: str = "_f") -> DataFrame:
    """``docs`` plus one struct column ``out`` of bigint counts; null texts count as empty.

    n_words; word_chars (code points in words); n_symbols; n_lines and
    n_dup_lines (lines with a word; those equal to an earlier line);
    n_repeat_words (words inside 5-word windows that occur twice or more in the
    text, the first included); n_caps (words of capitals); n_bars (words that
    are one bar); n_runs (words equal to the word before); n_stops (words that
    end a sentence); n_loud (words that end in "!!"); n_odd (words with a symbol or an
    exclamation mark); n_common (frequent function words).

    Windows are held as 64-bit digests inside their own row.  Each step is a
    column of its own, so no lambda computes an array again for every item.
    """
    x = free_prefix(docs)
    keep = [F.col(c) for c in docs.columns]
    step = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(f"{x}t"))
    t = F.col(f"{x}t")
    bare = F.translate(t, BLANK_CHARS, "")
    step = step.select(
        *keep, words_of(t).alias(f"{x}w"),
        F.filter(F.split(t, "\n"), lambda s: F.translate(s, BLANK_CHARS, "") != "").alias(f"{x}l"),
        F.length(bare).alias(f"{x}word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias(f"{x}n_symbols"),
    )
    w, l = F.col(f"{x}w"), F.col(f"{x}l")

    def shouted(s: Column) -> Column:
        return (F.length(s) > 1) & (F.upper(s) == s) & (F.lower(s) != s)

    step = step.select(
        *keep, f"{x}word_chars", f"{x}n_symbols",
        F.size(l).alias(f"{x}n_lines"),
        (F.size(l) - F.size(F.array_distinct(l))).alias(f"{x}n_dup_lines"),
        F.transform(w, lambda s: F.xxhash64(s)).alias(f"{x}h"),
        F.size(F.filter(w, shouted)).alias(f"{x}n_caps"),
        F.size(F.filter(w, lambda s: s == "|")).alias(f"{x}n_bars"),
        F.size(F.filter(w, lambda s: F.endswith(s, F.lit(".")) | F.endswith(s, F.lit("!")) | F.endswith(s, F.lit("?")))).alias(f"{x}n_stops"),
        F.size(F.filter(w, lambda s: F.endswith(s, F.lit("!!")))).alias(f"{x}n_loud"),
        F.size(F.filter(w, lambda s: F.length(F.translate(s, SYMBOLS + "!", "")) < F.length(s))).alias(f"{x}n_odd"),
        F.size(F.filter(w, lambda s: F.lower(s).isin(COMMON))).alias(f"{x}n_common"),
    )
    h, none = F.col(f"{x}h"), F.array().cast("array<int>")
    known = [f"{x}{n}" for n in FEATURES if n not in ("n_words", "n_runs", "n_repeat_words")]
    starts = F.when(F.size(h) >= WINDOW, F.sequence(F.lit(0), F.size(h) - WINDOW)).otherwise(none)
    step = step.select(
        *keep, *known, F.size(h).alias(f"{x}n_words"),
        F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])).alias(f"{x}g"),
        F.size(F.filter(h, lambda v, i: (i > 0) & (v == F.get(h, i - 1)))).alias(f"{x}n_runs"),
    )
    g = F.col(f"{x}g")
    known += [f"{x}n_words", f"{x}n_runs"]
    placed = F.sort_array(F.transform(g, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
    step = step.select(
        *keep, *known,
        F.when(F.size(F.array_distinct(g)) < F.size(g), placed)
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias(f"{x}s"),
    )
    s = F.col(f"{x}s")

    def twice(v: Column, k: Column) -> Column:
        """Equal windows are neighbours once sorted."""
        after = F.coalesce(v["h"] == F.get(s, k + 1)["h"], F.lit(False))
        return after | ((k > 0) & (v["h"] == F.get(s, k - 1)["h"]))

    step = step.select(*keep, *known, F.sort_array(F.transform(F.filter(s, twice), lambda v: v["i"])).alias(f"{x}p"))
    p = F.col(f"{x}p")
    fresh = F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW))))
    step = step.withColumn(f"{x}n_repeat_words", F.aggregate(fresh, F.lit(0), lambda a, v: a + v))
    counts = F.struct(*[F.col(f"{x}{n}").cast("bigint").alias(n) for n in FEATURES])
    return step.select(*keep, counts.alias(out))


Condition = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """Conditions over the struct of features; a text that meets neither gets no vote."""

    name: str
    bad: Condition
    good: Condition


def _share(feature: str, f: Column) -> Column:
    return f[feature] / F.greatest(f["n_words"], F.lit(1))


def _low(name: str, feature: str, good: float, bad: float, per: str = "n_words") -> Rule:
    """Good up to one share, bad above another, nothing between."""

    def share(f: Column) -> Column:
        return f[feature] / F.greatest(f[per], F.lit(1))

    return Rule(name, lambda f: share(f) > bad, lambda f: share(f) <= good)


#: Several rules look at the same fault from different sides: EM learns from what they agree on.
RULES = (
    _low("symbols", "n_symbols", 0.02, 0.08, "word_chars"),
    _low("odd_words", "n_odd", 0.05, 0.2),
    Rule(
        "common_words", lambda f: _share("n_common", f) < 0.02, lambda f: _share("n_common", f) >= 0.06,
    ),
    _low("lines", "n_dup_lines", 0.0, 0.3, "n_lines"),
    _low("repeats", "n_repeat_words", 0.02, 0.2),
    _low("runs", "n_runs", 0.05, 0.2),
    _low("capitals", "n_caps", 0.05, 0.3),
    _low("loud", "n_loud", 0.02, 0.2),
    _low("bars", "n_bars", 0.01, 0.1),
    Rule(
        "sentences", lambda f: (_share("n_stops", f) < 0.005) & (f["n_words"] >= 100),
        lambda f: _share("n_stops", f).between(0.02, 0.3),
    ),
    Rule(
        "word_length", lambda f: ~(f["word_chars"] / F.greatest(f["n_words"], F.lit(1))).between(2.0, 15.0),
        lambda f: (f["word_chars"] / F.greatest(f["n_words"], F.lit(1))).between(3.0, 10.0),
    ),
)

#: Votes; they index the shares of a LabelModel.
BAD, GOOD, NONE = 0, 1, 2


def votes(features: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One vote per rule, as an array, from a struct of features."""
    return F.array(*[F.when(r.bad(features), BAD).when(r.good(features), GOOD).otherwise(NONE) for r in rules])


@dataclass
class LabelModel:
    """Share of good texts, and how often each rule that votes says bad of bad and of good texts."""

    prior: float = 0.85
    says_bad: dict[str, tuple[float, float]] = field(default_factory=dict)

    def log_odds(self, rule: str, vote: int) -> float:
        """What a vote adds to the log odds of a good text; no vote adds nothing."""
        bad, good = self.says_bad[rule]
        return math.log(good / bad) if vote == BAD else math.log((1 - good) / (1 - bad)) if vote == GOOD else 0.0

    def score(self, said: Column, rules: tuple[Rule, ...] = RULES) -> Column:
        """Posterior probability of a good text, from its votes."""
        table = F.array(*[F.lit(self.log_odds(r.name, v)) for r in rules for v in (BAD, GOOD, NONE)])
        start = F.lit(math.log(self.prior / (1 - self.prior)))
        odds = F.transform(said, lambda v, k: F.get(table, v + 3 * k))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(start + F.aggregate(odds, F.lit(0.0), lambda a, x: a + x))))


#: What EM starts from: a rule says bad of half of the bad texts and of hardly any good one.
START_BAD, START_GOOD, START_PRIOR = 0.5, 0.01, 0.85
#: Imagined texts of either class that the start weighs in every step; keeps tiny tables near the start.
WEIGHT = 10.0
STEPS = 25


def fit(patterns: DataFrame, rules: tuple[Rule, ...] = RULES, steps: int = STEPS, weight: float = WEIGHT) -> LabelModel:
    """EM over a table of vote patterns: the array ``votes`` and its count ``n``.

    There are at most 3**rules patterns whatever the corpus, and every step is one
    aggregate of them to a row per rule and vote.  With no rows the model stays
    as it starts.  Ends early once no share moves by 1e-7.
    """
    model = LabelModel(START_PRIOR, {r.name: (START_BAD, START_GOOD) for r in rules})
    for _ in range(steps):
        good = F.col("n") * model.score(F.col("votes"), rules)
        rows = (
            patterns.select(good.alias("good"), (F.col("n") - good).alias("bad"), F.posexplode("votes").alias("rule", "vote"))
            .groupBy("rule", "vote").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
        )
        sums = {(r["rule"], r["vote"]): (r["bad"], r["good"]) for r in rows}
        none = (0.0, 0.0)
        bad, good = (math.fsum(sums.get((0, v), none)[side] for v in (BAD, GOOD, NONE)) for side in (0, 1))
        says_bad = {}
        for k, r in enumerate(rules):
            yes, no = sums.get((k, BAD), none), sums.get((k, GOOD), none)
            says_bad[r.name] = tuple(
                (yes[side] + weight * start) / (yes[side] + no[side] + weight)
                for side, start in enumerate((START_BAD, START_GOOD))
            )
        moved = max(abs(a - b) for r in rules for a, b in zip(says_bad[r.name], model.says_bad[r.name]))
        model = LabelModel((good + START_PRIOR * weight) / (good + bad + weight), says_bad)
        if moved < 1e-6:
            break
    return model


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


def judged(
    docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (by default all) plus _f, votes, base_failed, posterior and kept.

    A row is kept if it is not base_failed and its posterior reaches
    ``threshold``.  Null, empty and blank texts have no words and are
    base_failed.  Repeated rows count and are judged alike; an empty table gives no
    rows.  Columns of ``docs`` with one of the added names are replaced.

    The counts are written once beside the kept columns: the fit and the verdict
    read them there, and a filter on the verdict is not pushed into the counting.
    """
    added = {"_f", "votes", "base_failed", "posterior", "kept"}
    base = docs.select(*[c for c in docs.columns if c.lower() not in added])
    kept = [c for c in (base.columns if keep is None else keep) if c.lower() not in added]
    counted = stored(with_features(base, text).select(*kept, "_f"), "features")
    voted = counted.withColumn("votes", votes(F.col("_f"), rules))
    patterns = stored(voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    model = fit(patterns, rules)
    return (
        voted.withColumn("posterior", model.score(F.col("votes"), rules))
        .withColumn("base_failed", base_failed(F.col("_f")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )
