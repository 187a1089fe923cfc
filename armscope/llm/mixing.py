"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  Raking scales the
cells' token weights in turn to the target share of every source, language and
topic until all three margins hold; a document is then drawn with the
probability that its cell's scaling asks for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.llm.common import Rounds, free_prefix, stored, words_of

#: Sweeps over all margins between two looks at the largest error of a margin, and the error at which raking ends.
SWEEPS, TOLERANCE = 4, 1e-9
#: Looks after which targets count as contradictory, and the seed of the draw.
MAX_LOOKS, SEED = 60, 42
#: Up to so many cells and targets one task does all sweeps; a larger table is raked by distributed rounds.
TASK_ROWS = 200_000
#: Targets are natural shares to this power, so large categories shrink towards small ones.
TEMPER = 0.9


def topic_of(text: Column) -> Column:
    """A topic by the look of a text, for tables that have none: list, shout, symbols, verse, prose or empty."""
    full = F.coalesce(text, F.lit(""))
    n = F.length(full)
    bars = n - F.length(F.replace(full, F.lit("|"), F.lit("")))
    loud = n - F.length(F.replace(full, F.lit("!"), F.lit("")))
    signs = n - F.length(F.translate(full, "#*$%&", ""))
    lines = n - F.length(F.replace(full, F.lit("\n"), F.lit("")))
    return (
        F.when(F.length(F.trim(full)) == 0, "empty")
        .when(bars * 25 > n, "list").when(loud * 25 > n, "shout").when(signs * 25 > n, "symbols")
        .when(lines * 150 > n, "verse").otherwise("prose")
    )


def tempered(cells: DataFrame, by: str, temper: float = TEMPER) -> DataFrame:
    """(by, target): the natural token share of every value to the power ``temper``, made to sum to 1."""
    natural = cells.groupBy(by).agg(F.sum("tokens").cast("double").alias("t"))
    powers = natural.select(by, F.pow("t", F.lit(temper)).alias("p"))
    total = powers.agg(F.sum("p")).first()[0] or 1.0
    return powers.select(by, (F.col("p") / F.lit(total)).alias("target"))


def _scaled(cells: DataFrame, by: str, targets: DataFrame) -> DataFrame:
    """Cells whose weights sum to the target share of every value of ``by``; without a target they stay 0."""
    margin = cells.groupBy(by).agg(F.sum("w").alias("_now"))
    factor = margin.join(targets, by, "left").select(
        by, F.when(F.col("_now") > 0, F.coalesce("target", F.lit(0.0)) / F.col("_now")).otherwise(0.0).alias("_f")
    )
    return cells.join(factor, by).withColumn("w", F.col("w") * F.col("_f")).drop("_f")


def _error(cells: DataFrame, targets: dict[str, DataFrame]) -> float:
    """How far the share of any value of any margin is from its target; a value without a target wants 0."""
    worst = None
    for by, target in targets.items():
        margin = cells.groupBy(by).agg(F.sum("w").alias("_now")).join(target, by, "full_outer")
        off = margin.agg(
            F.max(F.abs(F.coalesce("_now", F.lit(0.0)) - F.coalesce("target", F.lit(0.0)))).alias("e")
        )
        worst = off if worst is None else worst.union(off)
    return worst.agg(F.max("e")).first()[0] or 0.0


def _one_task(rows: DataFrame, by: list[str], total: float, sweeps: int, tolerance: float) -> DataFrame:
    """The cells of ``rows`` with ``w`` and ``_off``, the largest error of a margin; the same sweeps as in tables.

    ``rows`` holds the cells (``_by`` -1) and the targets of margin i (``_by`` i), a bounded table.
    """

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(parts), ignore_index=True)
        cells = every[every["_by"] < 0]
        w = cells["tokens"].to_numpy(dtype=float) / total
        margins = []
        for i, name in enumerate(by):
            goal = every[every["_by"] == i]
            codes, values = pd.factorize(pd.concat([cells[name], goal[name]]))
            target = np.zeros(len(values))
            target[codes[len(cells) :]] = goal["target"].to_numpy(dtype=float)
            margins.append((codes[: len(cells)], target))
        before, off = math.inf, 0.0
        for _ in range(MAX_LOOKS):
            for _ in range(sweeps):
                for codes, target in margins:
                    now = np.bincount(codes, weights=w, minlength=len(target))
                    w = w * np.divide(target, now, out=np.zeros_like(now), where=now > 0)[codes]
            off = max(np.abs(np.bincount(c, weights=w, minlength=len(t)) - t).max() for c, t in margins)
            if off <= tolerance or off > 0.99 * before:
                break
            before = off
        yield cells[[*by, "tokens"]].assign(w=w, _off=off)

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*by, "tokens"]) + ", w double, _off double"
    return rows.coalesce(1).mapInPandas(solve, schema)


def _in_tables(
    cells: DataFrame, targets: dict[str, DataFrame], total: float, sweeps: int, tolerance: float
) -> tuple[DataFrame, float]:
    """Cells with ``w`` and the largest error of a margin, by sums per value that join back to the cells."""
    rounds = Rounds(cells.sparkSession, "cells")
    now = cells.withColumn("w", F.col("tokens") / F.lit(total))
    before = math.inf
    for _ in range(MAX_LOOKS):
        for _ in range(sweeps):
            for by, target in targets.items():
                now = _scaled(now, by, target)
            now = rounds.put(now)
        off = _error(now, targets)
        if off <= tolerance or off > 0.99 * before:
            break
        before = off
    return now, off


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``cells`` (keys, tokens) plus ``w``, their raked share of tokens, and ``rate``.

    targets: for every key column a table (key, target) whose targets sum to 1; keys are not null.
    After every ``sweeps`` sweeps the largest error of a margin is looked at, until it is at most
    ``tolerance``.  Targets that contradict each other, or ask for values without tokens, raise a
    ValueError: the error then falls no more.  ``rate`` is w per token over its largest value, so it
    is at most 1 and the drawn tokens keep the raked mixture.  Cells without tokens have rate 1.
    Without any tokens all shares are 0, and nothing is raked.  Only sums come to the driver.

    Up to ``task_rows`` cells and targets, counted first, all sweeps run in one job and one task.
    Beyond, every step is a sum per value, combined on the map side and joined back, and every sweep
    a table in the shared folder.
    """
    by = list(targets)
    rows = cells.select(*by, "tokens", F.lit(-1).alias("_by"), F.lit(None).cast("double").alias("target"))
    for i, (name, target) in enumerate(targets.items()):
        rows = rows.unionByName(
            target.select(name, F.col("target").cast("double"), F.lit(i).alias("_by")), allowMissingColumns=True
        )
    n, total = rows.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    total, off = float(total or 0), 0.0
    if not total:
        now = cells.withColumn("w", F.lit(0.0))
    elif n <= task_rows:
        now = stored(_one_task(rows, by, total, sweeps, tolerance), "raked")
        off = now.select("_off").first()[0]
        now = now.drop("_off")
    else:
        now, off = _in_tables(cells, targets, total, sweeps, tolerance)
    if off > tolerance:
        raise ValueError(f"the targets contradict each other: a margin stays off by {off:.3g}")
    per_token = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens"))
    top = now.agg(F.max(per_token)).first()[0] or 1.0
    return now.withColumn("rate", F.coalesce(per_token / F.lit(top), F.lit(1.0)))


def draw(key: Column, seed: int = SEED) -> Column:
    """A fixed number in [0, 1) for a key and a seed, from md5, that other engines can repeat."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 12)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16**12))


def mixed(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text",
    topic: Column | None = None, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER,
    sweeps: int = SWEEPS, seed: int = SEED,
) -> DataFrame:
    """All rows of ``docs`` with topic, tokens, rate (probability of being drawn) and drawn.

    Tokens are words.  ``topic`` is a column expression, by default the look of
    the text; ``targets`` gives shares for "source", "lang" and "topic", by
    default the tempered natural ones.  A null source, language or topic is the
    value "unknown".  Texts without words weigh nothing and are drawn with the rate
    of their cell.  Rows that repeat a doc_id are drawn alike; a null doc_id is
    one key.  An empty table gives no rows.  Columns of ``docs`` named topic,
    tokens, rate or drawn are replaced.

    Cells are counted on the map side, so a source with a third of all rows is
    one row per task; the rates join back by cell, one row each.
    """
    topic = topic_of(F.col(text)) if topic is None else topic
    base = docs.withColumns({"topic": F.coalesce(topic, F.lit("unknown")), "tokens": F.size(words_of(F.col(text)))})
    x = free_prefix(base)
    keys = {
        "source": F.coalesce(F.col(source), F.lit("unknown")), "lang": F.coalesce(F.col(lang), F.lit("unknown")),
        "topic": F.col("topic"),
    }
    cells = base.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.sum("tokens").alias("tokens"))
    cells = stored(cells, "cells")
    goals = {by: stored(tempered(cells, by, temper), "goals") for by in keys if by not in (targets or {})} | (targets or {})
    rates = rake(cells, goals, sweeps).select(*[F.col(n).alias(f"{x}{n}") for n in keys], F.col("rate").alias(f"{x}rate"))
    marked = base.withColumns({f"{x}{n}": c for n, c in keys.items()}).join(rates, [f"{x}{n}" for n in keys], "left")
    return (
        marked.withColumn("rate", F.coalesce(F.col(f"{x}rate"), F.lit(0.0)))
        .withColumn("drawn", draw(F.col(doc_id), seed) < F.col("rate"))
        .select(*[c for c in docs.columns if c not in ("topic", "tokens", "rate", "drawn")], "topic", "tokens", "rate", "drawn")
    )
