"""Quality from compression: which of two dictionaries shortens a text more.

One zstandard dictionary is built from good labelled texts, one from bad ones.
A text is compressed in blocks with either; the difference of the two
sizes over their sum says which class it resembles, and a logistic curve,
fitted to labelled texts that no dictionary saw, turns it into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.llm.common import stored

#: Code points of a block.  A block sees the dictionary only, so a long text weighs like its parts.
BLOCK = 1024
#: The bound of the labelled sample: about so many labelled rows per class are read, three quarters of them
#: for the dictionaries and the rest for the curve.  As many blocks at most come to the driver.
SAMPLE_ROWS = 8000
DICTIONARY_BYTES = 112_640
#: Share of good texts that scores are calibrated to.
PRIOR = 0.7
LEVEL = 3
#: Steps of the difference at which the curve's table of counts is kept: -1 to 1 in so many parts.
BINS = 4000


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float = 0.0
    shift: float = 0.0
    level: int = LEVEL
    block: int = BLOCK

    def score(self, difference: Column) -> Column:
        z = F.lit(self.slope) * difference + F.lit(self.shift)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes, level: int) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    made = []
    for raw in (good, bad):
        known = zstandard.ZstdCompressionDict(raw) if raw else None
        if known is not None:
            known.precompute_compress(level=level)
        made.append(
            zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        )
    return made[0], made[1]


def _difference(text: str, good, bad, block: int) -> float:
    """(size by the bad dictionary - size by the good one) / their sum, over all blocks of a text."""
    a = b = 0
    for i in range(0, len(text), block):
        part = text[i : i + block].encode("utf-8", "replace")
        a += len(good.compress(part))
        b += len(bad.compress(part))
    return (b - a) / (a + b) if a + b else 0.0


def difference(text: Column, model: CompressionModel) -> Column:
    """The normalised difference of a text column, above 0 for good; null and empty texts give 0."""

    @F.pandas_udf("double")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        good, bad = _compressors(model.good, model.bad, model.level)
        for texts in batches:
            yield pd.Series([_difference(t or "", good, bad, model.block) for t in texts], dtype="float64")

    return sizes(text)


def sampled_labels(labels: DataFrame, key: str, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, label, part) of about ``rows`` labels per class, chosen by digest.

    Parts 0 to 2 feed the dictionaries, part 3 the curve.  Other labels than 0 and 1 are left out.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(1.0, rows / counts.get(y, 1)) for y in (0, 1)}
    digest = F.xxhash64(F.col("key").cast("string"))
    place = F.pmod(digest, F.lit(1_000_003)) / F.lit(1_000_003.0)
    wanted = F.when(F.col("label") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    part = F.shiftrightunsigned(digest, 40).bitwiseAND(F.lit(3)).cast("int")
    return known.filter(place < wanted).select("key", "label", part.alias("part"))


def _blocks(rows: DataFrame, label: int, block: int, most: int) -> list[bytes]:
    """Blocks of the rows of one class, chosen by digest: one of every row, up to eight where rows are few."""
    chosen = rows.filter((F.col("label") == label) & (F.length("text") > 0))
    each = max(1, min(8, most // max(1, chosen.count())))
    n = F.ceil(F.length("text") / block)
    picks = F.array_distinct(F.array(*[F.pmod(F.xxhash64("text", F.lit(i)), n) for i in range(each)]))
    parts = chosen.select("text", F.explode(picks).alias("i")).select(
        F.substring("text", (F.col("i") * block + 1).cast("int"), F.lit(block)).alias("part")
    )
    return [r["part"].encode("utf-8", "replace") for r in parts.distinct().orderBy("part").collect()]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; few or small samples are used as they are."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _curve(counts: list[tuple[float, int, int]], steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (difference, label, n), by Newton steps with a small ridge."""
    slope, shift = 0.0, 0.0
    for _ in range(steps):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y, n in counts:
            p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, slope * x + shift))))
            r, w = n * (y - p), n * p * (1 - p)
            g0, g1, h00, h01, h11 = g0 + r, g1 + r * x, h00 + w, h01 + w * x, h11 + w * x * x
        g0, g1 = g0 - 1e-3 * shift, g1 - 1e-5 * slope
        h00, h11 = h00 + 1e-3, h11 + 1e-5
        det = h00 * h11 - h01 * h01
        if det <= 0:
            break
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        scale = min(1.0, 10.0 / max(abs(d0), 1e-12), 200.0 / max(abs(d1), 1e-12))
        shift, slope = shift + scale * d0, slope + scale * d1
        if abs(d0) < 1e-9 and abs(d1) < 1e-9:
            break
    return slope, shift


def fit(
    rows: DataFrame, most: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES, block: int = BLOCK,
    level: int = LEVEL, prior: float = PRIOR,
) -> CompressionModel:
    """A model from (text, label, part) rows.

    Blocks of parts 0 to 2 come to the driver, about ``most`` of a class.  Part 3 is
    scored on the executors and fits the curve through a table of counts of fixed size, weighed
    to a share ``prior`` of good texts, since labels are not drawn like the texts.  Null and empty texts feed
    no dictionary.  With no rows of a class its dictionary is empty; with no
    rows at all every score is 0.5.
    """
    good, bad = (_dictionary(_blocks(rows.filter("part < 3"), y, block, most), size) for y in (1, 0))
    model = CompressionModel(good, bad, level=level, block=block)
    x = F.round(difference(F.col("text"), model) * (BINS // 2)) / (BINS // 2)
    counts = rows.filter("part = 3").select(x.alias("x"), "label").groupBy("x", "label").agg(F.count(F.lit(1)).alias("n"))
    table = [(r["x"], r["label"], r["n"]) for r in counts.collect()]
    total = {y: sum(n for _, label, n in table if label == y) for y in (0, 1)}
    weight = {1: 1000.0 * prior, 0: 1000.0 * (1 - prior)}
    slope, shift = _curve([(x, y, weight[y] * n / total[y]) for x, y, n in table])
    return CompressionModel(good, bad, slope, shift, level, block)


def scored(docs: DataFrame, model: CompressionModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` plus score (0 to 1, higher: good likelier) and predicted (1 from ``threshold``).

    Whole texts are read.  Null and empty texts get the score of difference 0;
    repeated rows score alike; columns of those names are replaced.
    """
    return docs.withColumn("score", model.score(difference(F.col(text), model))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def held_out(key: Column) -> Column:
    """True for the fifth of the keys that no model may learn from."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    rows: int = SAMPLE_ROWS, **options,
) -> CompressionModel:
    """A model from labels of keys that are not held out, about ``rows`` of each class.

    The sample is drawn from the labels, so it is small by its bound and broadcast;
    its texts are read in one scan and written once.  A key with several labels or
    texts gives a row for each; null keys join nothing.
    """
    sample = sampled_labels(labels.filter(~held_out(F.col(key))), key, label, rows)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return fit(stored(texts.join(F.broadcast(sample), "key").select("text", "label", "part"), "sample"), rows, **options)
