"""Near copies of texts: 256-bit SimHash prints name candidates, exact similarity of shingle sets decides.

64 bits cannot tell a similarity of 0.8 from chance, so prints have 256: the share of
differing bits is the angle between two sets of shingles.  They are mapped to the bit counts
of 2-bit segments and meet in 16 grids of 16 bits, as in ``simhash``; a pair at 0.8 misses all
grids in a few cases in a thousand.  A cell compares the first 128 bits.

Links are found in rounds.  Every text proposes two neighbours of other groups, the nearest one and the
one with the smallest number; the proposals are checked exactly, and true links merge groups.  So a group
of near copies costs a few proposals per text, not its pairs.  When a round merges nothing, all candidates that
still lie between two groups are checked: no link between different groups is left out.

From the second round on, the points that have a candidate carry a parity sketch of their set.  The differing bits of two
sketches never exceed the number of shingles that only one of the sets has, so a cell drops pairs that cannot be at
the similarity, and no others, before it makes a row of them.  A point of which no pair is left takes no part in later rounds.

Whole texts are dealt out only where a filter of the wanted keys (a megabyte of bits) does not rule the row out, and the
grids of a large table are filled one part after the other: the disk holds the rows of one part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armscope.llm.common import free_prefix, stored
from armscope.llm.components import components
from armscope.llm.simhash import BLOCK, SEED, SEGMENT, STEP, _meet, differing, in_blocks, segment_counts

#: Words of a shingle, and similarity (Jaccard) from which documents count as near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a print, bits that a cell compares, bits of a group and groups of the grids: all bits are used.
BITS, COMPARED, GROUP, GROUPS = 256, 128, 16, 16
#: Standard deviations above the mean of a pair just at the similarity, up to where pairs are candidates.
DEVIATIONS = 3.5
#: Bits of a parity sketch, and 64-bit words of a point that carries one: print, sketch, size of the set.
SKETCH = 512
WORDS = (BITS + SKETCH) // 64 + 1
#: Rows of cells that one task makes, about.
CELL_ROWS = 1_000_000
#: Groups of bits whose grids are filled at once, where all groups would give more than so many rows of cells.
AT_ONCE, ALL_AT_ONCE = 4, 2_000_000
#: Bits of a key filter, and bits of one part of it as Spark's bitmap functions make them.
SLOTS, SLOTS_OF_PART = 1 << 23, 1 << 15


def _grams(text: str | None, shingle: int) -> set[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return set()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def wide_point(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """256-bit fingerprint of the set of a text's shingles, and 64 bits that tell sets of one fingerprint apart."""
    grams = _grams(text, shingle)
    if not grams:
        return bytes(BITS // 8 + 8)
    ones = np.zeros(BITS, dtype=np.int64)
    raw = b"".join([xxhash.xxh3_128_digest(g, seed) + xxhash.xxh3_128_digest(g, seed + 1) for g in grams])
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(-1, BITS // 8)
    for at in range(0, len(rows), 65_536):
        ones += np.unpackbits(rows[at : at + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    print_ = np.packbits(ones * 2 > len(rows), bitorder="little").tobytes()
    digests = np.frombuffer(raw, dtype="<u8").reshape(len(rows), -1)[:, 0]
    return print_ + xxhash.xxh3_64_digest(np.sort(digests).tobytes(), seed)


def radius_of(similarity: float, bits: int = COMPARED, deviations: float = DEVIATIONS) -> int:
    """Differing bits of a pair of that similarity, so many standard deviations above the mean."""
    cosine = 2 * similarity / (1 + similarity)
    share = math.acos(min(1.0, cosine)) / math.pi
    return max(0, round(bits * share + deviations * math.sqrt(bits * share * (1 - share))))


def shingle_digests(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """The sorted 64-bit digests of a text's distinct shingles."""
    found = {xxhash.xxh3_64_intdigest(g, seed) for g in _grams(text, shingle)}
    return np.sort(np.fromiter(found, dtype="<u8", count=len(found))).tobytes()


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sets of digests; two empty sets are the same."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def parity_sketch(digests: bytes) -> bytes:
    """Of a set of digests the parity of the number in each of ``SKETCH`` classes, and the size of the set (64 bits)."""
    found = np.frombuffer(digests, "<u8")
    odd = np.bincount((found % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes() + len(found).to_bytes(8, "little")


# --- cells -------------------------------------------------------------------------

def _cells(batches: Iterator[pa.RecordBatch], carried: int, groups: range) -> Iterator[pa.RecordBatch]:
    """Every point in its own cell of each of the groups of bits and in those one step above, with the first words of its print."""
    size = GROUP // SEGMENT
    powers = np.uint64(SEGMENT + 1) ** np.arange(size, dtype=np.uint64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        words = np.frombuffer(b"".join(batch.column("print").to_pylist()), dtype="<u8").reshape(n, -1)
        counts = segment_counts(words[:, : BITS // 64])
        pid, label = batch.column("pid"), batch.column("label")
        shown = [pa.array(np.ascontiguousarray(words[:, i]).view(np.int64)) for i in range(carried)]
        for g in groups:
            part = counts[:, g * size : (g + 1) * size].astype(np.uint64)
            home = (part * powers).sum(axis=1, dtype=np.uint64) * np.uint64(GROUPS) + np.uint64(g)
            who, where = np.nonzero(part < SEGMENT)
            cell = np.concatenate([home, home[who] + powers[where] * np.uint64(GROUPS)])
            at = pa.array(np.concatenate([np.arange(n), who]))
            own = np.arange(len(cell)) < n
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.view(np.int64)), pa.array(own), *[c.take(at) for c in (pid, label, *shown)]],
                ["cell", "own", "pid", "label", *[f"w{i}" for i in range(carried)]],
            )


def _placed(points: DataFrame, n: int, block: int, carried: int, groups: range = range(GROUPS)) -> DataFrame:
    """Points (pid, label, print), ``n`` of them, dealt by cell of these groups and sorted; a full cell comes as pairs of blocks.

    Rows carry the first ``carried`` words of 64 bits of the print.
    """
    kind = "cell bigint, own boolean, pid bigint, label bigint, " + ", ".join(f"w{i} bigint" for i in range(carried))
    tasks = max(1, n * len(groups) * GROUP // 2 // CELL_ROWS)
    cells = points.select("pid", "label", "print").repartition(tasks, "pid").mapInArrow(
        lambda batches: _cells(batches, carried, groups), kind
    )
    full = (
        cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
        .select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    # Written first: Spark then knows that it is small, and the cells are not shuffled for the join.
    return in_blocks(cells.join(stored(full, "full"), "cell", "left"), "pid")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of one cell (or pair of its blocks) at a time, from rows sorted by cell; lone rows are left out."""
    rest: pa.Table | None = None

    def parts(t: pa.Table) -> Iterator[dict[str, np.ndarray]]:
        cols = {c: t.column(c).to_numpy() for c in t.column_names}
        new = np.ones(t.num_rows, dtype=bool)
        new[1:] = np.any([cols[k][1:] != cols[k][:-1] for k in ("cell", "i", "j")], axis=0)
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], t.num_rows]
        busy = (ends - starts > 1) & (np.add.reduceat(cols["own"].astype(np.int64), starts) > 0)
        for s, e in zip(starts[busy].tolist(), ends[busy].tolist()):
            yield {k: v[s:e] for k, v in cols.items()}

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        last = np.all([t.column(k).to_numpy() == t.column(k)[-1].as_py() for k in ("cell", "i", "j")], axis=0)
        cut = int(np.argmax(last))  # the last cell may go on in the next batch
        rest = t.slice(cut)
        if cut:
            yield from parts(t.slice(0, cut))
    if rest is not None:
        yield from parts(rest)


def _near(
    cell: dict[str, np.ndarray], radius: int, similarity: float | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows at home, distance to every row) in steps; far where two rows are of one group, do not meet or exceed the radius.

    With a similarity, rows carry sketches: pairs that cannot be at it are far, and the distance is the least part of
    both sets (in 1,000) that only one of them has.
    """
    order = np.argsort(cell["pid"], kind="stable")
    for k in cell:
        cell[k] = cell[k][order]
    words = np.stack([cell["w0"], cell["w1"]], axis=1).view(np.uint64)
    label, role = cell["label"], cell["role"]
    if similarity is not None:
        sketch = np.stack([cell[f"w{k}"] for k in range(BITS // 64, WORDS - 1)], axis=1).view(np.uint64)
        size = cell[f"w{WORDS - 1}"]
    homes = np.flatnonzero(cell["own"])
    step = max(1, STEP // len(words))
    for at in range(0, len(homes), step):
        h = homes[at : at + step]
        far = differing(words[h][:, None], words[None]).astype(np.int16)
        far[(label[h][:, None] == label[None]) | (far > radius)] = _FAR
        if (role != 3).any():
            far[~_meet(role[h][:, None], role[None])] = _FAR
        if similarity is not None:
            i, j = np.nonzero(far < _FAR)
            for k in range(0, len(i), 65_536):
                x, y = i[k : k + 65_536], j[k : k + 65_536]
                far[x, y] = _apart(sketch, size, h[x], y, similarity)
        yield h, far


_FAR, _NONE = 10_000, (1 << 63) - 1


def _apart(sketch: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """The least part (in 1,000) of both sets that only one of them has; far where it rules out the similarity."""
    both = size[a] + size[b]
    least = np.maximum(differing(sketch[a], sketch[b]), np.abs(size[a] - size[b]))
    # Sets of that similarity have at most this part of their shingles alone; the slack is for rounding.
    ruled_out = least > both * ((1 - similarity) / (1 + similarity)) + 1e-6
    return np.where(ruled_out, _FAR, 1000 * least // np.maximum(both, 1)).astype(np.int16)


def _proposals(points: DataFrame, n: int, radius: int, block: int, similarity: float | None = None) -> DataFrame:
    """(pid, nearest, lowest): two points of other groups within the radius, over all cells.

    The nearest (among equals the one with the smallest pid), and the one with the smallest pid of
    all: members of a group of near copies mostly agree on it, so one round ties most of the group together.
    Without a similarity, every point of a pair proposes.  With one (prints then carry sketches) only points in
    their own cells do, of every pair that is left at least one end; the other ends have a row of nulls.
    """

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met_only = np.zeros(0, dtype=np.int64)
        for cell in _by_cell(batches):
            m = len(cell["pid"])
            best, other = np.full(m, _FAR, dtype=np.int64), np.zeros(m, dtype=np.int64)
            low = np.full(m, _NONE, dtype=np.int64)
            for h, far in _near(cell, radius, similarity):
                pid, met = cell["pid"], far < _FAR
                for rows, to, axis in ((h, pid, 1), (np.arange(m), pid[h], 0)):
                    at, first = far.argmin(axis=axis), met.argmax(axis=axis)
                    found = far.min(axis=axis)
                    better = (found < best[rows]) | ((found == best[rows]) & (to[at] < other[rows]))
                    best[rows[better]] = found[better]
                    other[rows[better]] = to[at][better]
                    some = found < _FAR
                    low[rows[some]] = np.minimum(low[rows[some]], to[first[some]])
            hit = best < _FAR
            if similarity is not None:
                met_only = np.union1d(met_only, cell["pid"][hit & ~cell["own"]])
                hit &= cell["own"]
            if hit.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[hit]) for x in (cell["pid"], best, other, low)], ["pid", "far", "other", "low"]
                )
        if len(met_only):
            none = pa.nulls(len(met_only), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(met_only), pa.array(np.full(len(met_only), _FAR)), none, none], ["pid", "far", "other", "low"]
            )

    def best_of(found: DataFrame) -> DataFrame:
        best = found.groupBy("pid").agg(F.min(F.struct("far", "other")).alias("best"), F.min("low").alias("low"))
        return best.select("pid", "best.far", "best.other", "low")

    carried = COMPARED // 64 if similarity is None else WORDS
    at_once = GROUPS if n * GROUPS * GROUP // 2 <= ALL_AT_ONCE else AT_ONCE
    parts = []
    for at in range(0, GROUPS, at_once):
        placed = _placed(points, n, block, carried, range(at, at + at_once))
        parts.append(best_of(placed.mapInArrow(nearest, "pid bigint, far bigint, other bigint, low bigint")))
        if at_once < GROUPS:
            parts[-1] = stored(parts[-1], "part")  # its rows of cells go before those of the next groups come
    found = parts[0] if len(parts) == 1 else best_of(reduce(DataFrame.unionByName, parts))
    return found.select("pid", F.col("other").alias("nearest"), F.col("low").alias("lowest"))


def _met_before(a: np.ndarray, b: np.ndarray, group: int) -> np.ndarray:
    """Whether the segment counts of two points are within one step in a group before ``group``."""
    size = GROUP // SEGMENT
    apart = np.abs(a[:, : group * size].astype(np.int8) - b[:, : group * size].astype(np.int8))
    return (apart.reshape(len(a), group, size).sum(axis=2) <= 1).any(axis=1)


def _between(points: DataFrame, n: int, radius: int, block: int, similarity: float | None = None) -> DataFrame:
    """(a, b): all pairs of points of different groups within the radius, each once.

    With a similarity, prints carry sketches, and pairs that these rule out are left out.

    A pair meets in at most one cell of a group of bits.  The whole prints tell its first group, whose cell makes
    the pair, so that no copies of it are written and taken out again.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches):
            counts, group = None, int(cell["cell"][0]) % GROUPS
            for h, far in _near(cell, radius, similarity):
                if counts is None:  # the rows are in the order of _near from here on
                    counts = segment_counts(np.stack([cell[f"w{k}"] for k in range(BITS // 64)], axis=1).view(np.uint64))
                # Two rows at home are compared in both directions.
                far[cell["own"][None] & (cell["pid"][h][:, None] > cell["pid"][None])] = _FAR
                i, j = np.nonzero(far < _FAR)
                for at in range(0, len(i), 65_536):
                    x, y = h[i[at : at + 65_536]], j[at : at + 65_536]
                    if group:
                        new = ~_met_before(counts[x], counts[y], group)
                        x, y = x[new], y[new]
                    if len(x):
                        a, b = cell["pid"][x], cell["pid"][y]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return _placed(points, n, block, BITS // 64 if similarity is None else WORDS).mapInArrow(pairs, "a bigint, b bigint")


# --- links -------------------------------------------------------------------------

def key_filter(keys: DataFrame) -> Callable[[Column], Column]:
    """A test of a key: where it is false, the one column of ``keys`` does not hold the key for certain.

    Every key sets one of ``SLOTS`` bits.  The driver gets these bits and no keys, a megabyte at most; from some millions of
    keys on more rows pass the test that need not, and a join has to follow in any case.
    """

    def slot(key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(SLOTS)) + 1  # the bitmap functions number parts and bits from 1

    parts = keys.select(slot(F.col(keys.columns[0])).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part"))
    bits = np.zeros(SLOTS // 8, dtype=np.uint8)
    size = SLOTS_OF_PART // 8
    for r in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect():
        bits[(r["part"] - 1) * size : r["part"] * size] = np.frombuffer(r["bits"], dtype=np.uint8)

    @F.pandas_udf("boolean")
    def held(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy() - 1
        return pd.Series((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return lambda key: held(slot(key))


def _text_key(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def near_groups(
    points: DataFrame, docs: DataFrame, text: str, shingle: int, similarity: float, seed: int, block: int
) -> DataFrame:
    """(node, component) of the points that a chain of candidates of at least ``similarity`` ties to another.

    ``points`` (pid, print, h) are the distinct sets of shingles, with the digest of a text of each.
    The sets of candidates are written once, as sorted 64-bit digests.  Counts of active points and of links come to the driver.
    """
    radius = radius_of(similarity)
    digest = F.udf(lambda t: shingle_digests(t, shingle, seed), "binary", useArrow=True)
    sketch = F.udf(parity_sketch, "binary", useArrow=True)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) >= similarity for x, y in zip(a, b)], dtype=bool)

    active = points.select("pid", F.col("pid").alias("label"), "print")
    n, sets, links, labels = points.count(), None, None, None
    while True:
        first = sets is None
        proposed = stored(_proposals(active, n, radius, block, None if first else similarity), "proposed")
        if first:
            # Both ends of a candidate have a proposal, so these are the sets of all candidates of all rounds.
            wanted = stored(points.join(proposed.select("pid"), "pid").select("pid", "h"), "wanted")
            texts = docs.select(_text_key(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t"))
            texts = texts.filter(key_filter(wanted.select("h"))(F.col("h")))
            texts = texts.join(wanted.select("h"), "h", "left_semi").groupBy("h").agg(F.first("t").alias("t"))
            sets = stored(texts.join(wanted, "h").select("pid", digest("t").alias("set")), "sets")

        def true_links(pairs: DataFrame) -> DataFrame:
            both = pairs.join(sets.select(F.col("pid").alias("a"), F.col("set").alias("x")), "a").join(
                sets.select(F.col("pid").alias("b"), F.col("set").alias("y")), "b"
            )
            return both.filter(alike("x", "y")).select("a", "b")

        ends = proposed.filter("nearest IS NOT NULL").select(
            "pid", F.explode(F.array_distinct(F.array("nearest", "lowest"))).alias("to")
        )
        pairs = ends.select(F.least("pid", "to").alias("a"), F.greatest("pid", "to").alias("b")).distinct()
        found = stored(true_links(pairs), "links")
        merged = found.count()
        links = found if links is None else links.unionByName(found)
        if first:
            # Points without a candidate are done; the others carry sketches from here on.
            sketched = sets.select("pid", sketch("set").alias("sketch"))
            active = active.join(sketched, "pid").select(
                "pid", "label", F.concat(F.substring("print", 1, BITS // 8), "sketch").alias("print")
            )
        else:
            # Groups only grow: a point of which no pair is left will have none later.
            active = active.join(proposed.select("pid"), "pid", "left_semi")
        if merged:
            labels = stored(components(links), "labels")
            named = labels.select(F.col("node").alias("pid"), F.col("component").alias("label"))
            active = active.drop("label").join(named, "pid", "left").withColumn("label", F.coalesce("label", "pid"))
        active, before = stored(active.select("pid", "label", "print"), "active"), n
        n = active.count()
        if not first and 2 * n < before:
            sets = stored(sets.join(active.select("pid"), "pid", "left_semi"), "sets")
        if n and merged:
            continue
        if n:
            rest = stored(true_links(_between(active, n, radius, block, similarity)), "links")
            if not rest.isEmpty():
                labels = stored(components(links.unionByName(rest)), "labels")
        return labels if labels is not None else found.selectExpr("a AS node", "b AS component")


def similar_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY,
    seed: int = SEED, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, h, component_id) for every row: documents chained by links of at least ``similarity``.

    component_id is the smallest doc_id of the component, h the digest of the row's text.  Nulls, copies and
    repeated rows are treated as by ``simhash.near_duplicates``.
    """
    rows = _components(docs, doc_id, text, shingle, similarity, seed, block)
    # Written first, so that the join can split the rows of a large component.
    first = stored(rows.groupBy("component").agg(F.min("id").alias("component_id")), "first")
    return rows.join(first, "component").select(F.col("id").alias(doc_id), "h", "component_id")


def _components(
    docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float, seed: int, block: int
) -> DataFrame:
    """(id, h, component) of every row; a component is named by one of its points."""
    wide = F.udf(lambda t: wide_point(t, shingle, seed), "binary", useArrow=True)
    prints = stored(
        docs.select(F.col(doc_id).alias("id"), _text_key(text).alias("h"), wide(F.col(text)).alias("print")), "prints"
    )
    points = prints.groupBy("print").agg(F.min("h").alias("h")).withColumn("pid", F.monotonically_increasing_id())
    points = stored(points, "points")
    groups = near_groups(points, docs, text, shingle, similarity, seed, block)
    named = points.join(groups.withColumnRenamed("node", "pid"), "pid", "left").select(
        "print", F.coalesce("component", "pid").alias("component")
    )
    return prints.join(stored(named, "components"), "print").select("id", "h", "component")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of near copies: the row with the smallest doc_id, nulls last, then the smallest text digest.

    Rows that repeat both doc_id and text are copies too: one of them stays.
    """
    x = free_prefix(docs)
    key, many, some = f"{x}key", f"{x}many", f"{x}some"

    def row_key(id_: Column, h: Column) -> Column:
        return F.unhex(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("null")), F.lit(":"), F.hex(h))))

    defaults = {"shingle": SHINGLE, "similarity": SIMILARITY, "seed": SEED, "block": BLOCK}
    found = _components(docs, doc_id, text, **(defaults | options))
    rows = found.select(
        row_key(F.col("id"), F.col("h")).alias(key), "component",
        F.struct(F.col("id").isNull(), "id", "h").alias("rank"),
    )
    rows = stored(rows.groupBy(key, "component", "rank").agg(F.count(F.lit(1)).alias("n")), "rows")
    first = rows.groupBy("component").agg(F.min("rank").alias("first"))
    marked = stored(
        rows.join(first, "component").select(key, "n", (F.col("rank") == F.col("first")).alias("stays")), "marked"
    )
    # Most rows are in no group and not repeated: they stay where they are, and only the others are dealt out.
    perhaps = key_filter(marked.filter("NOT stays OR n > 1").select(key))
    keyed = docs.withColumn(key, row_key(F.col(doc_id), _text_key(text))).withColumn(some, perhaps(F.col(key)))
    left = keyed.filter(some).join(marked.filter("NOT stays").select(key), key, "left_anti")
    repeated = marked.filter("stays AND n > 1").select(key)
    any_row = Window.partitionBy(key).orderBy(F.lit(0))
    one = left.join(repeated, key, "left_semi").withColumn(many, F.row_number().over(any_row)).filter(F.col(many) == 1)
    rest = left.join(repeated, key, "left_anti")
    return reduce(DataFrame.unionByName, [df.select(*docs.columns) for df in (keyed.filter(~F.col(some)), rest, one)])
