"""SimHash near-duplicates, joined on a grid of segment bit counts.

A 64-bit fingerprint is mapped to the bit counts of its segments.  Flipping a
bit changes one count by one, so the Manhattan distance of two such vectors
never exceeds the number of differing bits: a cheap lower bound.  The vectors
are cut into two halves.  Fingerprints that differ in at most three bits differ
by at most one step in one half, so they meet in a grid cell when every vector
stands in its own cell of either half and also looks into the cells one step
above.  In a cell the Manhattan distance filters, and the differing bits decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.llm.common import stored
from armscope.llm.components import components

#: Words of a shingle, differing bits of a link, seed of the shingle hash.
SHINGLE, RADIUS, SEED = 3, 3, 42
#: Bits of a segment.  Two give counts 0 to 2: 3 cells for 4 values.
SEGMENT = 2
#: Rows of one cell that one task compares; a fuller cell is dealt out as pairs of blocks.
BLOCK = 20_000


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a text: A-Z lower-cased, words split at ASCII white space, shingles hashed by XXH64.

    A bit is set if it is set in over half of the shingles' hashes.  Fewer words than
    a shingle: their whole sequence is one; none: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    ones, n = np.zeros(64, dtype=np.int64), 0
    digest = xxhash.xxh64_intdigest
    while True:  # in runs, so a huge text holds one run of hashes
        run = np.fromiter((digest(g, seed) for _, g in zip(range(65_536), grams)), dtype="<u8")
        if not isinstance(grams, list):
            more = len(run) == 65_536
        else:
            more = False
        ones += np.unpackbits(run.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(run)
        if not more:
            break
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The 64-bit fingerprint of a text column, as a signed bigint; null and blank texts give 0."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.array([simhash(t, shingle, seed) for t in texts], dtype=np.uint64)
            yield pd.Series(values.view(np.int64))

    return prints(text)


def hex_of(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


# --- the embedding -----------------------------------------------------------------

def as_words(column: pa.Array) -> np.ndarray:
    """Fingerprints of a bigint or binary column as rows of 64-bit words."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, 1)
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype="<u8").reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint64)


def segment_counts(prints: np.ndarray, width: int = SEGMENT) -> np.ndarray:
    """Bit counts of the segments of ``width`` bits, one row per fingerprint (rows of words), low segment first."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    return bits.reshape(len(prints), -1, width).sum(axis=2, dtype=np.uint8)


def unary(counts: np.ndarray, width: int = SEGMENT) -> np.ndarray:
    """Counts written as that many ones per segment: Manhattan distances become differing bits."""
    ones = np.arange(width, dtype=np.uint8) < counts[:, :, None]
    return np.packbits(ones.reshape(len(counts), -1), axis=1, bitorder="little").view("<u8")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words; of unary rows the Manhattan distance of their counts."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _cells(batches: Iterator[pa.RecordBatch], width: int, group: int, groups: int) -> Iterator[pa.RecordBatch]:
    """(cell, own, print): every fingerprint in its own cell of each group of bits and one step above."""
    size = group // width
    powers = (np.uint64(width + 1) ** np.arange(size, dtype=np.uint64)).astype(np.uint64)
    for batch in batches:
        column = batch.column(0)
        if not len(column):
            continue
        counts = segment_counts(as_words(column), width)
        rows = []
        for g in range(groups):
            part = counts[:, g * size : (g + 1) * size].astype(np.uint64)
            home = (part * powers).sum(axis=1, dtype=np.uint64) * np.uint64(groups) + np.uint64(g)
            rows.append((home, np.ones(len(column), bool), np.arange(len(column))))
            who, where = np.nonzero(part < width)
            rows.append((home[who] + powers[where] * np.uint64(groups), np.zeros(len(who), bool), who))
        for at in range(0, len(rows), 2):  # a batch per group stays small
            cell, own, who = (np.concatenate(x) for x in zip(*rows[at : at + 2]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.view(np.int64)), pa.array(own), column.take(pa.array(who))], ["cell", "own", "print"]
            )


#: Comparisons of one step.
STEP = 1 << 20


def _linked(prints: np.ndarray, shape: np.ndarray, own: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of a cell have a link, where at least one end is at home."""
    linked = np.zeros(len(prints), dtype=bool)
    homes = np.flatnonzero(own)
    step = max(1, STEP // len(prints))
    for at in range(0, len(homes), step):
        h = homes[at : at + step]
        near = differing(shape[h][:, None], shape[None]) <= radius
        near[np.arange(len(h)), h] = False
        i, j = np.nonzero(near)
        hit = differing(prints[h[i]], prints[j]) <= radius
        linked[h[i[hit]]] = linked[j[hit]] = True
    return linked


def _meet(role_a: np.ndarray, role_b: np.ndarray) -> np.ndarray:
    """Whether one is a left row and the other a right row."""
    return (((role_a & 1) & (role_b >> 1)) | ((role_a >> 1) & (role_b & 1))).astype(bool)


def _spanning(prints: np.ndarray, shape: np.ndarray, own: np.ndarray, role: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that span the same components as all links of one cell (or pair of its blocks).

    Rows that are both not at home in the cell are not compared: another cell
    holds them.  role: 1 left block, 2 right block, 3 both; only a left row and a
    right row are compared.  A first pass compares all rows at home with all rows and
    finds those with a link.  Then every row is reached once and compared with
    the rows not yet reached, so a dense group gives as many links as rows.
    """
    left = np.flatnonzero(_linked(prints, shape, own, radius))
    links: list[tuple[int, int]] = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            v = queue.pop()
            ok = (own[left] | own[v]) & _meet(role[left], role[v])
            near = ok & (differing(shape[left], shape[v]) <= radius)
            near[near] = differing(prints[left[near]], prints[v]) <= radius
            if near.any():
                hit = left[near]
                links += [(v, w) for w in hit.tolist()]
                queue += hit.tolist()
                left = left[~near]
    return links


def _links(batches: Iterator[pa.RecordBatch], radius: int, width: int) -> Iterator[pa.RecordBatch]:
    """Links of the cells of one partition, whose rows come sorted by cell and pair of blocks."""

    def solved(t: pa.Table) -> pa.RecordBatch:
        keys = [t.column(n).to_numpy() for n in ("cell", "i", "j")]
        own, role = t.column("own").to_numpy(), t.column("role").to_numpy()
        column = t.column("print").combine_chunks()
        new = np.zeros(len(own), dtype=bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(own)]
        busy = (ends - starts > 1) & (np.add.reduceat(own.astype(np.int64), starts) > 0)
        prints = as_words(column)
        shape = unary(segment_counts(prints, width), width)
        a: list[int] = []
        b: list[int] = []
        for s, e in zip(starts[busy].tolist(), ends[busy].tolist()):
            for x, y in _spanning(prints[s:e], shape[s:e], own[s:e], role[s:e], radius):
                a.append(s + x)
                b.append(s + y)
        return pa.RecordBatch.from_arrays([column.take(pa.array(x, pa.int64())) for x in (a, b)], ["a", "b"])

    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        last = np.ones(t.num_rows, dtype=bool)
        for n in ("cell", "i", "j"):
            k = t.column(n).to_numpy()
            last &= k == k[-1]
        cut = int(np.argmax(last))  # the last cell may go on in the next batch
        rest = t.slice(cut)
        if cut:
            yield solved(t.slice(0, cut))
    if rest is not None:
        yield solved(rest)


def print_links(
    prints: DataFrame, radius: int = RADIUS, width: int = SEGMENT, block: int = BLOCK, group: int = 32, groups: int = 2
) -> DataFrame:
    """Links (a, b) between DISTINCT fingerprints (one bigint or binary column) that span the components of all links.

    The first ``group`` * ``groups`` bits form groups of ``group`` bits, each with a grid of
    its own; fingerprints that are within one step in any group meet.  With
    radius < 2 * groups over all bits that is every link; otherwise a link is
    missed if all groups lie further apart.  A grid cell with over ``block`` rows is
    cut into blocks by digest, and every pair of blocks becomes a group of its
    own: no group outgrows a task, and no pair is left out.
    """
    kind = prints.dtypes[0][1]
    return _placed(prints, width, block, group, groups).mapInArrow(
        lambda batches: _links(batches, radius, width), f"a {kind}, b {kind}"
    )


def _placed(prints: DataFrame, width: int, block: int, group: int, groups: int) -> DataFrame:
    """Fingerprints dealt by cell and pair of blocks, and sorted by them."""
    column, kind = prints.columns[0], prints.dtypes[0][1]
    cells = prints.select(F.col(column).alias("print")).mapInArrow(
        lambda batches: _cells(batches, width, group, groups), f"cell bigint, own boolean, print {kind}"
    )
    full = (
        cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > block)
        .select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    return in_blocks(cells.join(full, "cell", "left"), "print")


def in_blocks(cells: DataFrame, key: str) -> DataFrame:
    """Rows with a cell and its number of ``blocks`` (null: one), dealt by cell and pair of blocks and sorted by them.

    A row of a cut cell comes once for every pair that its block, by the digest of ``key``, is in: i <= j are the blocks, and
    role tells which of them it is in (1 left, 2 right, 3 both).
    """
    dealt = cells.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)

    def spot(i: Column, j: Column, role: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), role.cast("int").alias("role"))

    # A pair of blocks is listed once, with i <= j.
    spots = F.when(F.col("blocks") == 1, F.array(spot(F.lit(0), F.lit(0), F.lit(3)))).otherwise(
        F.transform(
            others,
            lambda k: spot(
                F.least(mine, k), F.greatest(mine, k), F.when(mine == k, 3).when(mine < k, 1).otherwise(2)
            ),
        )
    )
    rest = [c for c in cells.columns if c not in ("cell", "own", "blocks")]
    placed = dealt.select("cell", "own", *rest, F.explode(spots).alias("s")).select(
        "cell", F.col("s.i").alias("i"), F.col("s.j").alias("j"), "own", F.col("s.role").alias("role"), *rest
    )
    return placed.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
    seed: int = SEED, width: int = SEGMENT, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest doc_id that chains of links of at most
    ``radius`` differing bits reach.  Null, empty and blank texts have
    fingerprint zero and link like any other; equal texts share a fingerprint,
    so thousands of copies are one point of the grid.  Repeated rows stay; a
    null doc_id keeps its row, and is a component's id only where no other id is
    in it.  Other columns are ignored.
    """
    prints = stored(
        docs.select(F.col(doc_id).alias("id"), fingerprint(F.col(text), shingle, seed).alias("print")), "prints"
    )
    found = _grouped(prints, lambda points: print_links(points, radius, width, block))
    return found.select(F.col("id").alias(doc_id), hex_of(F.col("print")).alias("fingerprint"), "component_id")


def _grouped(prints: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, print, component_id) of a table (id, print) whose distinct prints are linked by ``links_of``."""
    points = prints.groupBy("print").agg(F.min("id").alias("first"))
    groups = components(links_of(points.select("print")))
    named = (
        points.join(groups.withColumnRenamed("node", "print"), "print")
        .groupBy("component").agg(F.min("first").alias("component_id"))
    )
    moved = groups.join(named, "component").select(F.col("node").alias("print"), "component_id")
    smallest = points.join(moved, "print", "left").select(
        "print", F.coalesce("component_id", "first").alias("component_id")
    )
    # Written first: the last join then deals both sides itself and can split the fingerprint of many copies.
    smallest = stored(smallest, "components")
    return prints.join(smallest, "print", "left").select("id", "print", "component_id")
