"""Alignment of two tokenizers over a corpus, with pair counts under minimal perfect hashes.

A text's tokens of both tokenizers cover the same bytes.  Every stretch between
neighbouring token ends of either side lies in one token of each: these stretches are
the links.  Texts are encoded once, and their ids are written.  A first pass aligns all texts and
counts, batch by batch, in how many of them each pair of ids is linked.  The distinct pairs are dealt to cells by
their first id; every cell gets a minimal perfect hash, so its counts are a dense vector
indexed by hash, and the batches' vectors are summed in a tree.  The vectors hold
no keys; the pair of every slot stands beside its count and is compared at each lookup.
A second pass aligns the texts again and looks the counts up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armscope.llm.common import stored
from armscope.llm.token_ids import few, token_ids

#: A pair is one number: the first id times this, plus the second id.
WIDE = 1 << 32
#: Distinct pairs of a cell, and pairs of a group that meets a cell, about.
CELL_PAIRS, GROUP_PAIRS = 65_536, 500_000
#: Vectors that are added up in one group of a tree.
FAN_IN = 16
#: Pairs of a worker after which it hands on what it has counted.
HELD = 1_000_000
#: Bits of a level of a hash, per key that is still without a slot.
GAMMA = 2


# --- minimal perfect hashing ----------------------------------------------------

def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit mixing of keys and a seed by two multiply-and-shift rounds."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Levels of a minimal perfect hash of distinct keys: bits where exactly one key of the level fell.

    Keys that share a bit go on to the next level, which has another seed.
    """
    levels, left = [], keys
    while len(left):
        size = GAMMA * len(left) + 1
        spot = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(spot, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[spot]]
    return levels


def look_up(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of every key, -1 for keys that surely are none of the hash; other foreign keys get any slot."""
    slot = np.full(len(keys), -1, dtype=np.int64)
    left, base = np.arange(len(keys)), 0
    for n, alone in enumerate(levels):
        spot = (mixed(keys[left], n) % np.uint64(len(alone))).astype(np.int64)
        here = alone[spot]
        rank = np.cumsum(alone)
        slot[left[here]] = base + rank[spot[here]] - 1
        base += int(rank[-1])
        left = left[~here]
    return slot


def pack_levels(levels: list[np.ndarray]) -> tuple[list[bytes], list[int]]:
    return [np.packbits(x).tobytes() for x in levels], [len(x) for x in levels]


def unpack_levels(bits: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(bits, sizes)]


# --- one text ---------------------------------------------------------------------

class Pair:
    """Two tokenizers and what their tokens stand for."""

    def __init__(self, first: str, second: str):
        self.sides = [token_ids(first), token_ids(second)]
        spelt = [side.token_bytes() for side in self.sides]
        self.sizes = [np.array([len(x) for x in t], dtype=np.int64) for t in spelt]
        self.kinds = ["<u2" if len(t) <= 1 << 16 else "<u4" for t in spelt]
        self.spelt = [np.array(t, dtype=object) for t in spelt]
        names = [str(i) for i in range(max(map(len, spelt)))]
        # Text of an id inside its side, at the end of a first side, at the end of a group.
        self.named = np.array([[n + mark for n in names] for mark in ",|;"], dtype=object)

    def encoded(self, texts: list[str | None]) -> list[tuple[bytes | None, bytes | None]]:
        """Packed ids of every text, each as narrow as its vocabulary allows; none where a side does not spell space + text."""
        full = [t for t in texts if t]
        found = iter(zip(self.sides[0].packed([" " + t for t in full]), self.sides[1].packed(full)))
        out: list[tuple[bytes | None, bytes | None]] = []
        for t in texts:
            if not t:
                out.append((None, None))
                continue
            want = (" " + t).encode()
            ids = [np.frombuffer(raw, "<u4") for raw in next(found)]
            same = all(
                int(size[x].sum()) == len(want) and b"".join(spelt[x].tolist()) == want
                for x, size, spelt in zip(ids, self.sizes, self.spelt)
            )
            out.append(tuple(x.astype(kind).tobytes() for x, kind in zip(ids, self.kinds)) if same else (None, None))
        return out

    def aligned(self, raw_a: bytes, raw_b: bytes) -> Alignment:
        a, b = (np.frombuffer(raw, kind).astype(np.int64) for raw, kind in zip((raw_a, raw_b), self.kinds))
        return Alignment(a, b, np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b]))


class Alignment:
    """Ids of both sides of a text, and the bytes at which they end, as marks over its bytes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray):
        self.a, self.b, self.ends_a, self.ends_b = a, b, ends_a, ends_b
        self.marks_a, self.marks_b = np.zeros((2, int(ends_a[-1]) + 1), dtype=bool)
        self.marks_a[ends_a] = True
        self.marks_b[ends_b] = True

    def links(self) -> np.ndarray:
        """Pairs of ids of all links, in the order of the text."""
        cuts = np.flatnonzero(self.marks_a | self.marks_b)
        # The token of a stretch is the first that ends at its end or later.
        at_a = np.cumsum(self.marks_a[cuts]) - self.marks_a[cuts]
        at_b = np.cumsum(self.marks_b[cuts]) - self.marks_b[cuts]
        return self.a[at_a] * WIDE + self.b[at_b]

    def groups(self, named: np.ndarray) -> tuple[int, str]:
        """How many groups the common ends cut, and all groups as text."""
        common = self.marks_a & self.marks_b
        before = np.cumsum(common, dtype=np.int32) - common
        # Two halves for each group: its first ids, then its second ids.
        half = np.concatenate([2 * before[self.ends_a], 2 * before[self.ends_b] + 1])
        order = np.argsort(half, kind="stable")
        half, ids = half[order], np.concatenate([self.a, self.b])[order]
        mark = np.where(np.r_[half[1:] != half[:-1], True], 1 + half % 2, 0)
        return int(common.sum()), "".join(named[mark, ids].tolist())[:-1]


@lru_cache(maxsize=2)
def _pair(first: str, second: str) -> Pair:
    return Pair(first, second)


def _cell(pairs: np.ndarray, cells: int) -> np.ndarray:
    """Cell of a pair by its first id, so all pairs of an id are in one cell: at most one for each second id."""
    return (mixed(pairs // WIDE, 77) % np.uint64(cells)).astype(np.int64)


# --- passes over the texts ----------------------------------------------------------

def _encoded(rows: DataFrame, first: str, second: str) -> DataFrame:
    """(doc_id, key, a, b): the packed ids of every text, null where it has no tokens."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _pair(first, second)
        for batch in few(batches):
            ids = both.encoded(batch.column("text").to_pylist())
            a, b = (pa.array([x[i] for x in ids], pa.binary()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), a, b], ["doc_id", "key", "a", "b"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "key", "text").mapInArrow(encode, f"doc_id {kind}, key bigint, a binary, b binary")


def _counted(tokens: DataFrame, first: str, second: str) -> DataFrame:
    """First pass: (pair, n): how many texts of some rows link a pair.  A pair comes once for each such part of the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, held, size = _pair(first, second), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, times = (np.concatenate(x) for x in zip(*held))
            names, at = np.unique(pairs, return_inverse=True)
            return names, np.bincount(at, weights=times, minlength=len(names)).astype(np.int64)

        def handed(names: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(times)], ["pair", "n"])

        for batch in few(batches):
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                pairs = np.unique(both.aligned(a, b).links())
                held.append((pairs, np.ones(len(pairs), dtype=np.int64)))
                size += len(pairs)
            if size > HELD:
                names, times = summed()
                held, size = [(names, times)], len(names)
                if size > HELD // 2:  # few pairs repeat
                    yield handed(names, times)
                    held, size = [], 0
        if held:
            yield handed(*summed())

    return tokens.filter("a IS NOT NULL").select("a", "b").mapInArrow(count, "pair bigint, n bigint")


def _aligned(tokens: DataFrame, first: str, second: str, cells: int) -> DataFrame:
    """Second pass: a row per text with its figures (cell null), and rows of pairs to look up, a cell at a time.

    ``docs``, ``pairs``, ``times``: how often which text links which pair.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _pair(first, second)
        for batch in few(batches):
            ids, keys = batch.column("doc_id"), batch.column("key").to_numpy()
            figures, docs, pairs, times = [], [], [], []
            for key, a, b in zip(keys.tolist(), batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                if a is None:
                    figures.append((0, 0, 0, 0, ""))
                    continue
                found = both.aligned(a, b)
                linked = found.links()
                n, text = found.groups(both.named)
                figures.append((len(found.a), len(found.b), n, len(linked), hashlib.sha256(text.encode()).hexdigest()))
                names, often = np.unique(linked, return_counts=True)
                docs.append(np.full(len(names), key))
                pairs.append(names)
                times.append(often)
            n = len(keys)
            columns = [pa.array(x, t) for x, t in zip(zip(*figures), [pa.int64()] * 4 + [pa.string()])] if n else []
            if n:
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(keys), *columns, pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.list_(pa.int64()))] * 3], _ALIGNED_NAMES
                )
            if not docs:
                continue
            docs, pairs, times = (np.concatenate(x) for x in (docs, pairs, times))
            cell = _cell(pairs, cells)
            order = np.argsort(cell, kind="stable")
            cell, docs, pairs, times = (x[order] for x in (cell, docs, pairs, times))
            begins = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            offsets = pa.array(np.r_[begins, len(cell)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (docs, pairs, times)]
            m = len(begins)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, ids.type)] + [pa.nulls(m, pa.int64())] * 5 + [pa.nulls(m, pa.string()), pa.array(cell[begins]), *lists], _ALIGNED_NAMES
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(
        align,
        f"doc_id {kind}, key bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, cell bigint, "
        "docs array<bigint>, pairs array<bigint>, times array<bigint>",
    )


_ALIGNED_NAMES = ["doc_id", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "cell", "docs", "pairs", "times"]


# --- the counts ----------------------------------------------------------------------

_HASH = "cell bigint, bits array<binary>, sizes array<bigint>, keys array<bigint>"


def _hashes(pairs: DataFrame, cells: int) -> DataFrame:
    """(cell, bits, sizes, keys): the minimal perfect hash of every cell's pairs, and the pair of each slot."""

    def build(part: pa.Table) -> pa.Table:
        keys = part.column("pair").to_numpy()
        levels = build_hash(keys)
        bits, sizes = pack_levels(levels)
        by_slot = np.empty_like(keys)
        by_slot[look_up(levels, keys)] = keys
        return pa.table({
            "cell": pa.array([part.column("cell")[0].as_py()], pa.int64()), "bits": pa.array([bits], pa.list_(pa.binary())),
            "sizes": pa.array([sizes], pa.list_(pa.int64())), "keys": pa.array([by_slot], pa.list_(pa.int64())),
        })

    return pairs.groupBy("cell").applyInArrow(build, _HASH)


def _slots(table: pa.Table, pairs: np.ndarray) -> np.ndarray:
    """Slots of pairs in the hash that is the one row of ``table``; a pair that is not the slot's key is an error."""
    levels = unpack_levels(table.column("bits")[0].as_py(), table.column("sizes")[0].as_py())
    slot = look_up(levels, pairs)
    if len(pairs) and ((slot < 0).any() or (table.column("keys")[0].values.to_numpy()[slot] != pairs).any()):
        raise ValueError("a pair that is to be looked up was not counted")
    return slot


def _spread(rows: DataFrame, by: str, tables: DataFrame) -> DataFrame:
    """The table of a cell once for every group (at_cell, at_``by``) of its rows."""
    groups = rows.select(F.col("cell").alias("at_cell"), F.col(by).alias(f"at_{by}")).distinct()
    return groups.join(tables, groups["at_cell"] == tables["cell"]).drop("cell")


def _vectors(partial: DataFrame, hashes: DataFrame) -> DataFrame:
    """(cell, branch, counts): a dense vector of counts for every branch of a cell's partial counts."""

    def count(part: pa.Table, table: pa.Table) -> pa.Table:
        if not part.num_rows:
            return _VECTOR.empty_table()
        slot = _slots(table, part.column("pair").to_numpy())
        counts = np.zeros(len(table.column("keys")[0].values), dtype=np.int64)
        np.add.at(counts, slot, part.column("n").to_numpy())
        return pa.table([part.column("cell").slice(0, 1), part.column("branch").slice(0, 1), pa.array([counts], pa.list_(pa.int64()))], schema=_VECTOR)

    spread = _spread(partial, "branch", hashes)
    return partial.groupBy("cell", "branch").cogroup(spread.groupBy("at_cell", "at_branch")).applyInArrow(
        count, "cell bigint, branch bigint, counts array<bigint>"
    )


_VECTOR = pa.schema([("cell", pa.int64()), ("branch", pa.int64()), ("counts", pa.list_(pa.int64()))])


def _tree_sum(vectors: DataFrame, branches: int) -> DataFrame:
    """(cell, counts): vectors of every cell added up, at most FAN_IN in a group."""

    def add(part: pa.Table) -> pa.Table:
        total = sum(x.values.to_numpy() for x in part.column("counts"))
        return pa.table([part.column("cell").slice(0, 1), part.column("branch").slice(0, 1), pa.array([total], pa.list_(pa.int64()))], schema=_VECTOR)

    while branches > 1:
        branches = -(-branches // FAN_IN)
        vectors = vectors.withColumn("branch", F.floor(F.col("branch") / FAN_IN).cast("bigint")).groupBy("cell", "branch").applyInArrow(
            add, "cell bigint, branch bigint, counts array<bigint>"
        )
    return vectors.select("cell", "counts")


def _looked_up(wanted: DataFrame, tables: DataFrame) -> DataFrame:
    """(key, n_best, count_sum) parts: the counts of one cell's pairs for the texts of one group."""
    out = pa.schema([("key", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def find(part: pa.Table, table: pa.Table) -> pa.Table:
        if not part.num_rows:
            return out.empty_table()
        docs, pairs, times = (part.column(c).combine_chunks().flatten().to_numpy() for c in ("docs", "pairs", "times"))
        slot = _slots(table, pairs)
        counts, keys = (table.column(c)[0].values.to_numpy() for c in ("counts", "keys"))
        ids, of = np.unique(keys // WIDE, return_inverse=True)
        most = np.zeros(len(ids), dtype=np.int64)
        np.maximum.at(most, of, counts)
        best = counts == most[of]
        who, at = np.unique(docs, return_inverse=True)
        sums = np.zeros((2, len(who)), dtype=np.int64)
        np.add.at(sums[0], at, times * best[slot])
        np.add.at(sums[1], at, times * counts[slot])
        return pa.table([pa.array(who), pa.array(sums[0]), pa.array(sums[1])], schema=out)

    spread = _spread(wanted, "group", tables)
    return wanted.groupBy("cell", "group").cogroup(spread.groupBy("at_cell", "at_group")).applyInArrow(
        find, "key bigint, n_best bigint, count_sum bigint"
    )


def pair_counts(
    tokens: DataFrame, first: str, second: str, cell_pairs: int = CELL_PAIRS, group_pairs: int = GROUP_PAIRS
) -> tuple[DataFrame, int]:
    """(cell, bits, sizes, keys, counts) and the number of cells: in how many texts of ``tokens`` (a, b) each pair is linked."""
    partial = stored(_counted(tokens, first, second), "partial")
    total, distinct = partial.agg(F.count(F.lit(1)), F.approx_count_distinct("pair", 0.02)).first()
    cells, branches = max(1, -(-distinct // cell_pairs)), max(1, -(-total // group_pairs))

    @F.pandas_udf("bigint")
    def cell(pairs: pd.Series) -> pd.Series:
        return pd.Series(_cell(pairs.to_numpy(), cells))

    dealt = partial.withColumns({"cell": cell("pair"), "branch": F.floor(F.rand(7) * branches).cast("bigint")})
    # The branch of a row is drawn, so it is written before anything is grouped by it.
    dealt = stored(dealt, "dealt")
    hashes = stored(_hashes(dealt.select("cell", "pair").distinct(), cells), "hashes")
    counts = stored(_tree_sum(_vectors(dealt, hashes), branches), "counts")
    return stored(hashes.join(counts, "cell"), "tables"), cells


def aligned(
    docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text",
    cell_pairs: int = CELL_PAIRS, group_pairs: int = GROUP_PAIRS,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    ``first`` encodes a space and the text, ``second`` the text (it adds the space); special
    strings are plain text.  Null and empty texts, and texts that the tokens of either side do not
    spell, have no tokens: zeros and ''.  n_best counts the links whose pair is the most frequent one of
    its first id, ties included; count_sum adds the counts of all links' pairs.  Rows
    that repeat a doc_id are texts of their own, a null doc_id stays null, other columns are ignored, and an
    empty table gives no rows.

    A cell holds about ``cell_pairs`` pairs, at most all second ids for each of its first ids; a
    group that meets a cell holds about ``group_pairs`` of the texts' pairs, however frequent they are.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # The number of a row is written beside its ids, so it is the same wherever it is read.
    tokens = stored(_encoded(rows.withColumn("key", F.monotonically_increasing_id()), first, second), "tokens")
    tables, cells = pair_counts(tokens, first, second, cell_pairs, group_pairs)
    second_pass = stored(_aligned(tokens, first, second, cells), "aligned")
    asked = second_pass.filter("cell IS NOT NULL").select("cell", "docs", "pairs", "times")
    # A cell with many rows is met by many groups; at most a number per cell is joined back.
    groups = stored(
        asked.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("pairs")) / group_pairs)).cast("bigint").alias("groups")),
        "groups",
    )
    wanted = asked.join(groups, "cell").withColumn(
        "group", F.pmod(F.xxhash64(F.element_at("docs", 1)), F.col("groups"))
    ).drop("groups")
    found = _looked_up(wanted, tables).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    figures = second_pass.filter("cell IS NULL").select("doc_id", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return (
        figures.join(found, "key", "left")
        .select(
            F.col("doc_id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links",
            F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
            F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"), "groups_sha256",
        )
    )
