"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Documents are token pieces of at most a sequence's length; gaps are what open
sequences have left.  A round

1. sorts documents and gaps by size into ranges, largest first, and sweeps every
   range: each document takes the smallest gap of its range that holds it;
2. carries what is left over between the ranges: all documents of one length want
   the smallest gap size that holds them, and the r-th of them by rank gets the place
   that rank r has in these gaps, so no two documents get one place;
3. opens sequences for the longest documents where no gap is left for them;
4. writes the places given, the gaps as they are now and the documents still without one.

Rounds go on until no document is left.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armscope.llm.common import free_name, shared_dir, stored
from armscope.llm.token_ids import few, token_ids

#: Tokens of a sequence, and the id put behind every document.
CAPACITY, END_ID = 2048, 0
#: Rows of one range.
RANGE_ROWS = 32_768
#: Where at least so many of the longest open documents fit a sequence, sequences are opened by volume.
BY_VOLUME = 4
#: Rounds after which documents without a place are an error; each places at least one length.
MAX_ROUNDS = 400


def token_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut where they exceed a sequence.

    Only ids of a few texts are held.  Null and empty texts are one piece of the end id.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids(path)
        for batch in few(batches):
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            who, piece, start, length, crc = [], [], [], [], []
            for i, raw in enumerate(encoder.packed(texts)):
                raw += end
                for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    who.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


# --- a round -------------------------------------------------------------------

#: Rows of a sweep's result.
PLACED, DOC, GAP = 0, 1, 2
_SWEPT = "kind int, id bigint, size int, part int, idx bigint, seq bigint, at int"


def _sweep(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Best fit inside one range, whose documents come longest first.

    Rows: PLACED (id, length, seq, at), DOC (id, length) and GAP (seq, size); documents
    and gaps are numbered within their size.
    """
    sizes, kinds, ids = [], [], []
    for b in batches:
        sizes.append(b.column("size").to_numpy())
        kinds.append(b.column("kind").to_numpy())
        ids.append(b.column("id").to_numpy())
    if not sizes:
        return
    size, kind, who = (np.concatenate(x) for x in (sizes, kinds, ids))
    is_gap = kind == GAP
    gaps = sorted(zip(size[is_gap].tolist(), who[is_gap].tolist()))
    placed, docs = [], []
    for length, doc in zip(size[~is_gap].tolist(), who[~is_gap].tolist()):
        at = bisect.bisect_left(gaps, (length, -1 << 63))
        if at == len(gaps):
            docs.append((length, doc))
            continue
        free, seq = gaps.pop(at)
        placed.append((doc, length, seq, capacity - free))
        if free > length:
            bisect.insort(gaps, (free - length, seq))
    part = TaskContext.get().partitionId()

    def numbered(rows: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
        """Sizes, ids and number within the size of rows sorted by size, either way."""
        s, w = np.array(rows, dtype=np.int64).reshape(-1, 2).T
        first = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
        begins = np.flatnonzero(first)
        return s, w, np.arange(len(s)) - np.repeat(begins, np.diff(np.r_[begins, len(s)]))

    for k, rows in ((DOC, docs), (GAP, gaps)):
        s, w, idx = numbered(rows)
        n = len(s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, k, np.int32)), pa.array(w), pa.array(s.astype(np.int32)),
             pa.array(np.full(n, part, np.int32)), pa.array(idx), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())],
            ["kind", "id", "size", "part", "idx", "seq", "at"],
        )
    d, s, q, at = np.array(placed, dtype=np.int64).reshape(-1, 4).T
    n = len(d)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, PLACED, np.int32)), pa.array(d), pa.array(s.astype(np.int32)), pa.array(np.full(n, part, np.int32)),
         pa.nulls(n, pa.int64()), pa.array(q), pa.array(at.astype(np.int32))],
        ["kind", "id", "size", "part", "idx", "seq", "at"],
    )


def carry(docs: dict[int, int], gaps: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """What a round does with the documents and gaps that the sweeps left, from how many there are of each size.

    Rows (length, first, count, each, size, first gap): ``count`` documents of that length from
    rank ``first`` go, ``each`` to a gap, into gaps of that size from rank ``first gap`` on.  Size
    capacity + 1 stands for sequences not yet open; the second result is how many get opened.
    No gap is used by two rows.  At most two numbers per possible size come in.
    """
    left, taken, rows = dict(docs), dict.fromkeys(gaps, 0), []
    open_sizes = sorted(gaps)
    for length in sorted(docs, reverse=True):
        at = bisect.bisect_left(open_sizes, length)
        while left[length] and at < len(open_sizes):
            size = open_sizes[at]
            each, free = size // length, gaps[size] - taken[size]
            used = min(free, -(-left[length] // each))
            count = min(left[length], used * each)
            rows.append((length, docs[length] - left[length], count, each, size, taken[size]))
            left[length] -= count
            taken[size] += used
            if taken[size] == gaps[size]:
                open_sizes.pop(at)
    rest = sorted((s for s, n in left.items() if n), reverse=True)
    if not rest:
        return rows, 0
    top = capacity // rest[0]
    if top < BY_VOLUME:
        band = [s for s in rest if capacity // s == top]
        opened, each = -(-sum(left[s] for s in band) // top), top
    else:
        # What the placed documents leave: every gap is then full or smaller.
        space = sum(s * n for s, n in gaps.items()) - sum(r[0] * r[2] for r in rows)
        volume = sum(s * left[s] for s in rest) - space
        band, opened, each = rest, max(1, -(-volume // capacity)), 1
    used = 0
    for length in band:
        count = min(left[length], (opened - used) * each)
        if count <= 0:
            break
        rows.append((length, docs[length] - left[length], count, each, capacity + 1, used))
        used += -(-count // each)
    return rows, used


def _assign(batches: Iterator[pa.RecordBatch], rows: list[tuple[int, ...]], fresh: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Documents with the gap that the carried plan gives them, as (size, rank) of it, or none.

    Places in sequences that open now are known at once.  ``last`` marks the last document that a gap gets.
    """
    plan = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    wide = 1 << 48
    begins = plan[:, 0] * wide + plan[:, 1]
    for batch in batches:
        length = batch.column("size").to_numpy().astype(np.int64)
        rank = batch.column("rank").to_numpy()
        row = np.searchsorted(begins, length * wide + rank, side="right") - 1
        hit = row >= 0
        if len(plan):
            r = plan[np.maximum(row, 0)]
            hit &= (r[:, 0] == length) & (rank < r[:, 1] + r[:, 2])
        else:
            r = np.ones((len(length), 6), dtype=np.int64)
        t = rank - r[:, 1]
        pos = t % r[:, 3]
        last = hit & ((pos == r[:, 3] - 1) | (t == r[:, 2] - 1))
        new = hit & (r[:, 4] == capacity + 1)
        gap = r[:, 5] + t // r[:, 3]
        at = np.where(new, 0, capacity - r[:, 4]) + pos * length
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("size"), pa.array(r[:, 4].astype(np.int32), mask=~hit | new),
             pa.array(gap, mask=~hit | new), pa.array(at.astype(np.int32), mask=~hit), pa.array(last),
             pa.array(fresh + gap, mask=~new)],
            ["id", "size", "gap_size", "gap_rank", "at", "last", "seq"],
        )


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id, seq, at): a sequence and a place in it for every row of ``pieces`` (id bigint, length below ``capacity``).

    Sequences are numbered from 0 and gapless.  The driver gets one number per
    document length and gap size in each round: at most two times ``capacity`` numbers.
    """
    spark = pieces.sparkSession
    root = shared_dir(spark)
    docs = pieces.select(F.lit(DOC).alias("kind"), F.col("id"), F.col("length").cast("int").alias("size"))
    state, done, fresh = docs, [], 0
    rows = docs.count()
    for _ in range(MAX_ROUNDS):
        if not rows:
            break
        ranges = max(1, -(-rows // range_rows))
        swept = stored(
            state.repartitionByRange(ranges, F.col("size").desc(), F.col("kind").desc(), "id")
            .sortWithinPartitions(F.col("size").desc(), F.col("kind").desc(), "id")
            .mapInArrow(lambda b: _sweep(b, capacity), _SWEPT),
            "swept",
        )
        done.append(swept.filter(F.col("kind") == PLACED).select("id", "seq", "at"))
        counts = swept.filter(F.col("kind") != PLACED).groupBy("kind", "size", "part").agg(F.count(F.lit(1)).alias("n"))
        totals: dict[int, dict[int, int]] = {DOC: {}, GAP: {}}
        for r in counts.groupBy("kind", "size").agg(F.sum("n").alias("n")).collect():
            totals[r["kind"]][r["size"]] = r["n"]
        if not totals[DOC]:
            return _union(done)
        plan, opened = carry(totals[DOC], totals[GAP], capacity)
        before = Window.partitionBy("kind", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        ranked = (
            swept.filter(F.col("kind") != PLACED).join(offsets, ["kind", "size", "part"])
            .select("kind", "id", "size", (F.col("off") + F.col("idx")).alias("rank"))
        )
        given = ranked.filter(F.col("kind") == DOC).select("id", "size", "rank").mapInArrow(
            lambda b, plan=plan, fresh=fresh: _assign(b, plan, fresh, capacity),
            "id bigint, size int, gap_size int, gap_rank bigint, at int, last boolean, seq bigint",
        )
        given = stored(given, "given")
        gaps = ranked.filter(F.col("kind") == GAP).select(
            F.col("id").alias("gap"), F.col("size").alias("gap_size"), F.col("rank").alias("gap_rank")
        )
        known = given.filter("gap_rank IS NOT NULL").drop("seq").join(gaps, ["gap_size", "gap_rank"], "full_outer")
        met = stored(known, "met")
        fresh += opened
        both = met.filter("id IS NOT NULL").select("id", "size", "at", "last", F.col("gap").alias("seq")).unionByName(
            given.filter("seq IS NOT NULL").select("id", "size", "at", "last", "seq")
        )
        done.append(both.select("id", "seq", "at"))
        waiting = given.filter("gap_rank IS NULL AND seq IS NULL").select(F.lit(DOC).alias("kind"), "id", "size")
        spare = met.filter("id IS NULL").select(F.lit(GAP).alias("kind"), F.col("gap").alias("id"), F.col("gap_size").alias("size"))
        changed = both.filter("last").select(
            F.lit(GAP).alias("kind"), F.col("seq").alias("id"), (F.lit(capacity) - F.col("at") - F.col("size")).alias("size")
        )
        placed = {s: 0 for s in totals[DOC]}
        for r in plan:
            placed[r[0]] += r[2]
        shortest = min((s for s, n in totals[DOC].items() if n > placed[s]), default=None)
        if shortest is None:
            return _union(done)
        # Gaps that hold no waiting document are full.
        state = waiting.unionByName(spare.unionByName(changed).filter(F.col("size") >= shortest))
        rows = sum(n - placed[s] for s, n in totals[DOC].items()) + sum(totals[GAP].values()) + opened
    if rows:
        raise RuntimeError(f"documents are left without a sequence after {MAX_ROUNDS} rounds (see {root})")
    return spark.createDataFrame([], "id bigint, seq bigint, at int")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def packed(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``.

    A document is its ids by the tokenizer file and the end id; one longer than
    ``capacity`` is cut into full pieces and a rest.  A full piece is a sequence of its own, with a
    negative number.  Null and empty texts are the end id alone.  Rows that repeat a doc_id are
    documents of their own, a null doc_id stays null, other columns are ignored, and an empty table gives no rows.
    """
    key = free_name(docs, "_piece")
    cut = stored(
        token_pieces(docs, path, doc_id, text, capacity).withColumn(key, F.monotonically_increasing_id()), "pieces"
    )
    short = cut.filter(F.col("length") < capacity)
    places = best_fit(short.select(F.col(key).alias("id"), "length"), capacity, range_rows)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    fitted = short.join(places, short[key] == places["id"]).select(
        *names, F.col("seq").alias("sequence_id"), F.col("at").cast("bigint").alias("offset")
    )
    whole = cut.filter(F.col("length") == capacity).select(
        *names, (-1 - F.col(key)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return fitted.unionByName(whole).withColumnRenamed("doc_id", doc_id)
