"""Ranked lexical search by pipelined term owners.

Every query term has one owner; terms are dealt to owners by document frequency, rare ones
first.  Items travel in bundles, one bundle for every block of documents, through the owners
one after the other.  At an owner a bundle meets the postings of its block (a cogroup), adds
their integer contributions to its accumulators, which are sparse (only documents met so
far), and goes on to the next owner.  Behind the last owner every bundle selects its
best documents, and the blocks' selections are merged.

Frequent terms come last, so accumulators that travel are few: the longest posting lists only
add to them where they are selected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armscope.llm.common import Rounds, stored

#: Results per item, owners, items of a bundle, documents of a block.
TOP, OWNERS, BUNDLE, BLOCK_BITS = 50, 3, 256, 10

#: Bytes that part terms become spaces, A-Z become lower case; bytes of other alphabets stay.
_FOLD = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
#: Bytes of a text that are cut into terms at a time, and rows of a batch of terms.
_STEP, _ROWS = 1 << 22, 65_536


def terms(raw: bytes) -> Counter[bytes]:
    """Terms of a UTF-8 text and how often each occurs: runs of ASCII letters and digits and of all other alphabets."""
    folded = raw.translate(_FOLD)
    if len(folded) <= _STEP:
        return Counter(folded.split())
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + _STEP)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end
    return found


def _with_terms(rows: DataFrame, keys: list[str], text: str, whole: bool) -> DataFrame:
    """(*keys, n, term, tf): the distinct terms of every row; with ``whole`` also a row with an empty term for each that has terms."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, sizes, names, times = [], [], [], []

            def taken() -> pa.RecordBatch:
                at = pa.array(who, pa.int64())
                out = [batch.column(i).take(at) for i in range(len(keys))]
                out += [pa.array(sizes, pa.int64()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())]
                for x in (who, sizes, names, times):
                    x.clear()
                return pa.RecordBatch.from_arrays(out, [*keys, "n", "term", "tf"])

            for i, raw in enumerate(batch.column(len(keys)).cast(pa.binary()).to_pylist()):
                found = terms(raw) if raw else {}
                if not found:
                    continue
                n = sum(found.values())
                if whole:
                    found[b""] = n
                who += [i] * len(found)
                sizes += [n] * len(found)
                names += found.keys()
                times += found.values()
                if len(who) > _ROWS:
                    yield taken()
            if who:
                yield taken()

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, F.col(text).cast("string").alias("text")).mapInArrow(
        cut, f"{kinds}, n bigint, term string, tf bigint"
    )


def _gathered(state: pa.Table, postings: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(documents, accumulators by item and document): contributions of one owner added up for one bundle.

    Rows of ``state`` are items with ``terms`` (of this owner), ``docs`` and ``scores``.
    """
    tid, key, add = (postings.column(c).to_numpy() for c in ("tid", "key", "add"))
    order = np.argsort(tid, kind="stable")
    tid, key, add = tid[order], key[order], add[order]
    before = state.column("docs").combine_chunks()
    known = before.flatten().to_numpy(zero_copy_only=False)
    docs = np.unique(np.concatenate([key, known]))
    place, known_place = np.searchsorted(docs, key), np.searchsorted(docs, known)
    scores = state.column("scores").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(before), 0).to_numpy())
    sums = np.zeros((state.num_rows, len(docs)), dtype=np.int64)
    for i, wanted in enumerate(state.column("terms").to_pylist()):
        line = sums[i]
        s = slice(ends[i - 1] if i else 0, ends[i])
        line[known_place[s]] = scores[s]
        lo = np.searchsorted(tid, wanted or [], side="left")
        hi = np.searchsorted(tid, wanted or [], side="right")
        for a, b in zip(lo.tolist(), hi.tolist()):
            line[place[a:b]] += add[a:b]  # a term has one posting per document
    return docs, sums


def _stage(state: pa.Table, postings: pa.Table) -> pa.Table:
    """A bundle goes through one owner: its items with the accumulators as they are now."""
    if not state.num_rows:
        return _STATE.empty_table()
    docs, sums = _gathered(state, postings)
    full = sums > 0
    lengths = np.r_[0, np.cumsum(full.sum(axis=1))].astype(np.int32)
    where = np.nonzero(full)[1]
    lists = [pa.ListArray.from_arrays(pa.array(lengths), pa.array(x)) for x in (docs[where], sums[full])]
    return pa.Table.from_arrays([state.column("item"), state.column("bundle"), state.column("block"), *lists], schema=_STATE)


_STATE = pa.schema([
    ("item", pa.int64()), ("bundle", pa.int64()), ("block", pa.int64()),
    ("docs", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64())),
])
_STATE_DDL = "item bigint, bundle bigint, block bigint, docs array<bigint>, scores array<bigint>"


def _select(state: pa.Table, postings: pa.Table, top: int) -> pa.Table:
    """Behind the last owner: every item's best documents of the block; with equal scores all that may count."""
    empty = pa.schema([("item", pa.int64()), ("key", pa.int64()), ("score", pa.int64())])
    if not state.num_rows:
        return empty.empty_table()
    docs, sums = _gathered(state, postings)
    items = state.column("item").to_numpy()
    out_item, out_key, out_score = [], [], []
    for i in range(len(items)):
        line = sums[i]
        hit = np.flatnonzero(line > 0)
        if len(hit) > top:
            least = np.partition(line[hit], len(hit) - top)[len(hit) - top]
            hit = hit[line[hit] >= least]
        out_item.append(np.full(len(hit), items[i]))
        out_key.append(docs[hit])
        out_score.append(line[hit])
    return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in (out_item, out_key, out_score)], schema=empty)


def ranked(
    items: DataFrame, docs: DataFrame, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id",
    doc_text: str = "text", top: int = TOP, owners: int = OWNERS, bundle: int = BUNDLE, block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents with a score above 0 for every row of ``items``.

    Terms are runs of ASCII letters and digits and of any other characters beyond ASCII, with A-Z lower-cased;
    null and empty texts have none.  The weights are those of BM25 in whole numbers: a term of df documents weighs
    floor(1000 ln((2N+2)/(2df+1))), and tf occurrences in a document of n terms add
    weight * (10^9 tf div (1000 tf + 20 m)), m = 50 + (50 n N) div L.  Equal scores are ranked by ascending doc_id,
    nulls last.  Rows that repeat an id are items or documents of their own; other columns are ignored; an
    empty table gives no rows.

    A document is counted once with its length beside its postings, under an empty term.  A block
    holds 2^block_bits neighbouring rows of one partition of ``docs`` at most, a bundle about ``bundle`` items.
    Statistics that come to the driver: two sums, and the frequencies at which owners part.
    """
    asked = stored(
        items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
        .withColumn("item", F.monotonically_increasing_id()), "items",
    )
    bundles = max(1, -(-asked.count() // bundle))
    item_terms = stored(
        _with_terms(asked, ["item"], "text", False)
        .select("item", "term", F.pmod(F.xxhash64("item"), F.lit(bundles)).alias("bundle")), "item_terms",
    )
    vocabulary = stored(
        item_terms.select("term").distinct().withColumn("tid", F.monotonically_increasing_id())
        .unionByName(items.sparkSession.createDataFrame([("", -1)], "term string, tid bigint")),
        "vocabulary",
    )
    # The number of a row is written beside its postings, so it is the same wherever it is read.
    numbered = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).withColumn(
        "key", F.monotonically_increasing_id()
    )
    found = _with_terms(numbered, ["key", "doc_id"], "text", True)
    postings = stored(found.join(vocabulary, "term").select("key", "doc_id", "n", "tid", "tf"), "postings")
    total = postings.filter("tid = -1").agg(F.count(F.lit(1)), F.sum("n")).first()
    n_docs, n_terms = total[0], total[1] or 1
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    weights = stored(
        postings.filter("tid >= 0").groupBy("tid").agg(F.count(F.lit(1)).alias("df")).withColumn("w", weight), "weights"
    )
    bounds = _bounds(weights, owners)
    owner = sum((F.col("df") > b).cast("int") for b in bounds) if bounds else F.lit(0)
    owned = weights.filter("w > 0").select("tid", "w", owner.alias("owner"))
    routes = stored(
        item_terms.join(vocabulary, "term").join(owned, "tid")
        .groupBy("owner", "item", "bundle").agg(F.sort_array(F.collect_list("tid")).alias("terms")), "routes",
    )
    m = F.expr(f"50 + (50L * n * {n_docs}L) div {n_terms}L")
    lists = postings.withColumns({"m": m, "block": F.shiftright("key", block_bits)})
    contribution = F.expr("w * ((1000000000L * tf) div (1000L * tf + 20L * m))")
    in_bundles = item_terms.join(vocabulary, "term").select("tid", "bundle").distinct()
    spark = items.sparkSession
    rounds = Rounds(spark, "accumulators")
    state = spark.createDataFrame([], _STATE_DDL)
    for stage in range(owners):
        mine = in_bundles.join(owned.filter(F.col("owner") == stage).drop("owner"), "tid")
        here = lists.join(mine, "tid").select("bundle", "block", "tid", "key", contribution.alias("add")).filter("add > 0")
        here = stored(here, "owner")
        coming = here.select("bundle", "block").distinct().join(
            routes.filter(F.col("owner") == stage).select("bundle", "item", "terms"), "bundle"
        )
        arrived = state.join(coming, ["item", "bundle", "block"], "full_outer")
        pair = arrived.groupBy("bundle", "block").cogroup(here.groupBy("bundle", "block"))
        if stage < owners - 1:
            state = rounds.put(pair.applyInArrow(_stage, _STATE_DDL))
        else:
            best = stored(
                pair.applyInArrow(lambda a, b: _select(a, b, top), "item bigint, key bigint, score bigint"), "best"
            )
    ids = postings.filter("tid = -1").select("key", "doc_id")
    return _merged(best, ids, asked.select("item", "item_id"), top).select(
        F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score"
    )


def _bounds(weights: DataFrame, owners: int) -> list[int]:
    """Document frequencies after which the next owner begins; each owner holds about as many terms."""
    shares = [(i + 1) / owners for i in range(owners - 1)]
    if not shares:
        return []
    return list(weights.agg(F.percentile_approx("df", shares, 10_000)).first()[0] or [])


def _merged(best: DataFrame, ids: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """The blocks' selections as one ranking per item; a task keeps ``top`` rows of an item before anything is dealt."""
    named = best.join(ids, "key")
    first = Window.partitionBy("item", F.pmod("key", F.lit(64))).orderBy(
        F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "key"
    )
    last = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "key")
    few = named.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= top).drop("r")
    few = few.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top)
    return few.join(asked, "item")
