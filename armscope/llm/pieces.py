"""Encoding with the pieces of a SentencePiece model: best and n-best segmentations, and decoding.

A text's lattice has an edge for every piece that matches at a place.  Forward
Viterbi gives every place the score of the best way to it.  The n best ways are
then found backwards from the end by A-star search, for which these forward
scores are an exact estimate of what is still to come.

No piece crosses from another character to a space, and line breaks are in no
piece, so a text's lattice is a chain of its words' lattices.  Forward and
backward scores run in NumPy over the distinct words of a group of texts at once.
The best way through a word that avoids an edge of its best way costs some loss;
a text's n best ways differ from its best only in the n-1 words of least loss,
so the search runs over those words alone and stays exact.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.llm.common import free_name

SPACE = "▁"
#: Segmentations per text.
N_BEST = 3
#: Code points of the texts that one step handles together.
GROUP = 3_000_000
#: Scores are held as whole numbers, so ways of equal score tie exactly: this many to 1.
SCALE = 1 << 20
#: Score of a place that nothing leads to.
NOWHERE = -(1 << 60)
#: A character without a piece scores this much less than the rarest piece.
UNKNOWN_LOSS = 10.0
#: Solved words that a worker remembers; beyond them it starts anew.
REMEMBERED = 400_000
#: Words longer than this, and those with an unknown character, are solved one by one.
LONGEST = 48


Way = tuple[float, int, int, list[int]]


class PieceModel:
    """Pieces and scores of a model file.

    A BPE model's score is minus the piece's rank, which cannot be summed like a log
    probability.  It is read as Zipf's law, p ~ 1 / rank.  The scores of a
    unigram model are log probabilities and taken as they are.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        raw = {i: model.get_score(i) for i in plain}
        if all(float(s).is_integer() for s in raw.values()):
            last = max(-s for s in raw.values() if s > -1e8) + 1
            norm = float(np.log(np.sum(1.0 / np.arange(1, last + 2))))
            score = {i: -float(np.log(min(max(-s, 0) + 1, last + 1))) - norm for i, s in raw.items()}
        else:
            score = raw
        self.ids = {self.pieces[i]: (i, round(score[i] * SCALE)) for i in plain}
        self.unknown = round((min(score.values()) - UNKNOWN_LOSS) * SCALE)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unk_id = model.unk_id()
        self.prefix = bool(model.encode("a", out_type=str)[0].startswith(SPACE))
        self.longest = max(map(len, self.ids))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in self.ids):
            raise ValueError("the model has pieces that cross a space or a line break")
        self._trie()
        self._forget()
        self.decoded = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i)
            else (" ⁇ " if model.is_unknown(i) else p.replace(SPACE, " ")).encode()
            for i, p in enumerate(self.pieces)
        ]

    def _trie(self) -> None:
        """Trie of the pieces: a hash table of parent * 2^21 + character, with linear probing."""
        nodes: dict[str, int] = {"": 0}
        for piece in sorted(self.ids):
            for k in range(1, len(piece) + 1):
                nodes.setdefault(piece[:k], len(nodes))
        keys = {(nodes[s[:-1]] << 21) + ord(s[-1]): n for s, n in nodes.items() if s}
        bits = int(4 * len(keys)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_node = np.zeros(1 << bits, dtype=np.int64)
        for key, node in keys.items():
            at = int(self._slot(np.array([key]))[0])
            while self.slot_key[at] >= 0:
                at = (at + 1) & (len(self.slot_key) - 1)
            self.slot_key[at], self.slot_node[at] = key, node
        self.node_id = np.full(len(nodes), -1, dtype=np.int64)
        self.node_score = np.full(len(nodes), NOWHERE, dtype=np.int64)
        for piece, (i, s) in self.ids.items():
            self.node_id[nodes[piece]], self.node_score[nodes[piece]] = i, s

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _children(self, keys: np.ndarray) -> np.ndarray:
        """Child node per key, 0 where there is none."""
        at = self._slot(keys)
        seen = self.slot_key[at]
        found = np.where(seen == keys, self.slot_node[at], 0)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slot_key) - 1)
            seen = self.slot_key[at[left]]
            hit = seen == keys[left]
            found[left[hit]] = self.slot_node[at[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return found

    def units(self, text: str) -> list[str]:
        """The words of a text with the spaces before them, and its line breaks."""
        if not text:
            return []
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return re.findall(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+", text)

    def fallback(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        if not self.bytes:
            return [self.unk_id]
        return [self.bytes[b] for b in char.encode("utf-8", "replace")]

    # --- one word ------------------------------------------------------------------

    def lattice(self, word: str) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
        """Edges (start, score, id or -1) into every place, and the forward Viterbi scores."""
        n = len(word)
        into: list[list[tuple[int, int, int]]] = [[] for _ in range(n + 1)]
        ahead = [NOWHERE] * (n + 1)
        ahead[0] = 0
        for i in range(n):
            known = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                hit = self.ids.get(word[i:j])
                if hit:
                    known |= j == i + 1
                    into[j].append((i, hit[1], hit[0]))
                    ahead[j] = max(ahead[j], ahead[i] + hit[1])
            if not known:
                into[i + 1].append((i, self.unknown, -1))
                ahead[i + 1] = max(ahead[i + 1], ahead[i] + self.unknown)
        return into, ahead

    def n_best(self, word: str, n: int) -> list[tuple[int, list[int]]]:
        """The n best segmentations of a word, best first: (score, ids).

        Of equal estimates the latest goes first, so every way is followed straight
        to the start: a search pops as many places as its ways have pieces.
        """
        into, ahead = self.lattice(word)
        tie = count(0, -1)
        heap = [(-ahead[-1], next(tie), len(word), 0, None)]
        found = []
        while heap and len(found) < n:
            _, _, place, behind, path = heapq.heappop(heap)
            if place == 0:
                ids: list[int] = []
                while path is not None:
                    start, piece, path = path
                    ids += self.fallback(word[start]) if piece < 0 else [piece]
                found.append((behind, ids))
                continue
            for start, score, piece in into[place]:
                total = behind + score
                heapq.heappush(heap, (-(ahead[start] + total), next(tie), start, total, (start, piece, path)))
        return found

    # --- many words ----------------------------------------------------------------

    def solve(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Best ways through distinct words: starts and lengths in flat ids, ids, scores, loss of the second best."""
        lengths = np.zeros(len(words), dtype=np.int64)
        scores, loss = np.zeros(len(words), dtype=np.int64), np.full(len(words), -NOWHERE)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        by_size = np.argsort(sizes, kind="stable")
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # words in the order of their ids, and those ids
        alone = by_size[(sizes[by_size] == 1) | (sizes[by_size] > LONGEST)].tolist()
        for group in np.split(by_size, np.flatnonzero(np.diff(sizes[by_size])) + 1):
            if not len(group) or not 1 < sizes[group[0]] <= LONGEST:
                continue
            joined = "".join([words[k] for k in group.tolist()]).encode("utf-32-le", "surrogatepass")
            chars = np.frombuffer(joined, dtype="<u4").reshape(len(group), -1).astype(np.int64)
            known, counts, flat, best, lost = self._solve_equal(chars)
            alone += group[~known].tolist()
            lengths[group], scores[group], loss[group] = counts, best, lost
            parts.append((group[known], flat))
        for k in alone:
            ways = self.n_best(words[k], 2)
            lengths[k], scores[k] = len(ways[0][1]), ways[0][0]
            parts.append((np.array([k]), np.array(ways[0][1], dtype=np.int32)))
            loss[k] = ways[0][0] - ways[1][0] if len(ways) > 1 else -NOWHERE
        starts = np.zeros(len(words), dtype=np.int64)
        if parts:
            order = np.concatenate([p[0] for p in parts])
            starts[order] = np.cumsum(lengths[order]) - lengths[order]
        flat = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int32)
        return starts, lengths, flat.astype(np.int32), scores, loss

    def _solve_equal(self, chars: np.ndarray) -> tuple[np.ndarray, ...]:
        """Words of one length at once: known (no unknown character), counts and flat ids of the known, scores, losses."""
        n, size = chars.shape
        columns = np.ascontiguousarray(chars.T)
        ahead = np.full((size + 1, n), NOWHERE)
        ahead[0] = 0
        came = np.zeros((size + 1, n), dtype=np.int64)
        piece = np.full((size + 1, n), -1, dtype=np.int64)
        edges = []
        known = np.ones(n, dtype=bool)
        for i in range(size):
            rows, node = np.arange(n), np.zeros(n, dtype=np.int64)
            for j in range(i + 1, min(size, i + self.longest) + 1):
                node = self._children((node << 21) + columns[j - 1][rows])
                ok = node > 0
                rows, node = rows[ok], node[ok]
                ids = self.node_id[node]
                end = ids >= 0
                r, s, d = rows[end], self.node_score[node[end]], ids[end]
                if j == i + 1:
                    single = np.zeros(n, dtype=bool)
                    single[r] = True
                    known &= single
                if not len(rows):
                    break
                if len(r):
                    total = ahead[i, r] + s
                    better = total > ahead[j, r]
                    rb = r[better]
                    ahead[j, rb], came[j, rb], piece[j, rb] = total[better], i, d[better]
                    edges.append((i, j, r, s))
        behind = np.full((size + 1, n), NOWHERE)
        behind[size] = 0
        for i, j, r, s in reversed(edges):
            behind[i, r] = np.maximum(behind[i, r], s + behind[j, r])
        # Walk the best ways back, all words in step.
        used = np.zeros((size + 1, n), dtype=bool)
        place, rows, steps = np.full(n, size), np.flatnonzero(known), []
        while len(rows):
            p = place[rows]
            used[p, rows] = True
            steps.append((rows, piece[p, rows]))
            place[rows] = came[p, rows]
            rows = rows[place[rows] > 0]
        second = np.full(n, NOWHERE)
        for i, j, r, s in edges:
            off = ~(used[j, r] & (came[j, r] == i))
            ro = r[off]
            second[ro] = np.maximum(second[ro], ahead[i, ro] + s[off] + behind[j, ro])
        counts = np.zeros(n, dtype=np.int64)
        for rows, _ in steps:
            counts[rows] += 1
        ends = np.cumsum(counts)
        flat = np.zeros(int(counts.sum()), dtype=np.int32)
        for k, (rows, d) in enumerate(steps):
            flat[ends[rows] - 1 - k] = d
        lost = np.where(second > NOWHERE // 2, ahead[size] - second, -NOWHERE)
        return known, counts, flat, ahead[size], lost

    # --- many texts ----------------------------------------------------------------

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.words: list[str] = []
        self.starts = self.lengths = self.scores = self.loss = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Places of distinct words in the tables of solved words; new words are solved first."""
        if len(self.index) + len(words) > REMEMBERED:
            self._forget()
        new = [w for w in words if w not in self.index]
        if new:
            starts, lengths, flat, scores, loss = self.solve(new)
            self.index.update(zip(new, range(len(self.words), len(self.words) + len(new))))
            self.words += new
            self.starts = np.concatenate([self.starts, starts + len(self.flat)])
            self.lengths, self.flat = np.concatenate([self.lengths, lengths]), np.concatenate([self.flat, flat])
            self.scores, self.loss = np.concatenate([self.scores, scores]), np.concatenate([self.loss, loss])
        index = self.index
        return np.fromiter((index[w] for w in words), dtype=np.int64, count=len(words))

    def encode(self, texts: list[str], n: int = N_BEST) -> Iterator[tuple[np.ndarray, float, list[Way]]]:
        """Per text its best ids, their score, and the next n-1 ways: (score, start, stop, ids for that range)."""
        words = [self.units(t) for t in texts]
        flat = np.empty(sum(map(len, words)), dtype=object)
        flat[:] = [w for u in words for w in u]
        codes, distinct = pd.factorize(flat)
        codes = self._learn(list(distinct))[codes] if len(distinct) else codes
        starts, lengths, ids, scores, loss = self.starts, self.lengths, self.flat, self.scores, self.loss
        known = self.words
        ways = lru_cache(maxsize=100_000)(lambda c: self.n_best(known[c], n))
        at = 0
        for u in words:
            c = codes[at : at + len(u)]
            at += len(u)
            size = lengths[c]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(c) else 0
            out = ids[np.repeat(starts[c] - (ends - size), size) + np.arange(total)] if total else np.zeros(0, np.int32)
            score = int(scores[c].sum())
            yield out, score / SCALE, self._others(c, out, ends - size, ends, loss, score, ways, n)

    def _others(self, c, out, begins, ends, loss, score, ways, n) -> list[Way]:
        """The 2nd to n-th best ways of a text, over its n-1 words of least loss."""
        mine = loss[c]
        few = min(n - 1, int((mine < -NOWHERE).sum()))
        if few <= 0:
            return []
        if few < len(mine):
            border = np.partition(mine, few - 1)[few - 1]
            pick = np.r_[np.flatnonzero(mine < border), np.flatnonzero(mine == border)][:few]
        else:
            pick = np.flatnonzero(mine < -NOWHERE)
        best: list[tuple[int, tuple[tuple[int, int], ...]]] = [(0, ())]
        for w in sorted(pick.tolist()):
            options = ways(int(c[w]))
            best = heapq.nsmallest(n, (
                (cost + options[0][0] - s, taken + (((w, k),) if k else ()))
                for cost, taken in best for k, (s, _) in enumerate(options)
            ))
        found = []
        for cost, taken in best[1:]:
            start, stop, ids = int(begins[taken[0][0]]), int(ends[taken[-1][0]]), []
            at = start
            for w, k in taken:
                ids += out[at : begins[w]].tolist() + ways(int(c[w]))[k][1]
                at = ends[w]
            found.append(((score - cost) / SCALE, start, stop, ids))
        return found

    def decode(self, ids) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join([self.decoded[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


WAY = pa.list_(pa.struct([("score", pa.float64()), ("start", pa.int32()), ("stop", pa.int32()), ("ids", pa.list_(pa.int32()))]))
ADDED = {
    "piece_ids": "array<int>", "n_pieces": "bigint", "score": "double",
    "others": "array<struct<score:double,start:int,stop:int,ids:array<int>>>", "round_trip": "boolean",
}


def _groups(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` code points together."""
    begin = total = 0
    for k, t in enumerate(texts):
        total += len(t)
        if total > size:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, n_best: int) -> Iterator[pa.RecordBatch]:
    """The columns before the last, which is the text, and those of ADDED; small batches out of any batch."""
    model = piece_model(path)
    for batch in batches:
        values = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        for begin, end in _groups(values, GROUP):
            rows = list(model.encode(values[begin:end], n_best))
            counts = np.array([len(r[0]) for r in rows], dtype=np.int64)
            offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
            others = [[{"score": s, "start": a, "stop": b, "ids": i} for s, a, b, i in r[2]] for r in rows]
            same = [model.decode(r[0].tolist()) == t for r, t in zip(rows, values[begin:end])]
            kept = [batch.column(k).slice(begin, end - begin) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *kept, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[0] for r in rows]), pa.int32())),
                    pa.array(counts), pa.array([r[1] for r in rows], pa.float64()), pa.array(others, WAY), pa.array(same),
                ],
                [*batch.schema.names[:-1], *ADDED],
            )


def decoded(ids: Column, path: str) -> Column:
    """Text of a column of id arrays; a null array gives null."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = piece_model(path)
        for rows in batches:
            yield pd.Series([None if r is None else model.decode(r) for r in rows], dtype=object)

    return texts(ids)


def with_pieces(docs: DataFrame, path: str, text: str = "text", n_best: int = N_BEST, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (by default all) plus piece_ids, n_pieces, score, others and round_trip.

    ``others`` holds the 2nd to n-th best segmentation as the range of piece_ids that
    it replaces and the ids for it.  round_trip: decoding gives the text again,
    which the mark U+2581 inside a text prevents.  Null and empty texts have no
    pieces, score 0 and other ways none.  Rows are on their own: repeated rows give
    equal results, ties go to the longer first piece, an empty table gives no rows.
    Columns of ``docs`` with the added names are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    rows = docs.select(*kept, F.col(text).alias(free_name(docs, "_text")))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    schema = ", ".join([*types, *(f"{n} {t}" for n, t in ADDED.items())])
    return rows.mapInArrow(lambda batches: _encoded(batches, path, n_best), schema)


def n_best_rows(encoded_docs: DataFrame, key: str) -> DataFrame:
    """(key, rank, score, ids): one row per segmentation, from the columns of ``with_pieces``."""
    best = F.struct(F.col("score").alias("score"), F.lit(0).alias("start"), F.size("piece_ids").alias("stop"), F.col("piece_ids").alias("ids"))
    ways = encoded_docs.select(key, "piece_ids", F.posexplode(F.concat(F.array(best), F.col("others"))).alias("rank", "w"))
    ids = F.concat(
        F.slice("piece_ids", F.lit(1), F.col("w.start")), F.col("w.ids"),
        F.slice("piece_ids", F.col("w.stop") + 1, F.size("piece_ids")),
    )
    return ways.select(key, (F.col("rank") + 1).alias("rank"), F.col("w.score").alias("score"), ids.alias("ids"))
