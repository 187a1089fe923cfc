"""Token counts of whole texts, exact also for texts that are encoded in chunks.

A huge text is cut into overlapping chunks that are encoded with offsets.  Two
neighbouring chunks are spliced at a boundary that both encodings share and
that no piece of the vocabulary can cross, so what stands before and after it
is encoded independently.  Where the overlap has no such boundary it is
widened until it has one or the chunk reaches the end of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points that a chunk holds, and that two neighbours share at first.
CHUNK, OVERLAP = 32_768, 256

#: A place where one space stands between two characters that are no white space.
_PLACE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


class Encoder:
    """One tokenizer file: token counts, and token starts as code point offsets.

    ``.model`` files are read by sentencepiece, ``.json`` files by tokenizers.
    No begin, end or other special token is added.
    """

    def __init__(self, path: str):
        self.pieces = path.endswith(".model")
        if self.pieces:
            from sentencepiece import SentencePieceProcessor

            self.model = SentencePieceProcessor(model_file=path)
            vocabulary = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
            self.safe = not any(re.search("[^▁]▁", p) for p in vocabulary)
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            # A space that starts a word is where every pre-tokenizer here cuts.
            self.safe = self.model.pre_tokenizer is not None

    def counts(self, texts: list[str]) -> list[int]:
        if self.pieces:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def starts(self, text: str) -> list[int]:
        """Code point offset at which every token starts, not decreasing."""
        if not self.pieces:
            return [a for a, _ in self.model.encode(text, add_special_tokens=False).offsets]
        begins = [p.begin for p in self.model.encode(text, return_type="proto").pieces]
        raw = text.encode()
        if len(raw) == len(text):
            return begins
        out, at, chars = [], 0, 0
        for b in begins:  # byte offsets to code points, in one pass
            chars += len(raw[at:b].decode("utf-8", "ignore"))
            at = b
            out.append(chars)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _boundary(text: str, left: list[int], right: list[int], lo: int, hi: int) -> int | None:
    """Last place in text[lo:hi] that is a token start of both encodings and safe to cut at."""
    both = set(left) & set(right)
    for m in reversed(list(_PLACE.finditer(text, lo, hi))):
        # sentencepiece lets the space open the next piece, word tokenizers may leave it out
        for at in (m.start(), m.end()):
            if at in both:
                return m.start()
    return None


def spliced_count(enc: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Token count of a text of any length, from chunks of about ``chunk`` code points."""
    n = len(text)
    if n <= chunk or not enc.safe:
        return enc.counts([text])[0]
    total, begin, cut = 0, 0, 0
    left = enc.starts(text[:chunk])
    end = chunk
    while end < n:
        share = overlap
        while True:
            start = max(begin, end - share)
            stop = min(n, start + chunk + share)
            right = [start + s for s in enc.starts(text[start:stop])]
            place = _boundary(text, left, right, max(cut, start + 1), end - 1)
            if place is not None:
                break
            if start > begin:  # widen backwards first
                share *= 2
            else:  # no safe place in the whole left chunk: make that chunk longer
                grown = min(n, begin + 2 * (end - begin))
                if grown == end:
                    break
                end = grown
                left = [begin + s for s in enc.starts(text[begin:end])]
                if end == n:
                    return total + sum(s >= cut for s in left)
        total += sum(cut <= s < place for s in left)
        left, begin, cut, end = right, start, place, stop
    return total + sum(s >= cut for s in left)


def count_tokens(text: Column, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Token count (bigint) of a text column; a null text counts as empty.

    Short texts are encoded in groups; a longer one alone, so a worker holds
    one chunk and its offsets.
    """

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for texts in batches:
            out = [0] * len(texts)
            group: list[int] = []
            size = 0
            values = texts.fillna("").tolist()

            def flush() -> None:
                for i, c in zip(group, enc.counts([values[i] for i in group])):
                    out[i] = c
                group.clear()

            for i, t in enumerate(values):
                if len(t) > chunk:
                    out[i] = spliced_count(enc, t, chunk, overlap)
                    continue
                group.append(i)
                size += len(t)
                if size > 4 * chunk:
                    flush()
                    size = 0
            if group:
                flush()
            yield pd.Series(out, dtype="int64")

    return n_tokens(text)


def with_token_counts(
    docs: DataFrame, path: str, text: str = "text", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """All columns of ``docs`` plus n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens.  Columns of ``docs`` with
    those three names are replaced.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.withColumn("n_bytes", F.octet_length(full).cast("bigint"))
        .withColumn("n_tokens", count_tokens(full, path, chunk, overlap))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
