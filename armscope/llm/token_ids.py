"""Token ids of whole texts as packed 32-bit numbers, from the vocabulary files of three libraries."""

from __future__ import annotations

import base64
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Words that a worker remembers, before it starts anew; longer ones are encoded each time.
REMEMBERED, LONGEST = 1_200_000, 48
#: Code points that go to the library in one call, and texts that are worked on at a time.
RUN, TEXTS = 1 << 20, 256

#: Letters of one word and the marks behind it; tokenizers that drop white space part them.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def few(batches: Iterator[pa.RecordBatch], rows: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a worker holds the words or ids of few texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class PieceIds:
    """sentencepiece ``.model`` files."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)

    def packed(self, texts: list[str]) -> list[bytes]:
        return [_packed(ids) for ids in self.model.encode(texts, num_threads=1)]

    def token_bytes(self) -> list[bytes]:
        """What every piece stands for; control pieces stand for their names."""
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        return [
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)
        ]


class ByteIds:
    """Byte-level ``.tiktoken`` rank files; no string is a special token."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def packed(self, texts: list[str]) -> list[bytes]:
        return [_packed(self.model.encode_ordinary(t)) for t in texts]

    def token_bytes(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values()) + 1)
        for raw, rank in self.ranks.items():
            out[rank] = raw
        return out


class WordIds:
    """tokenizers ``.json`` files; special strings inside texts are handled as the library does by default.

    A tokenizer that drops white space encodes what stands between spaces by
    itself.  Texts repeat such words, so their ids are remembered.  Others encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.memory: dict[str, bytes] = {}
        one, three, mixed = self._encode(["a", "a \n a\na", "Á!? The"])
        apart = self._encode(["á", "!?"]) + [_packed([t.id for t in self.model.model.tokenize("the")])]
        self.by_word = three == 3 * one and mixed == b"".join(apart)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Ids of words, a run of them in one call."""
        run, size = [], 0
        for w in words:
            run.append(w)
            size += len(w)
            if size > RUN:
                self.memory.update(zip(run, self._encode(run)))
                run, size = [], 0
        if run:
            self.memory.update(zip(run, self._encode(run)))

    def packed(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._encode(texts)
        memory = self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*[set(words).difference(memory) for words in cut])
        long = {w for w in new if len(w) > LONGEST}
        plain = {w: (m[1].lower(), m[2]) for w in new - long if (m := _PLAIN.fullmatch(w))}
        parts = {x for pair in plain.values() for x in pair if x not in memory}
        printed = {x for x in parts if x.isascii()}  # these need no normalising, and are one word for the model
        word = self.model.model.tokenize
        memory.update((x, _packed([t.id for t in word(x)])) for x in printed)
        self._learn(parts - printed | (new - plain.keys()))
        for w, (letters, marks) in plain.items():
            memory[w] = memory[letters] + memory[marks]
        out = [b"".join(map(memory.__getitem__, words)) for words in cut]
        for w in long:
            del memory[w]
        return out


@lru_cache(maxsize=4)
def token_ids(path: str) -> PieceIds | ByteIds | WordIds:
    """The encoder of a vocabulary file; a worker loads each file once."""
    kinds = {".model": PieceIds, ".tiktoken": ByteIds, ".json": WordIds}
    return kinds[os.path.splitext(path)[1]](path)
