"""Cross-tokenizer alignment against a brute-force version over token ranges."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from armscope.llm import alignment
from armscope.llm.token_ids import token_ids

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def letters():
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def spans(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def brute(docs):
    a_model, b_model, byte = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=SECOND), letters()
    a_model.encode_special_tokens = True
    rows, df = [], Counter()
    for doc, text in docs:
        rows.append((doc, [], [], [], []))
        if not text:
            continue
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        raw_a = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a]
        raw_b = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            continue
        at, bt = spans(raw_a), spans(raw_b)
        links = [(x, y) for (s, e), x in zip(at, a) for (t, f), y in zip(bt, b) if s < f and t < e]
        groups, begin = [], 0
        for end in sorted({e for _, e in at} & {e for _, e in bt}):
            groups.append("|".join(",".join(str(x) for (s, e), x in zip(r, ids) if begin <= s and e <= end) for r, ids in ((at, a), (bt, b))))
            begin = end
        rows[-1] = (doc, a, b, links, groups)
        df.update(set(links))
    most = defaultdict(int)
    for (x, _), n in df.items():
        most[x] = max(most[x], n)
    return sorted([
        (d, len(a), len(b), len(g), len(l), sum(df[p] == most[p[0]] for p in l), sum(df[p] for p in l),
         hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for d, a, b, l, g in rows
    ], key=str)


@pytest.mark.parametrize("cell_pairs,group_pairs", [(65_536, 1_000_000), (40, 60)])
def test_same_as_brute_force(docs_of, edges, cell_pairs, group_pairs):
    texts = [t if t is None or len(t) < 2000 else t[:2000] for t in edges]
    texts += [f"Eine Straße, {i % 5} naïve words\nand <s> <|endoftext|> {i} 梦想" for i in range(40)] + ["the cat sat"] * 30
    docs = docs_of(texts, clash=True)
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(2).selectExpr("cast(null AS bigint) doc_id", *docs.columns[1:]))
    out = alignment.aligned(docs, FIRST, SECOND, cell_pairs=cell_pairs, group_pairs=group_pairs)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_long_text_and_no_text(docs_of):
    out = alignment.aligned(docs_of(["word " * 30_000 + "x" * 50_000]), FIRST, SECOND).first()
    assert out["n_links"] == out["n_a"] + out["n_b"] - out["n_groups"] > 30_000
    assert alignment.aligned(docs_of([]), FIRST, SECOND).count() == 0
    assert tuple(alignment.aligned(docs_of([None]), FIRST, SECOND).first()) == (0, 0, 0, 0, 0, 0, 0, "")


def test_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 20_000))
    levels = alignment.build_hash(keys)
    levels = alignment.unpack_levels(*alignment.pack_levels(levels))
    assert sorted(alignment.look_up(levels, keys).tolist()) == list(range(len(keys)))
    assert alignment.build_hash(keys[:0]) == [] and alignment.look_up([], keys[:3]).tolist() == [-1] * 3


def test_foreign_pairs_are_told():
    keys = np.arange(100) * 7
    import pyarrow as pa

    levels = alignment.build_hash(keys)
    bits, sizes = alignment.pack_levels(levels)
    by_slot = np.empty_like(keys)
    by_slot[alignment.look_up(levels, keys)] = keys
    table = pa.table({"bits": pa.array([bits], pa.list_(pa.binary())), "sizes": [sizes], "keys": [by_slot]})
    assert (by_slot[alignment._slots(table, keys)] == keys).all()
    with pytest.raises(ValueError):
        alignment._slots(table, np.array([3]))


def test_rank_file_encodes_as_the_json_file():
    """One text per block of code points: every assigned and unassigned one beside letters, digits and spaces."""
    model = Tokenizer.from_file(JSON)
    model.encode_special_tokens = True
    points = [c for c in range(0, 0x30000, 3) if not 0xD800 <= c < 0xE000]
    texts = [f" a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)}\n" for c in points] + [" <|endoftext|> x", "  \n a  b\t\tc "]
    want = [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    assert token_ids(FIRST).packed(texts) == want
