"""Fingerprints, their links and components against brute force."""

import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from armscope.llm import near_text, simhash
from armscope.llm.components import components


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius=3):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    low = {}
    for p, i in zip(prints, ids):
        low[root(p)] = min(low.get(root(p), i), i)
    return [low[root(p)] for p in prints]


def test_edges(docs_of, edges):
    rows = simhash.near_duplicates(docs_of(edges, clash=True)).orderBy("doc_id").collect()
    prints = [brute_print(t) for t in edges]
    assert [r["fingerprint"] for r in rows] == [f"{p:016x}" for p in prints]
    assert [r["component_id"] for r in rows] == brute_components(prints, range(len(edges)))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source = docs.orderBy("doc_id").collect()
    prints = [brute_print(r["text"]) for r in source]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    want = brute_components(prints, [r["doc_id"] for r in source])
    for r, p, c in zip(source, prints, want):
        assert got[r["doc_id"]]["fingerprint"] == f"{p:016x}" and got[r["doc_id"]]["component_id"] == c


def near_prints(seed, families, size, most):
    rng = random.Random(seed)
    out = set()
    for _ in range(families):
        base = rng.getrandbits(64)
        for _ in range(size):
            p = base
            for _ in range(rng.randint(0, most)):
                p ^= 1 << rng.randrange(64)
            out.add(p)
    return sorted(out)


@pytest.mark.parametrize("block", [simhash.BLOCK, 7])
@pytest.mark.parametrize("width", [2, 4])
def test_links_span_all_components(spark, block, width):
    """Also where every cell is cut into blocks of a few rows."""
    prints = near_prints(1, 30, 12, 4) + near_prints(2, 1, 150, 5)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = simhash.print_links(spark.createDataFrame([(p,) for p in signed], "p bigint"), width=width, block=block)
    rows = links.collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in rows)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    low = {}
    for p in signed:
        low.setdefault(got.get(p, p), []).append(p)
    mine = sorted(sorted(v) for v in low.values())
    want = {}
    for p, c in zip(prints, brute_components(prints, signed)):
        want.setdefault(c, []).append(p - 2**64 if p >= 2**63 else p)
    assert mine == sorted(sorted(v) for v in want.values())


def test_dense_group_gives_few_links(spark):
    prints = near_prints(3, 1, 1500, 2)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    links = simhash.print_links(spark.createDataFrame(signed, "p bigint"))
    assert links.count() < 60 * len(prints)


def test_empty_and_null_ids(spark, docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    docs = docs_of(["a b c d", "a b c d", "x y z"]).withColumn("doc_id", F.when(F.col("doc_id") != 0, F.col("doc_id")))
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in rows) == [(-1, 1), (1, 1), (2, 2)]


def jaccard(a, b, k=5):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_near_copies_go_and_others_stay(spark, docs_of):
    """Copies with single words changed, at a similarity of 0.8 and more, against texts that share half."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    texts, near = [], 0
    for base in range(60):
        origin = [rng.choice(words) for _ in range(rng.randint(120, 600))]
        texts.append(" ".join(origin))
        for share in (0.0, 0.004, 0.01, 0.018):
            copy = list(origin)
            for _ in range(int(share * len(copy))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            text = " ".join(copy)
            if jaccard(texts[base * 6], text) >= 0.8:
                near += 1
            texts.append(text)
        texts.append(" ".join(origin[: len(origin) // 2] + [rng.choice(words) for _ in range(len(origin) // 2)]))
    kept = {r["doc_id"] for r in near_text.keep_first(docs_of(texts)).collect()}
    origins, halves = {i * 6 for i in range(60)}, {i * 6 + 5 for i in range(60)}
    assert origins <= kept and halves <= kept
    gone = len(texts) - len(kept)
    assert near > 150 and gone >= 0.95 * near


def test_dense_near_copies_are_one_group(spark, docs_of):
    rng = random.Random(9)
    origin = [f"w{rng.randrange(3000)}" for _ in range(400)]
    texts = []
    for i in range(400):
        copy = list(origin)
        copy[rng.randrange(400)] = f"x{i}"
        texts.append(" ".join(copy))
    assert near_text.similar_documents(docs_of(texts)).select("component_id").distinct().count() == 1


def test_keep_first(docs_of):
    docs = docs_of(["a b c d e f", "A b c d e f", "q r s t", None, ""], clash=True)
    kept = near_text.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]


def test_components_of_chain_loops_and_star(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


def with_changes(rng, origin, runs):
    """A copy with so many runs of five words replaced by new ones, spread out: similarity falls by known steps."""
    copy = list(origin)
    for i in range(runs):
        at = (i + 1) * len(origin) // (runs + 1)
        copy[at : at + 5] = [f"n{rng.getrandbits(40)}" for _ in range(5)]
    return copy


def test_links_are_exact_on_both_sides_of_the_similarity(spark, docs_of):
    """Pairs at 0.65 to 0.79 stay and pairs at 0.80 to 0.85 go, of all lengths."""
    rng = random.Random(12)
    texts, near, far = [], 0, 0
    while near < 150 or far < 150:
        origin = [f"w{rng.randrange(9000)}" for _ in range(rng.choice([60, 150, 300, 700]))]
        copy = with_changes(rng, origin, rng.randint(1, 20))
        a, b = " ".join(origin), " ".join(copy)
        j = jaccard(a, b)
        if 0.8 <= j <= 0.85 and near < 150:
            near += 1
        elif 0.65 <= j < 0.8 and far < 150:
            far += 1
        else:
            continue
        texts += [a, b]
    kept = {r["doc_id"] for r in near_text.keep_first(docs_of(texts)).collect()}
    for i in range(0, len(texts), 2):
        assert i in kept
        if jaccard(texts[i], texts[i + 1]) < 0.8:
            assert i + 1 in kept
    gone = len(texts) - len(kept)
    assert gone >= 148  # the grids miss a few in a thousand


def test_components_equal_brute_force_where_likely_links_are_false(spark, docs_of):
    """Short texts, whose fingerprints tell little, and families whose members chain."""
    rng = random.Random(13)
    texts = []
    for _ in range(25):
        origin = [f"w{rng.randrange(9000)}" for _ in range(rng.choice([12, 16, 40, 200]))]
        for _ in range(8):
            texts.append(" ".join(origin))
            origin = list(origin)
            origin[rng.choice([0, len(origin) - 1, len(origin) // 2])] = f"n{rng.getrandbits(40)}"
    low = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(low)
        for i in range(len(texts)):
            for k in range(i - i % 8, i):
                if jaccard(texts[i], texts[k]) >= 0.8:
                    low[i] = low[k] = min(low[i], low[k])
        if low == before:
            break
    got = {r["doc_id"]: r["component_id"] for r in near_text.similar_documents(docs_of(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == low


def test_proposals_grow_with_a_group_not_with_its_pairs(spark, docs_of, monkeypatch):
    """Rows that the cells hand on to the exact check, for a family of near copies of doubling size."""
    rng, rounds, rest = random.Random(21), [], []
    proposals, between = near_text._proposals, near_text._between
    monkeypatch.setattr(near_text, "_proposals", lambda *a: rounds.append(a[1]) or proposals(*a))
    monkeypatch.setattr(near_text, "_between", lambda *a: rest.append(between(*a)) or rest[-1])
    origin = [f"w{rng.randrange(9000)}" for _ in range(300)]
    for n in (200, 3200):
        rounds.clear(), rest.clear()
        texts = []
        for i in range(n):
            copy = list(origin)
            for at in rng.sample(range(300), 2):
                copy[at] = f"n{rng.getrandbits(40)}"
            texts.append(" ".join(copy))
        assert near_text.similar_documents(docs_of(texts)).select("component_id").distinct().count() == 1
        # A round hands on at most two pairs for each active text.
        assert 2 * sum(rounds) + sum(df.count() for df in rest) <= 8 * n


def test_pairs_below_the_similarity_do_not_grow_with_a_family(docs_of, monkeypatch):
    """Texts alike at about 0.66 were handed on as all their pairs; the links among them must stay."""
    rng, rest = random.Random(24), []
    between = near_text._between
    monkeypatch.setattr(near_text, "_between", lambda *a: rest.append(between(*a)) or rest[-1])
    origin = [f"w{rng.randrange(9000)}" for _ in range(200)]
    texts = []
    for _ in range(400):
        copy = list(origin)
        for at in rng.sample(range(200), 4):
            copy[at] = f"n{rng.getrandbits(40)}"
        texts.append(" ".join(copy))
    texts += [texts[7] + " more", texts[30] + " more"]
    got = {r["doc_id"]: r["component_id"] for r in near_text.similar_documents(docs_of(texts)).collect()}
    near = {(i, k) for i in range(402) for k in range(i) if jaccard(texts[i], texts[k]) >= 0.8}
    assert {(400, 7), (401, 30)} <= near and len(near) < 100
    assert all(got[i] == got[k] for i, k in near)
    low = list(range(402))
    for _ in range(402):
        before = list(low)
        for i, k in near:
            low[i] = low[k] = min(low[i], low[k])
        if low == before:
            break
    assert [got[i] for i in range(402)] == low
    assert sum(df.count() for df in rest) <= 8 * len(texts)


def test_sketches_rule_out_no_pair_at_the_similarity():
    rng, ruled_out = np.random.default_rng(25), 0
    for _ in range(4000):
        n = int(rng.choice([0, 1, 4, 9, 40, 150, 600, 5000]))
        a = rng.integers(0, 1 << 63, n).astype("<u8")
        b = np.concatenate([a[int(n * rng.choice([0, 0.02, 0.1, 0.2])) :], rng.integers(0, 1 << 63, int(n * rng.choice([0, 0.02, 0.1, 0.25])))])
        x, y = (np.sort(v.astype("<u8")).tobytes() for v in (a, b))
        words = np.array([np.frombuffer(near_text.parity_sketch(v), dtype="<u8") for v in (x, y)])
        size = words[:, -1].astype(np.int64)
        assert size.tolist() == [len(a), len(b)]
        far = near_text._apart(words[:, :-1], size, np.array([0]), np.array([1]), 0.8)[0] == near_text._FAR
        ruled_out += far
        assert not far or near_text.jaccard(x, y) < 0.8
    assert ruled_out > 500


def test_repeated_and_null_ids_lose_their_copies(docs_of):
    docs = docs_of(["a b c d e f", "a b c d e f", "q r s t"], clash=True)
    docs = docs.unionByName(docs).unionByName(docs.selectExpr("cast(null AS bigint) doc_id", *docs.columns[1:]))
    kept = near_text.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]
    only = docs.filter("doc_id IS NULL").unionByName(docs.filter("doc_id IS NULL"))
    assert sorted(r["text"] for r in near_text.keep_first(only).collect()) == ["a b c d e f", "q r s t"]
    assert near_text.keep_first(docs.limit(0)).count() == 0


def test_blocks_of_full_cells_give_the_same_components(docs_of):
    rng, texts = random.Random(22), []
    for _ in range(30):
        origin = [f"w{rng.randrange(900)}" for _ in range(80)]
        for _ in range(4):
            texts.append(" ".join(origin))
            origin[rng.randrange(80)] = f"n{rng.getrandbits(40)}"
    whole, cut = (
        {r["doc_id"]: r["component_id"] for r in near_text.similar_documents(docs_of(texts), block=b).collect()} for b in (20_000, 5)
    )
    assert whole == cut


def test_pairs_between_groups_come_once(spark, docs_of):
    """Every pair within the radius that meets in a grid is made once, also where cells are cut into blocks."""
    rng, texts = random.Random(23), []
    for _ in range(12):
        origin = [f"w{rng.randrange(900)}" for _ in range(90)]
        for _ in range(8):
            copy = list(origin)
            for at in rng.sample(range(90), 4):
                copy[at] = f"n{rng.getrandbits(40)}"
            texts.append(" ".join(copy))
    prints = [near_text.wide_point(t) for t in texts]
    points = spark.createDataFrame([(i, i % 50, p) for i, p in enumerate(prints)], "pid bigint, label bigint, print binary")
    words = np.array([np.frombuffer(p[:32], dtype="<u8") for p in prints])
    counts = near_text.segment_counts(words).astype(int).reshape(len(texts), near_text.GROUPS, -1)
    radius, want = near_text.radius_of(0.8), set()
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            near = sum(int(x ^ y).bit_count() for x, y in zip(words[a, :2], words[b, :2])) <= radius
            if near and a % 50 != b % 50 and (abs(counts[a] - counts[b]).sum(axis=1) <= 1).any():
                want.add((a, b))
    assert len(want) > 100
    for block in (20_000, 3):
        rows = [tuple(r) for r in near_text._between(points, len(texts), radius, block).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """The pipeline's disk: shuffles of a written table are removed after it."""
    from armscope.llm import common

    before = spark.conf.get(common.CLEANUP, None)
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files, found = folder.getAllFiles().iterator(), set()
        while files.hasNext():
            found.add(files.next().getName())
        return {name for name in found if name.startswith("shuffle_")}

    old = shuffles()
    table = common.stored(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "cleaned")
    until = time.time() + 20
    while shuffles() - old and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - old
    assert table.count() == 100 and spark.conf.get(common.CLEANUP, None) == before


def lone_and_copies(rng, lone, size=400):
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(size)) for _ in range(lone)]
    return texts + [texts[3] + " more", texts[7], "x " + texts[3]]


def test_texts_of_lone_rows_are_not_dealt_out(spark, docs_of):
    """The disk of the last step: only rows of groups and repeated rows are shuffled with their texts."""
    texts = lone_and_copies(random.Random(26), 300)
    docs = docs_of(texts)
    docs = docs.unionByName(docs.filter("doc_id IN (5, 9)"))
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def written():
        files, found = folder.getAllFiles().iterator(), {}
        while files.hasNext():
            f = files.next()
            if f.getName().startswith("shuffle_"):
                found[f.getName()] = f.length()
        return found

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept, old = near_text.keep_first(docs), written()
        ids = sorted(r["doc_id"] for r in kept.select("doc_id", "text").collect())
        new = sum(n for name, n in written().items() if name not in old)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ids == list(range(300))
    assert new < sum(map(len, texts)) / 5


def test_key_filter_loses_no_key(spark):
    keys = spark.range(0, 50_000, 5).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("h"))
    all_ = spark.range(50_000).select("id", F.unhex(F.md5(F.col("id").cast("string"))).alias("h"))
    passed = {r["id"] for r in all_.filter(near_text.key_filter(keys)(F.col("h"))).select("id").collect()}
    assert passed >= set(range(0, 50_000, 5)) and len(passed) < 10_500
    assert all_.filter(near_text.key_filter(keys.limit(0))(F.col("h"))).count() == 0


def test_grids_in_parts_and_points_without_a_pair(docs_of, monkeypatch):
    """A large table fills its grids in parts, and a point of which no pair is left leaves the rounds; the groups are the same."""
    rng, texts = random.Random(27), []
    for _ in range(30):
        origin = [f"w{rng.randrange(900)}" for _ in range(80)]
        for _ in range(4):
            texts.append(" ".join(origin))
            origin[rng.randrange(80)] = f"n{rng.getrandbits(40)}"
    rounds, filled = [], []
    proposals, placed = near_text._proposals, near_text._placed
    monkeypatch.setattr(near_text, "_proposals", lambda *a: rounds.append(a[1]) or proposals(*a))
    monkeypatch.setattr(near_text, "_placed", lambda *a: filled.append(len(a[4]) if len(a) > 4 else 16) or placed(*a))

    def groups():
        return {r["doc_id"]: r["component_id"] for r in near_text.similar_documents(docs_of(texts)).collect()}

    whole = groups()
    assert rounds[0] == 120 and len(rounds) > 2 and rounds[2] < 30 and set(filled) == {16}
    filled.clear()
    monkeypatch.setattr(near_text, "ALL_AT_ONCE", 0)
    assert groups() == whole and filled[:4] == [near_text.AT_ONCE] * 4
