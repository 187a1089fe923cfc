"""Merkle fingerprints: equality, likeness, located edits and neighbours."""

import hashlib
import random

from armscope.llm import merkle


def test_neighbours_edges(docs_of, edges):
    rows = merkle.neighbour_edits(docs_of(edges, clash=True)).orderBy("doc_id").collect()
    texts = [t or "" for t in edges]
    assert len(rows) == len(texts)
    for i, r in enumerate(rows):
        t, nxt = texts[i], texts[(i + 1) % len(texts)]
        edit = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (t == edit)
        assert 0.0 <= r["near_edited"] <= 1.0 and 0.0 <= r["near_next"] <= 1.0
        assert (r["near_next"] == 1.0) == (t == nxt)
    assert (rows[4]["fingerprint"] == rows[5]["fingerprint"]) and rows[0]["fingerprint"] == rows[1]["fingerprint"]


def test_ranges_do_not_change_the_next(spark, docs_of):
    docs = docs_of([f"text {i}" for i in range(50)]).selectExpr("doc_id * doc_id * 7 - 90 AS doc_id", "text")
    got = {r["text"]: r["next_text"] for r in merkle.with_next(docs, "doc_id", ["text"], rows=3).collect()}
    assert got == {f"text {i}": f"text {(i + 1) % 50}" for i in range(50)}


def test_one_row_empty_and_null_key(spark, docs_of):
    assert merkle.neighbour_edits(docs_of([])).count() == 0
    one = merkle.neighbour_edits(docs_of(["a. b. c."])).collect()
    assert one[0]["near_next"] == 1.0
    docs = spark.createDataFrame([(None, "n"), (1, "a"), (1, "b"), (2, "c")], "doc_id bigint, text string")
    got = {r["text"]: r["next_text"] for r in merkle.with_next(docs, "doc_id", ["text"]).collect()}
    assert got == {"n": "a", "a": "b", "b": "c", "c": "n"}


def test_structure_is_in_the_root(docs_of):
    texts = ["a. b.", "a.\n b.", "a.\n\n b.", "a.\n\n\n b.", "a. b", "ab."]
    rows = merkle.with_fingerprint(docs_of(texts)).collect()
    assert len({r["fingerprint"][:64] for r in rows}) == len(texts)


def test_differing_branches_locate_the_edit(docs_of):
    old = "One. Two. Three.\nFour. Five.\n\nSix. Seven."
    new = "One. Two. Three.\nFour. FIVE!\n\nSix. Seven."
    docs = docs_of([old]).selectExpr("doc_id", "text AS a", f"'{new}' AS b".replace("\n", "\\n"))
    docs = merkle.with_fingerprint(merkle.with_fingerprint(docs, "a", "fa"), "b", "fb")
    rows = merkle.differing_branches(docs, "fa", "fb", "doc_id").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 1, 1)]
    near = merkle.with_likeness(docs, {"near": ("fa", "fb")}).first()["near"]
    assert near == 2 * 6 / 14


def test_any_bigints_are_ids(spark):
    """Hashed ids, the ends of the type, one far outlier, clusters: neighbours are right and no range is crowded."""
    rnd = random.Random(4)
    hashed = [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(900)]
    clustered = [s * 10**15 + i for s in range(3) for i in range(300)]
    for ids in (hashed, [-(1 << 63), (1 << 63) - 1, *range(500)], [*range(700), 1 << 60], clustered):
        docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string")
        got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(docs, "doc_id", ["text"], rows=20).collect()}
        order = sorted(ids)
        assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}
        bounds = merkle._ranges(docs.selectExpr("doc_id AS k"), 20).collect()
        cuts = sorted([*bounds[0]["upper"], *(x for r in bounds for x in r["fine"])])
        crowd = [sum(lo <= i < hi for i in ids) for lo, hi in zip([-(1 << 63) - 1, *cuts], [*cuts, 1 << 63])]
        assert max(crowd) <= 100
    assert merkle.neighbour_edits(docs.selectExpr("doc_id", "cast(null AS string) text")).count() == len(ids)
