"""The stages in order, each against what it must keep."""

import corpus_pipeline
from __spark_entry__ import queries
from armscope.llm import pieces

SF = "/root/testdata/sf0.001"


def test_run_equals_the_stages_and_keeps_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = docs.count()
        assert 0 < after <= before, name
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
        before = after
    want = sorted((r["doc_id"], r["text"], tuple(r["piece_ids"])) for r in docs.collect())
    got = sorted((r["doc_id"], r["text"], tuple(r["piece_ids"])) for r in queries()["pipeline"](spark, SF).collect())
    assert got == want and all(r["round_trip"] for r in docs.collect())


def test_edges_pass_every_stage(spark, docs_of, edges):
    extra = [" ".join(f"word{i * j % 97} of the" for j in range(40)) + "." for i in range(1, 30)]
    for rows in (edges + extra + extra, []):
        docs = docs_of(rows, clash=True)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            n = docs.count()
        assert n <= len(rows)


def test_near_stage_keeps_one_of_each_group(spark, docs_of):
    texts = ["a b c d e f g", "A B C d e f g", "q w e r t z u i o p"]
    out = corpus_pipeline.near_stage(spark, docs_of(texts), SF).collect()
    assert sorted(r["doc_id"] for r in out) == [0, 2]


def test_piece_stage_gives_the_next_best_segmentations(spark, docs_of, model_path):
    texts = ["the cat sat on the mat", "a  b\nçé", "q", "", None, "the cat sat on the mat"]
    out = corpus_pipeline.piece_stage(spark, docs_of(texts), SF)
    assert out.columns == [*corpus_pipeline.COLUMNS, *pieces.ADDED]
    rows = {r["doc_id"]: r for r in out.collect()}
    model = pieces.piece_model(model_path)
    for i, text in enumerate(texts):
        ids, score, others = next(model.encode([text or ""]))
        assert list(rows[i]["piece_ids"]) == ids.tolist() and rows[i]["score"] == score
        assert [tuple(w) for w in rows[i]["others"]] == others
    ranks = pieces.n_best_rows(out.filter("doc_id = 0"), "doc_id").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == [1, 2, 3] and len({tuple(r["ids"]) for r in ranks}) == 3
    assert ranks[0]["score"] >= ranks[1]["score"] >= ranks[2]["score"]
    assert {model.decode(r["ids"]) for r in ranks} == {texts[0]}
