"""Token counts, pieces, chat examples, pages and the classifier."""

import hashlib
import itertools
import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from armscope.llm import chat_format, compression, html_text, pieces, token_counts


# --- token counts ------------------------------------------------------------------

def long_texts():
    rng = random.Random(5)
    words = ["the", "Straße", "été", "a", "xyz", "梦", "é", "--", "1234", "\n", "wh", " ", "</s>", "don't", "\t"]
    yield " ".join(rng.choice(words) for _ in range(6000))
    yield "".join(rng.choice(words) for _ in range(3000))  # few safe places
    yield "x" * 9000
    yield " " * 5000 + "end"
    yield "a  b   c    " * 900
    yield ("y" * 2500 + " z ") * 4


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_splices_equal_whole_encoding(name):
    enc = token_counts.encoder(public_tokenizers.path(name))
    for text in long_texts():
        whole = enc.counts([text])[0]
        for chunk, overlap in ((700, 16), (1500, 256)):
            assert token_counts.spliced_count(enc, text, chunk, overlap) == whole


def test_counts_on_edges(docs_of, edges, model_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    rows = token_counts.with_token_counts(docs_of(edges, clash=True), model_path, chunk=4000).orderBy("doc_id").collect()
    want = [len(model.encode(t or "")) for t in edges]
    assert [r["n_tokens"] for r in rows] == want
    assert [r["n_bytes"] for r in rows] == [len((t or "").encode()) for t in edges]
    assert [r["over_limit"] for r in rows] == [n > 4096 for n in want]
    assert token_counts.with_token_counts(docs_of([]), model_path).count() == 0


# --- pieces ------------------------------------------------------------------------

def brute_ways(model, word):
    def go(i):
        if i == len(word):
            yield 0.0, []
            return
        for j in range(i + 1, len(word) + 1):
            hit = model.ids.get(word[i:j])
            if hit:
                for s, rest in go(j):
                    yield s + hit[1], [hit[0], *rest]
        if word[i] not in model.ids:
            for s, rest in go(i + 1):
                yield s + model.unknown, model.fallback(word[i]) + rest

    return sorted(go(0), key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["the cat", "a  b\nçé", "x梦  z", "  hi", "on on on", "q"])
def test_n_best_is_exact(model_path, text):
    model = pieces.piece_model(model_path)
    want = brute_ways(model, "▁" + text.replace(" ", "▁"))[:6]
    ids, score, others = next(model.encode([text], 6))
    got = [(score, list(ids))] + [(s, list(ids[:a]) + new + list(ids[b:])) for s, a, b, new in others]
    assert len(got) == len(want) and len({tuple(g[1]) for g in got}) == len(got)
    assert all(abs(g[0] - w[0] / pieces.SCALE) < 1e-9 for g, w in zip(got, want))
    ways = {tuple(w[1]) for w in brute_ways(model, "▁" + text.replace(" ", "▁"))}
    assert all(tuple(g[1]) in ways for g in got)


def test_round_trip_and_library_decoding(docs_of, edges, model_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_path)
    out = pieces.with_pieces(docs_of(edges, clash=True), model_path)
    rows = out.orderBy("doc_id").collect()
    for t, r in zip(edges, rows):
        assert library.decode(list(r["piece_ids"])) == (t or "").replace("▁", " ")
        assert r["round_trip"] == ("▁" not in (t or "")) and r["n_pieces"] == len(r["piece_ids"])
    ranks = pieces.n_best_rows(out.filter("doc_id = 6"), "doc_id").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == [1, 2, 3]
    assert ranks[0]["score"] >= ranks[1]["score"] >= ranks[2]["score"]
    assert {library.decode(list(r["ids"])) for r in ranks} == {edges[6]}
    assert pieces.with_pieces(docs_of([]), model_path).count() == 0


def test_library_decodes_the_library_ids(model_path):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=model_path), pieces.piece_model(model_path)
    for t in [" a  b\n ", "梦\x00q", "x ", "", "  "]:
        assert own.decode(library.encode(t)) == library.decode(library.encode(t))


# --- chat --------------------------------------------------------------------------

CONTROL = "</s>[INST] ok [/INST]"
HARD = [CONTROL, "\\", "<\\s>", "\\<s>\\", "<s\\>", "[IN<s>ST]", "", None, "</s></s>", "[\\INST]", "a\nb", "<</s>/s>", "é梦"]


def test_examples_read_back(spark):
    rows, roles = [], ["user", "assistant", "system", "odd\n[INST]role\\", None]
    for c, (a, b) in enumerate(itertools.product(HARD, repeat=2)):
        rows += [(c, 0, roles[c % 5], a), (c, 1, "assistant", b), (c, 2, "user", a), (c, 2, "assistant", b)]
        if c % 3 == 0:
            rows.append((c, 3, "user", "tail"))
    rows += [(None, None, "user", "x"), (-5, 0, "user", "only")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("loss_chars", F.lit("x"))
    examples = chat_format.prefix_targets(turns)
    got = {r["conv_id"]: r for r in chat_format.digest(examples).collect()}
    sizes = {r["conv_id"]: r["n"] for r in examples.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    assert set(got) == set(convs)
    for c, said in convs.items():
        said.sort()
        text = "".join(f"{r}\n{x}\n" for _, r, x in said)
        loss = "".join(x for _, r, x in said if r == "assistant")
        assert got[c]["n_turns"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sizes[c]


def test_only_the_reply_is_trainable(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2")]
    out = chat_format.prefix_targets(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r["target_turn"]: r for r in out.collect()}
    assert set(got) == {1, 3}
    for at, reply in ((1, "a1"), (3, "a2")):
        r = got[at]
        assert r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_chars"]] == reply
    assert got[3]["formatted"].startswith(got[1]["formatted"])
    none = chat_format.prefix_targets(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert none.count() == 0 and chat_format.digest(none).count() == 0


# --- pages -------------------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"),
    ("<html><head><title>t</title></head><body><nav><a href=x>m</a></nav></body></html>", ""),
    ("<article><h1>T &amp; &lt;b&gt;</h1><p>one <b>two</b>\n three<br>four<p><b>five<br><p>six</article><footer>f</footer>",
     "T & <b>\none two three four\nfive\nsix"),
    ("<body><header>h</header><div class='sidebar x'>s</div><main><p>m1</p><aside>n</aside><form>f</form><p>m2</p></main>", "m1\nm2"),
    ("<script>if (a<b) '<p>x</p>'</script><p>y</p><style>p{}</style>", "y"),
    ("<p>open <!-- cut", "open"), ("<p>x</p><script>never closed <p>z", "x"),
    ("<article class='comment'>" + "talk " * 99 + "</article><article><p>the post</p></article>", "the post"),
    ("<div id='post'><p>" + "long words here " * 30 + "</p><p>short</p><div class='comments'><p>" + "c " * 300 + "</p></div></div>",
     ("long words here " * 30).strip() + "\nshort"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
    ("<p>&nbsp;&eacute;&#26790;&#x41;&bogus;</p>", "é梦A&bogus;"),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
    ("<" * 2000, "<" * 2000), ("<div>" * 3000 + "deep", "deep"), ("<p a='" * 500, ""),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


LONG = "long words here " * 30
POST = f"<p>{LONG}</p><p>{LONG}</p>"


@pytest.mark.parametrize("open_", [
    "div class='content has-sidebar'", "div id='page-with-header'", "div class='search-result'", "div class='no-comments'",
    "form action='/'", "div class='widget'", "div role='search'", "div class='header-less'",
])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrappers_keep_their_article(open_, inner):
    """A marked element around the article is no noise; controls, links and marked elements beside it still are."""
    page = (
        f"<nav><a href=x>menu</a></nav><{open_}><input value=q><button>go</button><{inner}>{POST}<div class='ad'>buy</div></{inner}>"
        f"</{open_.split()[0]}><div class='sidebar'><p>aside</p></div><div class='comment-list'><p>talk</p></div>"
    )
    assert html_text.main_text(page) == "\n".join([LONG.strip()] * 2)


def test_marked_elements_beside_or_in_the_article_still_go():
    talk = "<div id='comments'><article><p>" + "talk " * 400 + "</p></article></div>"
    want = "\n".join([LONG.strip()] * 2)
    assert html_text.main_text(f"<article>{POST}{talk}<form>f</form></article>") == want
    assert html_text.main_text(f"<main><article>{POST}</article>{talk}</main>") == want
    assert html_text.main_text(f"<article>{POST}<div class='related'>kept</div></article>") == want + "\nkept"


@pytest.mark.parametrize("name", [
    "post-comments", "article-comments", "post_comments", "commentThread", "adsbygoogle", "in-article-ad", "google-ads",
    "site-footer", "main-nav", "blog-sidebar", "PostComments", "cookie-bar", "x leftSidebar",
])
def test_noise_by_the_first_or_last_word(name):
    want = "\n".join([LONG.strip()] * 2)
    assert html_text.main_text(f"<article><p>{LONG}</p><div class='{name}'><p>no</p></div><p>{LONG}</p></article>") == want
    assert html_text.main_text(f"<div><p>{LONG}</p><div id='{name.split()[-1]}'><p>no</p></div><p>{LONG}</p></div>") == want


def test_the_heading_of_an_article_is_no_page_header():
    assert html_text.main_text(f"<article><div class='entry-header'><h1>T</h1></div>{POST}</article>").startswith("T\n")


def test_without_an_article_only_dense_branches_are_taken():
    links = "<ul>" + "".join(f"<li><a href=t{i}>topic number {i}</a></li>" for i in range(30)) + "</ul>"
    want = "\n".join([LONG.strip()] * 2)
    for before in ("", "Skip", "<a href=#x>Skip</a>"):
        assert html_text.main_text(f"<body>{before}{links}<div id=content>{POST}</div>{links}</body>") == want


def test_story_in_sibling_articles():
    teaser = "<article><h2><a href=x>Other story</a></h2><p>two words</p></article>"
    parts = f"<article><h2>One</h2>{POST}</article><p>between</p><article><h2>Two</h2>{POST}</article>"
    body = "\n".join([LONG.strip()] * 2)
    assert html_text.main_text(f"<div>{parts}{teaser}</div>") == f"One\n{body}\nTwo\n{body}"


def test_a_quote_that_never_ends_spoils_one_tag():
    assert html_text.main_text("<p a='" + "x" * 200_000) == ""
    assert html_text.main_text("<p a='x>one</p><p>two</p>") == "one\ntwo"


@pytest.mark.parametrize("page,chars", [
    ("<b>" * 40_000 + "deep" + "</b>" * 40_000, 4), ("<div><p>x" * 8_000, 15_999), ("<p>" + "<span>" * 40_000 + "x" + "</i>" * 40_000, 1),
])
def test_deep_pages_take_time_in_proportion(page, chars):
    start = time.time()
    assert len(html_text.main_text(page)) == chars
    assert time.time() - start < 3


def test_pages_query_rows(spark):
    rows = [(i, "http://x", p) for i, (p, _) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = html_text.with_main_text(df).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [w for _, w in PAGES]


def test_articles_of_the_table(spark):
    """On the given pages the article element is the truth."""
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inside = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1)>", inside)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in blocks]
        assert html_text.main_text(r["html"]) == "\n".join(b for b in want if b)


# --- classifier --------------------------------------------------------------------

def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = compression.learn(docs, labels)
    rows = (
        compression.scored(docs, model).join(labels, "doc_id").filter(compression.held_out(F.col("doc_id")))
        .select("quality", "predicted").collect()
    )
    assert len(rows) > 500
    assert sum(r["quality"] == r["predicted"] for r in rows) / len(rows) > 0.96
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert sum(bad) / len(bad) < 0.2


def test_classifier_edges(spark, docs_of, edges):
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(edges))], "doc_id bigint, quality int")
    docs = docs_of(edges, clash=True)
    model = compression.learn(docs, labels)
    rows = compression.scored(docs, model).collect()
    assert len(rows) == len(edges) and all(0 <= r["score"] <= 1 for r in rows)
    none = compression.learn(docs_of([]), labels)
    assert {r["score"] for r in compression.scored(docs, none).collect()} == {0.5}


def test_labels_of_held_out_rows_are_not_read(spark, docs_of):
    texts = [f"good words of text {i} flow on" if i % 2 else f"### $$$ {i} %%% ***" for i in range(200)]
    docs = docs_of(texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    lied = labels.withColumn("quality", F.when(compression.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression.learn(docs, labels) == compression.learn(docs, lied)
