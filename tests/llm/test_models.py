"""Quality rules, wrappers, search and chat."""

import hashlib
import time

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tablecare.llm import queries as llm
from tablecare.llm.chat import ChatTemplate, chat_digests, written_chat
from tablecare.llm.rules import fit_rules, learn_quality, score_quality, statistics
from tablecare.llm.search import nearest_neighbours, traversal
from tablecare.llm.wrappers import _ALIGNED, align, article, fold, infer, main_text, read_page, slots

# --- queries with SQL -------------------------------------------------------------


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    found = llm.queries()[name](spark, sf_dir)
    cursor = connection.execute(llm.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    expected = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r)) for r in found.select(columns).collect()) == expected


# --- rules ------------------------------------------------------------------------


def test_quality_held_out(spark, sf_dir):
    rows = {r.doc_id: r for r in llm.op6_quality(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    judged = [(rows[r.doc_id].predicted, r.quality) for r in labels if rows[r.doc_id].held_out]
    assert len(judged) > 10
    assert np.mean([p == q for p, q in judged]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def test_rules_are_sparse_and_right():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.7)).astype(int)
    model = fit_rules(["a", "b", "c", "d"], x, y)
    assert 0 < len(model.rules) < 120
    total = np.full(len(x), model.intercept)
    for conditions, weight in model.rules:
        holds = np.ones(len(x), bool)
        for name, above, threshold in conditions:
            column = x[:, "abcd".index(name)]
            holds &= column > threshold if above else column <= threshold
        total += weight * holds
    assert ((total > 0) == y).mean() > 0.97


def test_compiled_rules_like_plain_evaluation(spark):
    """The Spark expression against a loop over the rules."""
    rng = np.random.default_rng(3)
    words = ["Some", "words", "|", "and!!", "12", "stop.", "no,space", "\n"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(300)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0 or "|" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, quality int")
    model = learn_quality(docs, labels)
    assert len(model.rules) > 5
    taken = docs.select("doc_id", *(c.alias(n) for n, c in statistics(llm.F.col("text")).items())).collect()
    scores = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    for row in taken:
        margin = model.intercept
        for conditions, weight in model.rules:
            if all(row[name] > at if above else row[name] <= at for name, above, at in conditions):
                margin += weight
        assert scores[row.doc_id] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-12)


def test_quality_sample_is_bounded(spark):
    """Rows that repeat a labelled id count once; the bound is an argument."""
    docs = spark.createDataFrame([(i % 40, "word " * (i % 40)) for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = learn_quality(docs.distinct(), labels)
    assert learn_quality(docs, labels) == once
    assert learn_quality(docs, labels, sample_rows=10) != once


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 0.1), (2, "", 0.2), (2, "", 0.2), (None, "some words", 0.3), (3, "long " * 200_000, 0.4)],
        "doc_id long, text string, score double",
    )
    labels = spark.createDataFrame([(3, 1, 0), (2, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    scored = score_quality(docs, learn_quality(docs, labels))
    assert scored.columns == ["doc_id", "text", "score", "predicted"]
    assert all(0 <= r.score <= 1 for r in scored.collect())
    none = score_quality(docs, learn_quality(docs, labels.limit(0))).collect()
    assert [r.score for r in none] == [0.5] * 5
    assert score_quality(docs.limit(0), learn_quality(docs.limit(0), labels)).count() == 0


# --- wrappers ---------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p > a {{}}</style><script>if (a < b) "</p>";</script></head>
<body class="article-page"><header><a href="/">Site</a></header><nav><ul><li><a href="/a">Home</a></li><li><a>More</a></li></ul></nav>
<div class="cookie-notice">We use cookies, a lot of them, in many words that go on and on.</div>
<{tag}><h1>{title}</h1>{body}</{tag}>
<aside><p>Read also</p></aside><div id="comments"><p>I disagree strongly with what is said here.</p></div>
<form><label>Name</label></form><footer>&copy; Site</footer></body></html>"""


def page(title, paragraphs, tag="article"):
    return PAGE.format(tag=tag, title=title, body="".join(f"<p>{p}" for p in paragraphs))


@pytest.mark.parametrize("tag", ["article", 'div class="x9"', "section"])
def test_main_text(spark, tag):
    body = [f"Paragraph {i} &amp; <b>bold\n text</b>&#33; a<br>b <a href='/x'>link</a>" for i in range(3)]
    rows = [
        (i, f"https://www.a.org/{i}", page(f"Title {i}", [f"{p} of {i}" for p in body], tag).replace(f"</{tag}>", f"</{tag.split()[0]}>"), "t")
        for i in range(8)
    ]
    rows += [(20, None, None, "t"), (21, "https://b.org", "", "t"), (22, "nowhere", "plain &lt;text", "t"), rows[0]]
    rows += [(23, "https://c.org/", "<nav>only a menu</nav>", "t"), (24, "https://c.org/", "<p>" + "very long " * 100_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = {}
    for r in main_text(pages).collect():
        assert r.n_chars == len(r.text)
        assert found.setdefault(r.page_id, r.text) == r.text
    for i in range(8):
        assert found[i] == "\n".join([f"Title {i}", *(f"Paragraph {k} & bold text! a b link of {i}" for k in range(3))])
    assert [found[i] for i in (20, 21, 22, 23)] == ["", "", "plain <text", ""]
    assert found[24] == ("very long " * 100_000).strip()
    assert main_text(pages.limit(0)).count() == 0


def test_siblings_of_one_path(spark):
    """Blocks told apart by role only have one path; all of them count for the region."""
    pages = [
        f'<div role="main"><p>Article {i}, as long as it has to be.</div><div role="navigation"><p>Go</div>'
        f"<section><p>Notice</p></section>" for i in range(6)
    ]
    seen = [("/".join(b.path), b.chrome) for b in read_page(pages[0])[1]]
    assert seen == [("div/p", False), ("div/p", True), ("section/p", False)]
    rows = [(i, f"https://{h}.org/{i}", p) for h in "abcdefgh" for i, p in enumerate(pages)]
    found = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.text) for r in found} == {(i, f"Article {i}, as long as it has to be.") for i in range(6)}


@pytest.mark.parametrize("quote", ["'", '"'])
def test_long_attributes(quote):
    value = quote + "x hidden > " * 10_000 + "y" * 100_000 + quote
    page = f"<nav data-s1={value}><p>menu</p></nav><div data-state={value}>before <img src={value}> after</div>"
    blocks = read_page(page)[1]
    assert [(b.text, b.path, b.chrome) for b in blocks] == [("menu", ("nav", "p"), True), ("before after", ("div",), False)]


LAYOUTS = [
    '<div class="layout has-sidebar"><article>{}</article></div>',
    '<div class="entry-content share-enabled">{}</div>',
    '<div class="post comments-open">{}</div>',
    '<div class="ad-free story">{}</div>',
    '<div id="search-results-article">{}</div>',
    '<div class="widget-page">{}</div>',
    '<form action="/x"><div class="w-1/2">{}</div></form>',
    '<article><div class="no-sidebar">{}</div></article>',
    "<div>" * 410 + "<nav><p>menu</p></nav>{}" + "</div>" * 410,
]


def test_layouts_named_like_chrome(spark):
    """An ancestor whose name only contains a chrome word does not hide the article."""
    texts = [f"Paragraph {i} of the article, with as many words in it as it needs." for i in range(5)]
    around = (
        '<body><ul class="main-nav"><li><a href="/">Home</a></ul>{}<div class="sidebar content">Read this</div>'
        '<div id="comments"><div class="comment-list"><article class="comment-body"><p>'
        + "I object. " * 200
        + '</article></div></div><div class="related-posts"><article><p>More</article></div>'
        '<div class="site-footer"><p>Imprint</p></div></body>'
    )
    rows = [
        (n, f"https://h{n}.org/{i}", around.format(layout.format("".join(f"<p>{t}</p>" for t in texts))))
        for n, layout in enumerate(LAYOUTS) for i in range(3)
    ]
    found = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.text) for r in found} == {(n, "\n".join(texts)) for n in range(len(LAYOUTS))}


def test_chrome_stays_chrome(spark):
    rows = [
        (0, "https://a.org/", '<div class="site-footer"><p>Imprint</p></div><div class="cookie-banner">Cookies</div>'),
        (1, "https://b.org/", '<div class="comment-list"><article><p>' + "one " * 99 + "</p><p>two</article></div>"),
        (2, "https://c.org/", '<article><p>short</p></article><div class="newsletter-content">Read our letter</div>'),
    ]
    found = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {0: "", 1: "", 2: "short"}


def test_odd_markup_takes_time_by_length():
    start = time.process_time()
    for part in ('<a "x ', '<a x="y ', '<a x="y >', "<a x='y \">", "<b><i>x</b>"):
        read_page(part * (2_000_000 // len(part)))
    assert time.process_time() - start < 60
    assert [b.text for b in read_page('<p>one <a x="y>two</p><p>three')[1]] == ["one two", "three"]
    assert [b.text for b in read_page("<p>1 <2 and a <b")[1]] == ["1 <2 and a <b"]
    assert [b.text for b in read_page('<p title=">" \'>one')[1]] == ["one"]


def test_groups_of_any_width():
    for size in range(1, 5):
        unit = [t for k in range(size) for t in (f"x{k}", "#", f"/x{k}")]
        assert fold(["div", *unit * 4, "/div"]) == ["div", ["+", unit], "/div"]
    assert fold(["div", *["x", "y", "/y", "#", "/x"] * 3, "/div"]) == ["div", ["+", ["x", "y", "/y", "#", "/x"]], "/div"]


def test_long_pages_align():
    rng = np.random.default_rng(0)
    pages = [
        "".join(f'<div class="{c}"><p>x</div>' for c in rng.choice(list("abcdefghijklmnopqrst"), 600)) for _ in range(2)
    ]
    one, two = (fold(read_page(p)[0]) for p in pages)
    start = time.process_time()
    wrapper = align(one, two)
    assert time.process_time() - start < 1
    assert len(wrapper) < 1.9 * len(one)

    def flat(items, optional=True):
        for item in items:
            if isinstance(item, str):
                yield item
            elif optional or item[0] == "+":
                yield from flat(item[1], optional)

    for page in (one, two):
        has, asks = iter(list(flat(wrapper))), iter(list(flat(page)))
        assert all(item in has for item in flat(page))
        assert all(item in asks for item in flat(wrapper, optional=False))


def test_wrappers_merge_in_rounds(spark):
    """A host with more different streams than one task aligns."""
    rows = [
        (i, "https://hot.org/", "<article><p>Text that is long enough</p>" + f"<i{i}>a</i{i}><p>b</article>" + "<div><p>c</div>")
        for i in range(2 * _ALIGNED + 10)
    ]
    found = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in found} == {"Text that is long enough\na\nb"} and len(found) == len(rows)


def test_wrapper_has_options_and_groups():
    one = fold(read_page("<div><h1>a</h1><p>x<p>y</div>")[0])
    two = fold(read_page("<div><h1>b</h1><h2>s</h2><p>x</div>")[0])
    wrapper = infer([one, two])
    assert wrapper == ["div", "h1", "#", "/h1", ["?", ["h2"]], ["?", ["#"]], ["?", ["/h2"]], ["+", ["p", "#", "/p"]], "/div"]
    assert align(wrapper, one) == wrapper
    assert slots(wrapper)["div/p"] == "repeat"
    assert slots(wrapper)["div/h1"] == "once"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='a'>", "</div>", "<b>", "</b>", "x ", "&lt;", "<!--", "-->", "<script>", "</script>", "<", "'", '"', "<a href='", ">", "<table><tr><td>", "</table>", "<br/>"]), max_size=25))
def test_any_markup_is_read(parts):
    tokens, blocks = read_page("".join(parts))
    assert tokens.count("#") == len(blocks)
    fold(tokens)
    article(blocks, "")


def test_every_given_page_has_its_article(spark, sf_dir):
    """The given pages mark their article plainly; a plain reading of it must agree."""
    import html
    import re

    expected = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", inside))
        texts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks)
        expected[r.page_id] = "\n".join(t for t in texts if t)
    assert {r.page_id: r.text for r in llm.op7_main_text(spark, sf_dir).collect()} == expected


# --- search -----------------------------------------------------------------------


def test_traversal_is_ordered():
    rng = np.random.default_rng(0)
    first, second = rng.random(6), rng.random(7)
    cells = traversal(first, second, np.ones((6, 7), int), 42)
    sums = [first[i] + second[j] for i, j in cells]
    assert len(set(cells)) == 42 and sums == sorted(sums)


@pytest.mark.parametrize("share,recall", [(1.0, 1.0), (0.5, 0.9)])
def test_search(spark, share, recall):
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((1500, 24)).astype(np.float32)
    rows[700:760] = rows[3]  # ties
    vectors = [(i, v.tolist()) for i, v in enumerate(rows)]
    odd = [(2000, None), (2100, [0.0] * 24), (2200, [float("nan")] * 24), (2300, [1.0]), (None, [1.0] * 24), vectors[5]]
    table = spark.createDataFrame([*vectors, *odd], "vec_id long, embedding array<float>")
    found = nearest_neighbours(table, llm.F.col("vec_id") % 100 == 0, share=share, least=20).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: r.rank):
        by_query.setdefault(r.query_id, []).append((r.vec_id, r.score))
    held = rows.astype(float)
    hits = 0
    assert set(by_query) == set(range(0, 1500, 100))
    for query, answers in by_query.items():
        distance = np.sqrt(((held - held[query]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(1500), distance)) if i != query][:10]
        hits += len({a for a, _ in answers} & set(best))
        assert [s for _, s in answers] == pytest.approx([distance[a] for a, _ in answers], abs=1e-12)
        assert answers == sorted(answers, key=lambda a: (a[1], a[0])) and len(answers) == 10
        if share == 1:
            assert [a for a, _ in answers] == best
    assert hits >= recall * 10 * len(by_query)


def _recall(found, rows: np.ndarray, step: int) -> float:
    answers, hits, asked = {}, 0, range(0, len(rows), step)
    for r in found:
        answers.setdefault(r.query_id, set()).add(r.vec_id)
    for query in asked:
        distance = ((rows - rows[query]) ** 2).sum(1)
        distance[query] = np.inf
        hits += len(answers[query] & set(np.argsort(distance, kind="stable")[:10].tolist()))
    return hits / (10 * len(asked))


@pytest.mark.parametrize("structured", [True, False])
def test_search_calibrates_its_share(spark, structured):
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((6000, 32))
    if structured:
        rows = rng.standard_normal((60, 32))[rng.integers(0, 60, 6000)] * 4 + 0.3 * rows
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    found = nearest_neighbours(table, llm.F.col("vec_id") % 50 == 0, least=100).collect()
    assert _recall(found, rows, 50) >= 0.9


def test_search_far_from_the_origin(spark):
    """Squares of norms are far larger than distances."""
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((300, 8)) + 1e7
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    found = nearest_neighbours(table, llm.F.col("vec_id") % 100 == 0, share=1.0).collect()
    assert _recall(found, rows, 100) == 1.0


def test_search_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (100, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = nearest_neighbours(table, llm.F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == [(0, 1, 1), (0, 2, 100), (100, 1, 0), (100, 2, 1)]
    assert nearest_neighbours(table.limit(0), llm.F.col("vec_id") == 0).count() == 0


# --- chat -------------------------------------------------------------------------

TEXTS = st.text(alphabet="<|>[]/INSTs\\ a\n", max_size=30)


@settings(max_examples=300, deadline=None)
@given(role=st.sampled_from(["user", "assistant", "system", "tool", "", "<|x|>"]) | TEXTS, text=TEXTS)
def test_turns_round_trip(role, text):
    template = ChatTemplate()
    segments = template.segments(role, text)
    escaped = segments[1][0]
    assert not any(control in escaped for control in template.controls)
    assert template.parse("".join(t for t, _ in segments)) == (role, text)


def test_chat_odd_rows(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", None), (2, None, None, "x"),
        (None, 0, "user", "n"), (3, 0, "user", "long " * 300_000), (3, 1, "assistant", "\\</s>"), (4, 0, "tool", "t"),
        (5, 0, "user", "same"), (5, 0, "user", "same"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat_digests(written_chat(table)).collect()}
    for conv_id in {r[0] for r in rows}:
        turns = [r for r in rows if r[0] == conv_id]
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        held = found[conv_id]
        assert held.n_turns == len(turns)
        assert held.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (held.loss_chars, held.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c for c, r in found.items() if r.valid} == {1, 3}
    assert chat_digests(written_chat(table.limit(0))).count() == 0


# --- pipeline ---------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns
        assert dict(after.dtypes) == dict(docs.dtypes)
        path = llm.scratch_path(spark, "stage")
        after.write.parquet(path)
        before = spark.read.parquet(path)
    kept = {r.doc_id for r in before.collect()}
    scored = {r.doc_id: r.predicted for r in llm.op6_quality(spark, sf_dir).collect()}
    assert kept <= {d for d, p in scored.items() if p == 1}
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.collect()} == kept


def test_pipeline_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
