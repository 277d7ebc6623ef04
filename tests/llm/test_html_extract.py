import html
import re

import pytest

from orbweave.llm import html_extract as h
from tests.llm.helpers import SF


@pytest.fixture(scope="module")
def crf():
    return h.train(h.labelled_pages(h.TRAINING_PAGES))


def test_held_out_pages(crf):
    extractor, right, pages = h.Extractor(crf), 0, h.labelled_pages(200, seed=1234)
    for page in pages:
        want = [b.text[1:].strip() for b in h.leaf_blocks(page, h.Contexts()) if b.text[0] == h.MARK_MAIN]
        right += extractor.main_blocks(page.replace(h.MARK_MAIN, "").replace(h.MARK_REST, "")) == want
    assert right >= 190


def test_viterbi_is_the_best_labelling(crf):
    scores = [0.3, -1.2, 2.0, -0.1, 0.4, -2.0, 0.9]
    t = crf.transitions

    def value(y):
        return sum(s for s, k in zip(scores, y, strict=True) if k) + sum(t[a][b] for a, b in zip(y, y[1:], strict=False))

    best = max(([i >> k & 1 for k in range(7)] for i in range(128)), key=value)
    assert crf.label(scores) == best


def test_small_table(spark):
    """The table's pages keep their main text in one article element; markup inside it is plain."""
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in h.op9_html_extraction(spark, SF).collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", rows[r["page_id"]], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        want = "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert r["text"] == want and r["n_chars"] == len(want)


CASES = {
    None: [], "": [], "   ": [], "<script>var x='<p>no</p>'</script><style>p{}</style>": [],
    "<article><p>Fish &amp; chips&nbsp;&#8211; a&lt;b &notanentity; text goes on.<p>Second\n\n paragraph of text.<br>More of it.</article>": ["Fish & chips – a<b ¬anentity; text goes on.", "Second paragraph of text. More of it."],
    "<main><p>First text of the page, long enough.</p><aside class='sidebar'><p>See also this.</p></aside><p>Last text of the page, long enough.</p></main><footer>© me</footer>": ["First text of the page, long enough.", "Last text of the page, long enough."],
    "<nav><a href='x'>One</a></nav><article><p>Unclosed <b>bold text of a paragraph": ["Unclosed bold text of a paragraph"],
}


def test_odd_pages(spark, crf):
    rows = [(k, None if k % 2 else "http://x", page, "clash") for k, page in enumerate(CASES)] + [(None, None, "<article><p>" + "Long text here. " * 20_000 + "</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["blocks"] for r in h.extract_main_text(pages, crf).collect()}
    assert [got[k] for k in range(len(CASES))] == list(CASES.values())
    assert len(got[None]) == 1 and len(got[None][0]) == 20_000 * 16 - 1
    assert h.extract_main_text(pages.where("false"), crf).collect() == []


def test_hostile_markup(crf):
    extractor = h.Extractor(crf)
    for page in ("<div>" * 30_000 + "<p>text", "<a href=\"x>" * 20_000, "<" * 100_000, "<!--" * 20_000, "</p>" * 50_000, "<p class='" + "a " * 100_000 + "'>t", "<a " * 100_000, "<title>" + "</title " * 50_000, "<template>" * 30_000, "<script>" + "<!--<script>" * 30_000):
        extractor.main_blocks(page)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>one <svg viewBox='0 0 1 1'/> two</p><p>three</p>", ["one two", "three"]),
        ("<p>one <svg-icon name='x'></svg-icon> two</p><object-view>three</object-view><title-bar>four</title-bar>", ["one two", "threefour"]),
        ("<p>one <svg><title>no</title><path d='M0'/><text>label</text></svg> two</p><p>three <svg> four</p>", ["one label two", "three four"]),
        ("<p>a <noscript>b</noscript> c</p><form><textarea>no</textarea></form>", ["a b c"]),
        ("<p>a <a href=/x/>b</a> c</p><div class=y/>d<p>e</p></div>", ["a b c", "d", "e"]),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p><p>c <object>d</object> <canvas>e</canvas></p>", ["a x=2 b", "c d e"]),
        ("<p>a <math/> b</p><p>c <object data='x'> d</p><p>e <canvas> f</p>", ["a b", "c d", "e f"]),
        ("<title>no</title><script >no</script><p>yes</p><SVG\n>too</SVG >", ["yes", "too"]),
    ],
)
def test_only_silent_elements_are_silent(page, want):
    assert [b.text for b in h.leaf_blocks(page, h.Contexts())] == want


def test_a_slash_in_a_link_is_no_end():
    """Links with unquoted addresses that end with a slash still count as links; blocks keep their context."""
    with_slash, plain = (h.leaf_blocks(f"<nav><a href={q}/x/{q}>Some link</a></nav><aside class=menu/><p>text</p></aside>", h.Contexts()) for q in ("", '"'))
    assert [(b.text, b.linked) for b in with_slash] == [(b.text, b.linked) for b in plain] == [("Some link", 9), ("text", 0)]
    contexts = h.Contexts()
    assert "<aside>" in contexts.sets[h.leaf_blocks("<aside class=menu/><p>text</p></aside>", contexts)[0].context]


ARTICLE = "<article><p>First text of the page, long enough.</p>{}<p>Last text of the page, long enough.</p></article>"


@pytest.mark.parametrize(
    "inner",
    [
        "<script>var a = '<p>no</p>'</script foo=1>", "<script>no</script\n>", "<script>no</script/>", "<script>no</SCRIPT a='>' b=\">\">", "<script>no</scripty>no</script\t\n x>", "<script/>no</script>",
        "<script><!-- no --></script>", "<script><!-- <script> no </script> no --></script>", "<script><!-- <script> no </script> no </script >", "<script><!--> no </script>", "<script><!---> no <script></script>", "<script><!-- <scripty> no </script>",
        "<style>p > a {}</style x>", "<style><!-- p {} </style>", "<title>no</title lang=en>", "<textarea><p>no</textarea >", "<iframe><p>no</p></iframe x='y'>", "<noframes><p>no</noframes/>", "<noembed><p>no</noembed>",
        "<!-->", "<!--->", "<!-- no -->", "<!-- no --!>", "<!---->", "<!----!>", "<!-- <!-- no -->", "<!-- no -- > no -->", "<!-- no --- >-->", "<!-- <p>no</p> <script> -->", "<!no>", "<?no?>", "</ no>", "<![CDATA[no]]>",
        "<template><p>no</p></template>", "<template><p>no<template>no</template>no</p></template x=1>", "<template><script>'</template>'</script><!-- </template> -->no</template>",
    ],
)
def test_every_way_to_end_what_holds_no_text(crf, inner):
    assert h.Extractor(crf).main_blocks(ARTICLE.format(inner)) == ["First text of the page, long enough.", "Last text of the page, long enough."]


@pytest.mark.parametrize("inner", ["<!-- open", "<!-- open > open", "<script>open", "<script>open</script", "<script><!-- <script></script>", "<style>open</sty>", "<template>open", "<title>open<p>"])
def test_what_nothing_ends_goes_to_the_end_of_the_page(inner):
    assert [b.text for b in h.leaf_blocks("<p>one</p>" + inner + ("" if inner.endswith("script") else "<p>two"), h.Contexts())] == ["one"]


def test_texts_behind_the_last_tag():
    for page, want in (("<p>one</p>two < three", ["one", "two < three"]), ("<p>one</p>two<!-- three", ["one", "two"]), ("one", ["one"]), ("one<!--", ["one"]), ("1 > 0", ["1 > 0"])):
        assert [b.text for b in h.leaf_blocks(page, h.Contexts())] == want
