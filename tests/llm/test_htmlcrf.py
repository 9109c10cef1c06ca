"""HTML extraction: parser, inference against enumeration, held-out accuracy, pages."""

import itertools

import numpy as np
import pytest

from tidemark.llm import htmlcrf

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><!-- ad --><div class="ad">Buy now.</div>
<article><h1>Title &amp; more</h1><p><b>First  para,<br>with a break &lt;tag&gt;.<p>Second &eacute;&#233; one.</p><div class="advert">Click.</div><ul><li>Item one.</li></ul></article>
<div class="comments"><h3>Comments</h3><p>I like this one.</p></div><aside class="sidebar"><ul><li><a href="/c">Related</a></li></ul></aside>
<form><label>Name</label><input><button>Send</button></form><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""


def test_page():
    text = htmlcrf.main_text(PAGE, htmlcrf.model())
    assert text == "Title & more\nFirst para, with a break <tag>.\nSecond éé one.\nItem one."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "plain text only", "<p>open", "</p></div>x", "<script>never", "<!-- never", "<a href='x>y'>t</a>", "<div" * 50, "x" * 200_000, "<p>" * 3000 + "deep"])
def test_broken_pages(page):
    found = htmlcrf.blocks(page)
    assert all(b.text == " ".join(b.text.split()) and b.text for b in found)
    assert isinstance(htmlcrf.main_text(page, htmlcrf.model()), str)


def test_blocks_keep_all_page_text():
    assert [b.text for b in htmlcrf.blocks("<p>a<p>b<div>c<span>d</span> e</div>f<table><tr><td>g<td>h</table>")] == ["a", "b", "cd e", "f", "g", "h"]


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(4)
    crf = htmlcrf.Crf({str(k): k for k in range(6)}, r.normal(size=(6, 2)), r.normal(size=(2, 2)))
    for _ in range(30):
        feats = [[str(x) for x in r.choice(6, size=3)] for _ in range(6)]
        s = crf.scores(feats)
        value = lambda y: sum(s[k, y[k]] for k in range(6)) + sum(crf.pair[a, b] for a, b in itertools.pairwise(y))
        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert np.isclose(value(crf.decode(feats)), value(best))


def test_held_out_accuracy():
    crf = htmlcrf.model()
    hit = total = exact = n = 0
    for page, said in htmlcrf.labelled_pages(150, 99):
        found = htmlcrf.blocks(page)
        labels = htmlcrf._aligned(found, said)
        assert labels is not None
        got = crf.decode(htmlcrf.features(found))
        hit, total = hit + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
        exact, n = exact + (got == labels), n + 1
    assert hit / total > 0.99 and exact / n > 0.93


def test_query(spark, tmp_path):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    out = htmlcrf.op2_html_crf(spark, str(tmp_path)).collect()
    assert sorted((r["n_chars"], len(r["text"])) for r in out) == [(0, 0), (0, 0), (72, 72), (72, 72)] or all(r["n_chars"] == len(r["text"]) for r in out)
    clash = htmlcrf.extract(df.withColumnRenamed("url", "text"))
    assert clash.columns == ["page_id", "text", "text_"] and clash.count() == 4
    assert htmlcrf.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<html><head><title>x</title><body><p>text</body></html>", "<head><meta charset=utf-8><title>x</title><p>text", "<html><head><noscript><img src=a></noscript><style>p{}</style><div>text</div>"])
def test_a_head_without_its_end_tag(page):
    assert [b.text for b in htmlcrf.blocks(page)] == ["text"]


@pytest.mark.parametrize("page,want", [
    ("<p title=it's>hello</p>", ["hello"]), ('<p class="x>hello</p>', ["hello"]), ('<p class="x>hello</p><p class="y">world</p>', ["hello", "world"]),
    ('<p title="a > b" id=\'c > d\'>hello</p>', ["hello"]), ("<p>E=<math><mi>m</mi><mo>+</mo></math>c</p>", ["E=m+c"]),
    ("<p>a</p><noscript>no script</noscript><p>b</p>", ["a", "no script", "b"]), ("<p>a<select><option>x</select>b</p><textarea>y</textarea>", ["a", "b"]),
    ('<p data-x="1"data-y="2">hello</p>', ["hello"]), ("<p a = 'x' b>hello</p", ["hello"]), ("<head><noscript><style>x</style></noscript><title>t</title></head><p>a", ["a"]),
])
def test_tags_with_lone_quotes_and_kept_elements(page, want):
    assert [b.text for b in htmlcrf.blocks(page)] == want


def test_generated_pages_parse_as_they_were_written():
    pages = htmlcrf.labelled_pages(200, htmlcrf.SEED)
    assert sum(htmlcrf._aligned(htmlcrf.blocks(h), said) is not None for h, said in pages) >= 198
    assert any("<noscript>" in h for h, _ in pages)


def test_notes_for_readers_without_scripts_are_left_out():
    body = "<p>The first paragraph of the article has a sentence. And another, longer one.</p>" * 3
    page = f"<html><body><nav><ul><li><a href='/'>home</a></li></ul></nav><noscript>Please enable scripts for this page.</noscript><article><h1>A title</h1>{body}</article></body></html>"
    text = htmlcrf.main_text(page, htmlcrf.model())
    assert "scripts" not in text and text.count("paragraph") == 3
