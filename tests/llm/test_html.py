"""Main text of pages: exact marginals, and pages whose text is known."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from accessgeo.llm import html_extraction as h
from accessgeo.llm import queries


@pytest.fixture(scope="module")
def model():
    return h.fit(h.labelled_pages(400))


@pytest.mark.parametrize("seed", range(4))
def test_marginals_equal_the_sum_over_all_labellings(seed):
    rng = np.random.default_rng(seed)
    f = h.forest([h.parse("<div><p>a b<p>c<ul><li>d</ul></div><div>e</div>"), h.parse("x")])
    n = len(f.parent)
    model = h.Model(rng.normal(0, 1, h.BUCKETS), rng.normal(0, 1, h.DENSE), rng.normal(0, 1, (h.KIND_COUNT, 2, 2)))
    score = model.potentials(f)
    total, ones = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(score[k] * y[k] + (model.edges[f.kind[k], y[f.parent[k]], y[k]] if f.parent[k] >= 0 else 0) for k in range(n)))
        total, ones = total + w, ones + w * np.array(y)
    assert np.allclose(model.marginals(f)[0], ones / total)


def test_pages_of_unseen_layouts(model):
    pages = h.labelled_pages(150, seed=99)
    hits = wrong = missed = 0
    for (page, wanted), text in zip(pages, h.extract(model, [p for p, _ in pages]), strict=True):
        found = set(text.split("\n\n")) - {""}
        hits, wrong, missed = hits + len(found & wanted), wrong + len(found - wanted), missed + len(wanted - found)
    assert hits / (hits + wrong) > 0.97 and hits / (hits + missed) > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site</h1><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Menu entry</a></li></ul></nav></header>
<article><h1>Fish &amp; chips&#33;</h1><p>One   <b>bold</b>
 line &lt;here&gt; with more words in it than most.</p><p>A second paragraph, &eacute;t&eacute;, follows the first one.</p></article>
<aside class="sidebar"><p>Buy this now.</p></aside><div class="comments"><p>I am a reader and I say this.</p></div><footer><p>Copyright someone</p></footer></body></html>"""


def test_the_article_is_kept_and_the_rest_is_not(model):
    assert h.extract(model, [PAGE.format()]) == ["Fish & chips!\n\nOne bold line <here> with more words in it than most.\n\nA second paragraph, été, follows the first one."]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")


def test_nulls_empty_broken_long_and_repeated_pages(spark):
    long = "<article>" + "<p>Some words of a long page, told again.</p>" * 20_000 + "</article>"
    deep = "<div>" * 3_000 + "deep"
    rows = [(1, None, None), (2, "u", ""), (3, None, "<"), (4, "u", "<p"), (5, "u", "no markup at all"), (6, "u", long), (7, "u", deep), (8, "u", PAGE.format()), (8, "u", PAGE.format()), (None, "u", "</p></div><!-- open")]
    got = h.main_text(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by_id = {r["page_id"]: r["text"] for r in got}
    assert by_id[1] == by_id[2] == "" and by_id[6].count("\n\n") == 19_999
    assert [r["text"] for r in got if r["page_id"] == 8] == [by_id[8]] * 2


@pytest.mark.parametrize("tag", ['<p title="oops>', "<p title='oops>", '<p class=a title="b" id="c>'])
def test_quotes_that_never_close_leave_no_markup(model, tag):
    page = f"<html><body><article>{tag}Hello there world, this is the first paragraph of it.</p><p>And this one follows the first.</p></article></body></html>"
    (text,) = h.extract(model, [page])
    assert "<" not in text and "oops" not in text and "id=" not in text and "follows the first" in text


def test_very_deep_pages(model):
    (text,) = h.extract(model, ["<body>" + "<section>" * 20_000 + "<p>Deep below all of these sections stands one sentence of text.</p>"])
    assert text == "Deep below all of these sections stands one sentence of text."


def test_empty_table(spark):
    assert h.main_text(frame(spark, [])).count() == 0


def test_query_reads_every_page(spark):
    from .conftest import SF_DIR

    got = queries.op2_html(spark, SF_DIR).collect()
    assert len(got) == spark.read.parquet(f"{SF_DIR}/pages.parquet").count()
    assert all("<" not in r["text"] or "&lt;" for r in got) and sum(r["n_chars"] > 0 for r in got) > 0.9 * len(got)
