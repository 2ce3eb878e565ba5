"""HTML extraction: marks and frames, host counts by brute force, time of odd pages."""

import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wayloom.llm import html_extract
from wayloom.llm.html_extract import Page


@pytest.mark.parametrize(
    ("source", "blocks"),
    [
        ('<div class="page has-sidebar"><article><p>own text</p></article></div>', ["own text"]),
        ('<div class="promo"><main><div class="ad"><article>own</article></div></main></div>', ["own"]),
        ('<form id="aspnetForm"><div><p>a</p></div><p>b</p></form>', ["a", "b"]),
        ("<form><article><p>own</p></article><input><p>search</p></form>", ["own"]),
        ('<article class="post share"><p>x</p></article>', ["x"]),
        ('<main id="related-content"><p>x</p><p>y</p></main>', ["x", "y"]),
        ('<article>own</article><article class="comment">theirs</article>', ["own"]),
        ('<div class="layout-sidebar"><article>own</article><div class="comments"><article>theirs, and much longer</article></div></div>', ["own"]),
        ('<main><p>own</p><section class="comments"><p>theirs, and much longer</p></section></main>', ["own"]),
        ('<main><div hidden><p>not seen, and much longer</p></div><p>own</p></main>', ["own"]),
        ('<article><div class="ad">buy</div></article>', []),
        ("<aside><article>promo</article></aside><div>own</div>", ["own"]),
        ("<head><title>t</title><body><p>own</p>", ["own"]),
        ("<article>own<aside><article>promo</article></aside></article>", ["own"]),
    ],
)
def test_marks_stop_at_the_articles_frame(source, blocks):
    assert Page(source).blocks == blocks


def test_headings_and_quotations_of_articles_are_no_template(spark):
    rows = [(i, f"http://r.example/{i}", f"<article><h1>Recipe {i}</h1><h2>Ingredients</h2><blockquote>Always wash your hands</blockquote><div>Rate this</div><p>own text {i} that is by far longer than all that recurs in its article</p></article>") for i in range(10)]
    got = {r.page_id: r for r in html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4].text.split("\n") == ["Recipe 4", "Ingredients", "Always wash your hands", "own text 4 that is by far longer than all that recurs in its article"]
    assert (got[4].n_template, got[4].n_other) == (1, 0)


def test_what_recurs_goes_where_no_word_says_so(spark):
    """Unmarked boxes: the same text on all pages, or the same shape outside the article with other text each time."""
    page = "<div class=x1><span>Choose a town</span></div><div class=x2>offer {0} of the day</div><main><p>own text {0} that is rather long</p></main>"
    flat = "<div>Choose a town</div><div><p>own text {0} that is rather long</p></div>"
    rows = [(i, f"http://s.example/{i}", page.format(i)) for i in range(6)] + [(10 + i, f"http://t.example/{i}", flat.format(i)) for i in range(6)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    with_method = {r.page_id: r for r in html_extract.html_extract(d).collect()}
    without = {r.page_id: r for r in html_extract.html_extract(d, min_pages=10**9).collect()}
    assert (with_method[2].n_template, with_method[2].n_other) == (2, 0) and (without[2].n_template, without[2].n_other) == (0, 2)
    assert with_method[12].text == "own text 2 that is rather long" and without[12].text == "Choose a town\nown text 2 that is rather long"


def test_host_counts_are_those_of_a_plain_count(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").union(spark.read.parquet(f"{data}/pages.parquet").limit(20))
    rows = pages.select("page_id", "url", "html", html_extract.host_of().alias("host")).collect()
    on, sites, want = defaultdict(Counter), Counter(), {}
    for r in rows:
        sites[r.host] += 1
        on[r.host].update(Page(r.html or "").counted())
    for r in rows:
        p = Page(r.html or "")
        again = {h: n for h, n in on[r.host].items() if n >= 5 and n >= 0.2 * sites[r.host]}
        kept, n_template, n_other = html_extract.decide(p.all_blocks, p.open_nodes(), p.inside, again)
        want[r.page_id] = ("\n".join(kept), n_template, n_other)
    got = html_extract.html_extract(pages).collect()
    assert len(got) == len(rows) and {r.page_id: (r.text, r.n_template, r.n_other) for r in got} == want
    assert any(r.n_template for r in got)


def test_odd_pages_take_time_in_proportion_to_their_length():
    for make in (
        lambda n: "<div><aside></b>" * n,
        lambda n: "<article>" + "".join(f"<div>t{i}" for i in range(n)) + "</article>",
        lambda n: "<ul>" + "<div>" * (n // 3) + "<li>x</li>" * n,
        lambda n: '<a "' + '>"' * (2 * n + 1),
    ):
        began = time.time()
        Page(make(20_000)).blocks  # noqa: B018
        assert time.time() - began < 5


def test_null_empty_and_clashing_columns(spark):
    rows = [(1, None, None, 1, "a"), (None, "x", "", 2, "b"), (2, "http://h.example", "<p>" + "long " * 300_000, 3, "c"), (2, "http://h.example", "plain", 4, "d"), (2, "http://h.example", "plain", 4, "d")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, key int, host string")
    got = sorted(((r.page_id, r.url, r.n_chars) for r in html_extract.html_extract(d).collect()), key=repr)
    assert got == sorted([(1, None, 0), (None, "x", 0), (2, "http://h.example", 1_499_999), (2, "http://h.example", 5), (2, "http://h.example", 5)], key=repr)
    assert html_extract.html_extract(d.filter(F.lit(False))).count() == 0
