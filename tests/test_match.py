import time

import pytest

from shelfspark.operators import selectors as css
from shelfspark.operators.html_nodes import SelectorIndex, match_page
from shelfspark.operators.match import Field, match_selectors


def hits(html, selectors, **want):
    field = Field("x", selectors, **want)
    alts = css.split_selectors(selectors)
    index = SelectorIndex([(0, i, css.compile_selector(s)) for i, s in enumerate(alts)])
    spec = (len(alts), field.text, field.attrs, field.cells, field.first, field.group)
    return match_page(html, index, [spec])[0]


def texts(html, selectors, **want):
    return [(h[0], h[1]) for h in hits(html, selectors, text=True, **want)]


def test_split_drops_empty_parts():
    assert css.split_selectors(" a , ,b c,") == ["a", "b c"]


@pytest.mark.parametrize("bad", ["a > b", "a + b", "a:first-child", "a[", "a[b~='c']"])
def test_selectors_outside_the_grammar_are_refused(bad):
    with pytest.raises(ValueError):
        css.compile_selector(bad)


@pytest.mark.parametrize("selector, expected", [
    ("p", ["one", "two", "three"]),
    (".a", ["one", "two"]),
    ("p.a.b", ["two"]),
    ("#x", ["three"]),
    ("[data-k]", ["one", "three"]),
    ("[data-k='v w']", ["three"]),
    ("[data-k*=\"w\"]", ["three"]),
    ("div p", ["two", "three"]),
    ("div.outer div p", ["three"]),
    ("div div.outer p", []),
    (".a\\.b", ["four"]),
    ("span, #x", ["four", "three"]),
])
def test_selector_forms(selector, expected):
    html = """<p class="a" data-k>one</p><div class="outer"><p class="b  a">two</p><div><p id=x data-k='v w'>three</p></div></div>
    <span class="a.b">four</span>"""
    assert [t for _, t in texts(html, selector)] == expected


def test_text_runs_are_stripped_and_joined_without_a_gap():
    assert texts("<p> a <b> b </b>c &amp; d <!-- no --> e</p>", "p") == [(0, "abc & de")]


def test_style_text_counts_and_markup_inside_scripts_does_not():
    html = "<div id=d><style>p{x}</style>t<script>'<h1>no</h1></div>'</script></div><h1>yes</h1>"
    assert texts(html, "#d, h1") == [(0, "p{x}t'<h1>no</h1></div>'"), (1, "yes")]


def test_implied_and_unmatched_end_tags():
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>", "li") == [(0, "a"), (0, "bcd"), (0, "c")]
    assert texts("<p>a<p>b<div>c</div>d", "p") == [(0, "a"), (0, "b")]
    assert texts("<p>a</i> b</p>", "p") == [(0, "a b")]
    assert texts("<div><b>a</div><p>b</p>", "p") == [(0, "b")]
    assert texts("<p>open <b>to the end", "p") == [(0, "opento the end")]


def test_rows_take_their_first_two_cells():
    html = "<table><tr><th>K<td>V <b>w</b><td>x<tr><td>solo</table><tr><td>no table</tr>"
    assert [h[3] for h in hits(html, "tr", cells=True)] == [["K", "Vw"], ["solo"]]


def test_attributes_first_one_wins_and_entities_decode():
    html = """<a HREF="x?a=1&amp;b" href=y data-q='"'>t</a><img src=a.png/>"""
    assert [h[2] for h in hits(html, "a, img", attrs=("href", "data-q", "src"))] == [
        ["x?a=1&b", '"', None], [None, None, "a.png/"]]


def test_first_keeps_one_node_per_alternative_and_group_counts_nodes_once():
    html = "<p class=a>1</p><p>2</p><i class=a>3</i>"
    assert texts(html, ".a, p", first=True) == [(0, "1"), (1, "1")]
    assert len(hits(html, ".a, p", group=True)) == 3


@pytest.mark.parametrize("tail", ["", "x <b>"])
@pytest.mark.parametrize("token", [
    "<a =", "<a =x y", "<a ", "<a", "aaaa", "<aaaa", '<a b="', "<a b='", "</x", "</b>", "<!--", "<", "<a =\"'", "<div>", "<b><i>", "&amp;", "<td>", "<script>", "<a b=c ",
])
def test_a_megabyte_of_any_token_takes_linear_time(token, tail):
    html = token * (1_000_000 // len(token)) + tail + "<h1>x</h1>"
    start = time.process_time()
    assert hits(html, "h1") is not None
    assert time.process_time() - start < 3


def test_a_closing_tag_behind_a_wall_costs_nothing():
    html = "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000
    start = time.process_time()
    assert hits(html, "h1") == []
    assert time.process_time() - start < 3


def test_deep_nesting_loses_no_text():
    page = "<div>" * 2000 + "<p class=v>A <b>B</b> C <i>D</i> E</p>"
    assert texts(page, ".v") == [(0, "ABCDE")]


def test_null_page_and_column_shape(spark):
    pages = spark.createDataFrame([(1, None), (2, "<h1>x</h1><a href=u>v</a>")], "id int, html string")
    rows = match_selectors(pages, [Field("h", "h1", text=True), Field("l", "a", attrs=("href", "data-x"))]).orderBy("id").collect()
    assert (rows[0].h, rows[0].l) == ([], [])
    assert rows[1].h[0].asDict() == {"alt": 0, "text": "x"}
    assert rows[1].l[0].asDict() == {"alt": 0, "href": "u", "data_x": None}
