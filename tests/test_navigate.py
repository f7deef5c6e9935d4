import random

import pytest

from shelfspark.operators import navigate
from shelfspark.operators.match import listing_fields, match_selectors

EDGES = "url string, links array<string>, n_links int, next_url string"
CATS = "cat_idx int, name string, url string"


def plain_walk(start, pages, cap=None):
    """One page after the other, as the truth: (visited pages, yielded links)."""
    visited, found, url = [], [], start
    while url is not None and url not in visited and url in pages:
        links, following = pages[url]
        visited.append(url)
        for link in links:
            if cap is not None and len(found) >= cap:
                return visited, found
            found.append(link)
        url = following if following != url else None
    return visited, found


def walk(spark, cats, pages, cap):
    edges = spark.createDataFrame([(u, l, len(l), n) for u, (l, n) in pages.items()], EDGES)
    categories = spark.createDataFrame([(i, f"c{i}", u) for i, u in enumerate(cats)], CATS)
    walked = navigate.walk_pagination(categories, edges, cap)
    found = navigate.frontier(walked, edges, cap).collect()
    visits = walked.orderBy("cat_idx", "page_num").collect()
    return (
        [[r.url for r in visits if r.cat_idx == i] for i in range(len(cats))],
        [[r.url for r in sorted(found, key=lambda r: r.seq) if r.cat_idx == i] for i in range(len(cats))],
    )


def check(spark, cats, pages, cap):
    visits, found = walk(spark, cats, pages, cap)
    for i, start in enumerate(cats):
        expected = plain_walk(start, pages, cap)
        assert (visits[i], found[i]) == expected, (start, cap)


def test_sizes_three_two_nine_with_cap_five(spark):
    pages = {"a": (["1", "2", "3"], "b"), "b": (["4", "1"], "c"), "c": ([str(i) for i in range(20, 29)], "d"), "d": (["9"], None)}
    visits, found = walk(spark, ["a"], pages, 5)
    assert visits == [["a", "b", "c"]]
    assert found == [["1", "2", "3", "4", "1"]]


@pytest.mark.parametrize("cap", [None, 0, 1, 4])
def test_cycles_self_links_missing_pages_and_empty_listings(spark, cap):
    pages = {
        "loop": (["1"], "loop2"), "loop2": ([], "loop"), "self": (["2", "3"], "self"), "dead": (["4"], "nowhere"),
        "empty": ([], "e2"), "e2": ([], "e3"), "e3": (["5", "6", "7", "8", "9"], None), "rho": (["0"], "loop"),
    }
    check(spark, ["loop", "self", "dead", "empty", "rho", "absent"], pages, cap)


def test_long_chains_like_a_sequential_walk(spark):
    rng = random.Random(5)
    pages = {}
    for c, length in (("x", 137), ("y", 41)):
        for i in range(length):
            following = f"{c}{i + 1}" if i + 1 < length else rng.choice([None, f"{c}3"])
            pages[f"{c}{i}"] = ([f"{c}{i}-{j}" for j in range(rng.randint(0, 3))], following)
    for cap in (None, 30):
        check(spark, ["x0", "y0", "x100"], pages, cap)


def test_repeated_rows_of_a_page_do_not_stop_the_walk(spark):
    pages = {f"p{i}": ([f"l{i}"], f"p{i + 1}" if i < 15 else None) for i in range(16)}
    rows = [(u, l, len(l), n) for u, (l, n) in pages.items()] * 2
    edges = spark.createDataFrame(rows, EDGES)
    categories = spark.createDataFrame([(0, "c", "p0")], CATS)
    walked = navigate.walk_pagination(categories, edges)
    assert walked.count() == 16
    assert sorted(r.url for r in navigate.frontier(walked, edges).collect()) == sorted(f"l{i}" for i in range(16))


def test_links_from_pages(spark):
    html = """<a class="result" href="/product/b">x</a><a class="result" href="?p=1">n</a><a class="result" href="/product/a#top">n</a>
    <link itemprop="url" content="https://h.com/product/a"><a class="result" href="../product/b">again</a><a class="result">none</a>
    <link itemprop="url" href="" content="/x.html">
    <li class="ais-Pagination-item--nextPage"><a>no href</a><a href="/ignored">second</a></li>
    <a class="ais-Pagination-link" aria-label="Go Next" href="?page=2">&gt;</a>"""
    pages = spark.createDataFrame([("https://h.com/catalog/c", html), ("https://h.com/x", "")], "url string, html string")
    rows = {r.url: r for r in navigate.product_links(match_selectors(pages, listing_fields())).collect()}
    row = rows["https://h.com/catalog/c"]
    assert row.links == ["https://h.com/product/b", "https://h.com/product/a", "https://h.com/x.html"]
    assert (row.n_links, row.next_url) == (3, "https://h.com/catalog/c?page=2")
    assert (rows["https://h.com/x"].links, rows["https://h.com/x"].next_url) == ([], None)


def test_unseen_takes_the_first_arrival_and_the_first_category(spark):
    frontier = spark.createDataFrame(
        [("u", (1, 0, 0), "second"), ("u", (0, 5, 1), "first"), ("u", (0, 5, 3), "first"), ("old", (0, 0, 0), "first")],
        "url string, seq struct<cat_idx:int,page_num:bigint,pos:int>, category string")
    seen = spark.createDataFrame([("old",)], "url string")
    rows = navigate.unseen(frontier, seen).collect()
    assert [(r.url, tuple(r.seq), r.category_path) for r in rows] == [("u", (0, 5, 1), ["first"])]
    pages = spark.createDataFrame([("old", 1)], "url string, x int")
    assert [r.url for r in navigate.fetch_misses(navigate.unseen(frontier), pages).collect()] == ["u"]
    assert [r.x for r in navigate.attach_pages(navigate.unseen(frontier), pages).collect()] == [1]


def test_walk_does_not_parse_or_cross_join(spark):
    frontier = spark.createDataFrame([("u", (1, 0, 0), "c")], "url string, seq struct<cat_idx:int,page_num:bigint,pos:int>, category string")
    plan = navigate.unseen(frontier, spark.createDataFrame([("old",)], "url string"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
