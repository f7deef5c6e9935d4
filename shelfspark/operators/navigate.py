"""Listing pages -> product URL frontier.

All inputs come from one selector pass over the pages (see `match.listing_fields`); nothing here
parses HTML. `seq` = (cat_idx, page_num, pos) carries the arrival order through every later step.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import URL_DENY
from ..functions.products import compute_once, not_in
from ..functions.running import rows_before
from ..functions.urls import is_product_url_sql, resolve_all_sql, split_url
from ..plans.scratch import materialize, materialize_counted

#: Listing pages of a category that one running total covers; totals of blocks come first.
PAGES_PER_BLOCK = 1024


def product_links(matched: DataFrame, deny=URL_DENY) -> DataFrame:
    """Listing edges, one row per page: url, links (first occurrence per page), n_links, next_url."""
    refs = "array_compact(transform(product_link, h -> coalesce(nullif(h.href, ''), nullif(h.content, ''))))"
    kept = f"array_distinct(filter({resolve_all_sql('_base', 'url', refs)}, u -> {is_product_url_sql('u', deny)}))"
    return (
        compute_once(matched.withColumn("_base", split_url("url")), [F.expr(kept).alias("links"), next_page().alias("next_url")], ["url"])
        .select("url", "links", F.size("links").alias("n_links"), "next_url")
    )


def next_page(hits: str = "next_page", base: str = "_base", url: str = "url") -> Column:
    """First alternative whose first node has a link; resolved."""
    ref = f"slice(transform(filter({hits}, h -> h.href <> ''), h -> h.href), 1, 1)"
    return F.expr(f"get({resolve_all_sql(base, url, ref)}, 0)")


def one_per_url(edges: DataFrame) -> DataFrame:
    """`edges` with one row per URL. `match_site` gives unique pages; a repeated row of any other source must not stop a walk."""
    best = edges.groupBy("url").agg(F.max(F.struct("n_links", "links", "next_url")).alias("_best"))
    return best.select("url", "_best.links", "_best.n_links", "_best.next_url")


def walk_pagination(categories: DataFrame, edges: DataFrame, cap: int | None = None) -> DataFrame:
    """Listing pages in visiting order: cat_idx, name, page_num, url, n_links, prior_links.

    Follows next links from each category URL; stops without a link, on a self-link, on a page visited
    before in this category, or where the page is absent. With a `cap`, a page is visited only while the
    links of the pages before it do not exceed the cap.

    Each round doubles the reach: `jumps` maps a page to the one 2^k links further on, and every known
    page is joined to it. So a chain of n pages takes log2(n) rounds of even joins on url, whatever n is.
    A page met again keeps its first number, and a round that adds nothing ends the walk.
    """
    edges = one_per_url(edges)
    # Only pages that something points to can be visited: this leaves the listing pages.
    pointed_at = categories.select("url").unionAll(edges.filter("next_url is not null").select("next_url")).distinct()
    steps = materialize(
        edges.select("url", "n_links", "next_url").join(pointed_at, "url", "left_semi"), "listings")
    sizes = steps.select("url", "n_links")
    jumps = steps.filter("next_url is not null and next_url <> url").select("url", F.col("next_url").alias("target"))
    reached, known = materialize_counted(
        categories.select("cat_idx", "name", "url").join(sizes, "url")
        .select("cat_idx", "name", F.lit(0).cast("bigint").alias("page_num"), "url", "n_links").distinct(),
        "walk",
    )
    reach = 1
    while _any_open(reached, cap):
        ahead = (
            _open_categories(reached, cap).drop("n_links").join(jumps, "url")
            .select("cat_idx", "name", (F.col("page_num") + reach).alias("page_num"), F.col("target").alias("url"))
            .join(sizes, "url")
        )
        reached, total = materialize_counted(
            reached.unionByName(ahead)
            .groupBy("cat_idx", "url")
            .agg(F.min("page_num").alias("page_num"), F.min("name").alias("name"), F.min("n_links").alias("n_links")),
            "walk",
        )
        if total == known:
            break
        known, reach = total, reach * 2
        second = jumps.select(F.col("url").alias("target"), F.col("target").alias("_next"))
        jumps = materialize(jumps.join(second, "target").select("url", F.col("_next").alias("target")).distinct(), "jumps")

    walked = reached.select("cat_idx", "name", "page_num", "url", "n_links")
    if cap is None:
        return walked.withColumn("prior_links", F.lit(0).cast("bigint"))
    counted = walked.withColumn("_block", F.floor(F.col("page_num") / PAGES_PER_BLOCK)).withColumn("n", F.col("n_links"))
    placed = rows_before(counted, ["cat_idx"], "_block", "page_num").withColumnRenamed("before", "prior_links")
    return placed.filter(F.col("prior_links") <= cap).drop("_block", "n")


def _full_categories(reached: DataFrame, cap: int) -> DataFrame:
    """Categories whose links exceed the cap: their walk is over."""
    return reached.groupBy("cat_idx").agg(F.sum("n_links").alias("_links")).filter(F.col("_links") > cap).select("cat_idx")


def _open_categories(reached: DataFrame, cap: int | None) -> DataFrame:
    return reached if cap is None else reached.join(_full_categories(reached, cap), "cat_idx", "left_anti")


def _any_open(reached: DataFrame, cap: int | None) -> bool:
    return cap is None or not _open_categories(reached, cap).isEmpty()


def empty_listings(walked: DataFrame) -> DataFrame:
    """Visited listing pages without any product link: the selectors may have drifted."""
    return walked.filter("n_links = 0").select("cat_idx", "page_num", "url")


def cap_per_category(links: DataFrame, cap: int) -> DataFrame:
    """First `cap` links of each category; repeats count. No window over links: a link's rank is the
    number of links on earlier pages plus its position."""
    return links.filter(F.col("prior_links") + F.col("pos") < cap)


def frontier(walked: DataFrame, edges: DataFrame, cap: int | None = None) -> DataFrame:
    """Product URLs in arrival order: cat_idx, category, page_num, pos, url, seq. Repeats are kept."""
    links = (
        walked.drop("n_links").join(one_per_url(edges).select("url", "links"), "url")
        .select("cat_idx", F.col("name").alias("category"), "page_num", "prior_links", F.posexplode("links").alias("pos", "url"))
    )
    if cap is not None:
        links = cap_per_category(links, cap)
    return links.withColumn("seq", F.struct("cat_idx", "page_num", "pos")).select(
        "cat_idx", "category", "page_num", "pos", "url", "seq")


def unseen(frontier_links: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """First arrival of each URL that no earlier run has marked: url, seq, category_path. Stores the arrivals."""
    firsts = frontier_links.groupBy("url").agg(F.min(F.struct("seq", "category")).alias("_first"))
    arrivals = materialize(
        firsts.select("url", F.col("_first.seq").alias("seq"), F.array("_first.category").alias("category_path")), "arrivals")
    return arrivals if seen is None else not_in(arrivals, seen, "url")


def attach_pages(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier URLs with their page row. Pass matched pages (hits, no HTML): then no HTML is shuffled."""
    return urls.join(pages, "url")


def fetch_misses(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier URLs without a page; they are dropped and not marked."""
    return urls.join(pages.select("url"), "url", "left_anti")
