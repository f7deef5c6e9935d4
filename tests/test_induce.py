import random
import re

from shelfspark.operators import html_nodes, induce, repair
from shelfspark.operators import selectors as css


def page(i, drift=True):
    price = f"{i}.50"
    return f"""<html><body><nav><a href="/">Home</a></nav><main id="m{i}">
<h1 class="headline big"><span>Item {i}</span></h1>
<p class="made-by">Maker {i % 3}</p><div class="offer"><b class="now">${price}</b> <s class="was">${i + 1}.00</s></div>
<form data-item="SKU-{i}"><i>x</i></form><div class="also"><p class="name">Item {i + 1}</p></div><ul><li>1<li class="again">Item {i}</ul></main>"""


KNOWN = "url string, field string, value string"


def known_rows(n):
    rows = []
    for i in range(n):
        rows += [(f"u{i}", "name", f"Item {i}"), (f"u{i}", "price", f"{i}.5"), (f"u{i}", "sku", f"SKU-{i}"), (f"u{i}", "brand", f"Maker {i % 3}" if i % 4 else None)]
    return rows


def proposals(spark, n=12, **settings):
    pages = spark.createDataFrame([(f"u{i}", page(i)) for i in range(n)] + [("none", None), ("other", page(99))], "url string, html string")
    return induce.propose_selectors(pages, spark.createDataFrame(known_rows(n), KNOWN), **settings)


def test_the_right_selector_ranks_first(spark):
    best = {r.field: r for r in proposals(spark).filter("rank = 1").collect()}
    assert {f: (r.selector, r.take, r.hits, r.errors, r.misses) for f, r in best.items()} == {
        "name": (".big", "text", 12, 0, 0), "price": (".now", "text", 12, 0, 0), "sku": ("[data-item]", "data-item", 12, 0, 0), "brand": (".made-by", "text", 9, 0, 0)}


def test_counts_like_brute_force(spark):
    """Every proposal's counts against one page and one selector at a time."""
    values = {(u, f): v for u, f, v in known_rows(12) if v}
    for r in proposals(spark).filter("take = 'text'").collect():
        hits = errors = misses = 0
        for i in range(12):
            if (f"u{i}", r.field) not in values:
                continue
            index = html_nodes.SelectorIndex([(0, 0, css.compile_selector(r.selector))])
            found = html_nodes.match_page(page(i), index, [(1, True, (), False, True, False)])[0]
            shown, value = (found[0][1] if found else ""), values[f"u{i}", r.field]
            same = shown == value or r.field == "price" and re.fullmatch(r"\$\d+\.\d+", shown) is not None and float(shown[1:]) == float(value)
            hits, errors, misses = hits + same, errors + (not same and shown != ""), misses + (not same and shown == "")
        assert (r.hits, r.errors, r.misses) == (hits, errors, misses), r


def test_candidates_on_one_page():
    html = '<div class="a b,c" id="x.y"><p title="long one">v <b>1</b></p></div><p>other</p>'
    found = induce.page_candidates(html, [("name", "v 1"), ("brand", ""), ("sku", None)])
    assert ("name", "text", ".a") in found and ("name", "text", "#x\\.y") in found and ("name", "text", ".a p") in found and ("name", "text", "[title]") in found
    assert not any("," in s or "long one" in s for _, _, s in found) and {f for f, _, _ in found} == {"name"}
    assert induce.page_candidates("", [("name", "v")]) == set()


def test_damaged_and_long_pages():
    rng = random.Random(1)
    junk = "".join(rng.choice(["<p>", "</b>", "<div class='q'>", "text ", "<", "&amp;", "</div>", "<!--", "\x00"]) for _ in range(20_000))
    assert induce.page_candidates(junk, [("name", "text")]) is not None


def test_few_candidates_and_no_pages(spark):
    assert proposals(spark, considered=1).groupBy("field").count().filter("count > 1").isEmpty()
    empty = spark.createDataFrame([], "url string, html string")
    assert induce.propose_selectors(empty, spark.createDataFrame(known_rows(2), KNOWN)).collect() == []
    assert induce.propose_selectors(empty, spark.createDataFrame([], KNOWN)).collect() == []


def test_proposals_answer_repair_requests(spark):
    answers = induce.proposal_answers(proposals(spark), limit=2)
    events = spark.createDataFrame([("name", (0, 0, i), f"u{i}") for i in range(6)], "field string, seq struct<cat_idx: int, page_num: long, pos: int>, url string")
    report = repair.repair_report(events, answers).first()
    assert report.field == "name" and report.suggested[0] == ".big" and len(report.suggested) == 2
