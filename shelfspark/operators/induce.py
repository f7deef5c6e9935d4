"""Selector proposals from pages whose values are known: for fields whose selectors find nothing any more.

Nodes that show a known value give candidate selectors, counted over all pages. The most frequent are then matched on every
page like any other selector, and ranked by how often their first node gives the value and how often another one.
"""

import re
import sys
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_description, parse_price, strip
from ..plans.scratch import materialize
from .match import Field, match_selectors, page_texts, release, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Candidates of a field that are matched on every page.
CONSIDERED = 60
TEXT = "text"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES_ITSELF = frozenset("dd dt li option p td th tr".split())
_SPACE = re.compile(r"\s+")
_PLAIN = re.compile(r"[\w-]+\Z")


def _escaped(name: str) -> str:
    return re.sub(r"([^\w-])", r"\\\1", name)


def simple_selectors(tag: str, attrs: dict) -> list[str]:
    """What one element can be told by: classes, id, attributes and the tag; none with a comma, which separates alternatives."""
    named = [f".{_escaped(c)}" for c in (attrs.get("class") or "").split()]
    named += [f"#{_escaped(attrs['id'])}"] if attrs.get("id") else []
    for name, value in attrs.items():
        if name not in ("class", "id", "style") and _PLAIN.match(name):
            named.append(f"[{name}]")
            if value and len(value) <= 40 and "'" not in value and "]" not in value:
                named.append(f"[{name}='{value}']")
    return [s for s in dict.fromkeys([*named, tag]) if "," not in s and not _SPACE.search(s)]


def _close(shown: str, value: str) -> bool:
    """Whether a text may be the value; the match on all pages decides."""
    if value in shown and len(shown) <= 2 * len(value) + 40:
        return True
    try:
        return float(shown.replace("$", "").replace(",", "").replace("USD", "").split()[0]) == float(value)
    except (ValueError, IndexError):
        return False


class _Nodes(HTMLParser):
    """Elements with their ancestors and short texts."""

    def __init__(self, longest: int):
        super().__init__()
        self.longest, self.open, self.found = longest, [], []

    def handle_starttag(self, tag, attrs):
        if self.open and tag in _CLOSES_ITSELF and self.open[-1][0] == tag:
            self.open.pop()
        attrs = {k: v or "" for k, v in reversed(attrs)}
        node = [tag, simple_selectors(tag, attrs), attrs, "", [n[1] for n in self.open]]
        self.found.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                break

    def handle_data(self, data):
        text = _SPACE.sub(" ", data).strip()
        if text and not (self.open and self.open[-1][0] in ("script", "style")):
            for node in self.open:
                if len(node[3]) <= self.longest:
                    node[3] = f"{node[3]} {text}".strip()


def page_candidates(html: str, known: list[tuple[str, str]]) -> set[tuple[str, str, str]]:
    """(field, take, selector) of the nodes that show a known (field, value); `take` is TEXT or the name of an attribute."""
    known = [(field, _SPACE.sub(" ", value).strip()) for field, value in known if value and value.strip()]
    if not known:
        return set()
    nodes = _Nodes(2 * max(len(v) for _, v in known) + 40)
    nodes.feed(html)
    nodes.close()
    out = set()
    for _, own, attrs, text, above in nodes.found:
        for field, value in known:
            takes = [TEXT] if text and _close(text, value) else []
            takes += [name for name, shown in attrs.items() if shown == value and _PLAIN.match(name)]
            for take in takes:
                for last in own:
                    if take == TEXT or not last.startswith(f"[{take}="):
                        out.add((field, take, last))
                        out.update((field, take, f"{a} {last}") for a in {a for names in above for a in names})
    return out


def _candidates(pages: DataFrame) -> DataFrame:
    """field, take, selector, n (pages) over (html, known array<struct<field, value>>)."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                counts = Counter()
                for page, known in zip(page_texts(part.column("html")), part.column("known").to_pylist()):
                    counts.update(page_candidates(page, [(k["field"], k["value"]) for k in known]))
                columns = list(zip(*counts)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.string()) for c in columns], pa.array(counts.values(), pa.int64())], ["field", "take", "selector", "n"])
            release()

    found = pages.select("html", "known").mapInArrow(work, "field string, take string, selector string, n long")
    return found.groupBy("field", "take", "selector").agg(F.sum("n").alias("n"))


def same_value(field: str, shown: Column, value: Column) -> Column:
    """Whether a node's text or attribute reads as the value, by the rules that extraction has for the field."""
    if field == "price":
        return parse_price(shown) == value.cast("double")
    return (clean_description(shown) if field == "description" else strip(shown)) == value


def _words(selector: str = "selector") -> Column:
    return F.size(F.split(selector, " "))


def propose_selectors(pages: DataFrame, known: DataFrame, considered: int = CONSIDERED) -> DataFrame:
    """field, rank, selector, take, hits, errors, misses, best first.

    `pages` (url, html) are those to learn from, say the ones whose selectors fail; `known` (url, field, value) has what their
    fields should give, from an earlier run or from answers. Hits are pages on which the first matching node gives the value,
    errors those on which it gives another one, misses those without a match. Rank goes by hits less errors, then by fewer
    steps, a class, id or attribute before a bare tag, shorter text, text. Only `considered` candidates of each field are
    matched on all pages, those found on most. Pages without a known value, null pages and null values say nothing.
    """
    values = known.filter("value is not null and field is not null").groupBy("url").agg(
        F.sort_array(F.collect_set(F.struct("field", "value"))).alias("known"))
    stored = materialize(pages.select("url", "html").join(values, "url").select("html", "known"), "known_pages")
    counted = materialize(_candidates(stored), "candidates")
    order = [F.desc("n"), _words(), F.length("selector"), F.col("selector"), F.col("take")]
    nth = F.row_number().over(Window.partitionBy("field", "_part").orderBy(*order))
    # In two steps, so that no task ranks all candidates of a field.
    some = counted.withColumn("_part", F.pmod(F.xxhash64("selector"), F.lit(64))).withColumn("nth", nth).filter(F.col("nth") <= considered)
    best = some.withColumn("nth", F.row_number().over(Window.partitionBy("field").orderBy(*order))).filter(F.col("nth") <= considered)
    chosen: dict[tuple[str, str], list[str]] = {}
    for row in best.select("field", "take", "selector").orderBy("field", "take", "nth").collect():      # `considered` per field
        chosen.setdefault((row.field, row.take), []).append(row.selector)
    shape = "field string, take string, selector string, hits long, errors long, misses long"
    if not chosen:
        return pages.sparkSession.createDataFrame([], "field string, rank int, selector string, take string, hits long, errors long, misses long")
    fields = [Field(f"c{i}", ", ".join(names), text=take == TEXT, attrs=() if take == TEXT else (take,), first=True)
              for i, ((_, take), names) in enumerate(chosen.items())]
    matched = materialize(match_selectors(stored, fields), "matched")      # each field reads it
    scores = None
    for i, ((field, take), names) in enumerate(chosen.items()):
        value = F.get(F.filter("known", lambda k: k["field"] == field), 0)["value"]      # noqa: B023
        of_page = matched.select(value.alias("value"), F.col(f"c{i}").alias("nodes")).filter("value is not null")
        each = of_page.select("value", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda j: F.get(
            F.filter("nodes", lambda h: h["alt"] == j), 0)[TEXT if take == TEXT else take.replace("-", "_")])).alias("alt", "shown"))      # noqa: B023
        right = F.coalesce(same_value(field, F.col("shown"), F.col("value")), F.lit(False))
        empty = F.coalesce(F.col("shown"), F.lit("")) == ""
        rows = each.groupBy("alt").agg(F.count_if(right).alias("hits"), F.count_if(~right & ~empty).alias("errors"), F.count_if(empty).alias("misses"))
        rows = rows.select(F.lit(field).alias("field"), F.lit(take).alias("take"), F.get(F.array(*[F.lit(n) for n in names]), "alt").alias("selector"), "hits", "errors", "misses")
        scores = rows if scores is None else scores.unionByName(rows)
    scores = materialize(pages.sparkSession.createDataFrame([], shape).unionByName(scores), "scores")
    bare = ~F.substring_index("selector", " ", -1).rlike(r"[.#\[]")
    rank = [F.desc(F.col("hits") - F.col("errors")), _words(), bare, F.length("selector"), F.col("selector"), F.col("take")]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(*rank))).select(
        "field", "rank", "selector", "take", "hits", "errors", "misses")


def proposal_answers(proposals: DataFrame, limit: int = 3) -> DataFrame:
    """The best proposals of each field as answers to repair requests, in the shape of the response table; texts only, hits above errors."""
    good = proposals.filter((F.col("take") == TEXT) & (F.col("hits") > F.col("errors")))
    listed = good.groupBy("field").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "selector"))), 1, limit)["selector"].alias("selectors"))
    return listed.select(F.concat(F.lit("repair|"), F.col("field")).alias("request_key"), F.lit("repair").alias("kind"),
                         F.to_json(F.struct("selectors")).alias("body"))
