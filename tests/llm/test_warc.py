import base64
import hashlib

import pytest

from shelfspark.llm import warc

PAGES = [
    (1, "http://h/a", "<html lang='FR'><head><title> A &amp;  B </title><style>x{}</style></head><body><h1>Head</h1><p>one<br>two &lt;3</p>"
                      "<script>no <b>text</b></script><!-- no --><a href='/x?y=1&amp;z'>l</a><a href=#t>m</a></body></html>"),
    (2, "http://h/b", ""), (3, "http://h/c", None), (4, None, "plain < text & more"), (None, "http://h/d", "é 漢"), (5, "http://h/e", "<p>" + "x " * 100_000),
    (6, "http://h/f", "<script>never closed <p>hidden"), (1, "http://h/a", "other version"),
]


def frame(spark):
    return spark.createDataFrame([(i, u, h, "t") for i, u, h in PAGES], "page_id long, url string, html string, type string")


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def headers(record):
    return {h["name"]: h["value"] for h in record["headers"]}


def test_three_linked_records_for_each_page(spark):
    rows = [r.asDict(recursive=True) for r in warc.build(frame(spark)).collect()]
    assert len(rows) == 3 * len(PAGES) and len({r["record_id"] for r in rows}) == len(rows)
    sources = {r["record_id"]: r for r in rows if r["type"] == "response"}
    assert len(sources) == len(PAGES)
    for r in rows:
        h = headers(r)
        assert h["WARC-Block-Digest"] == sha(r["block"]) and h["Content-Length"] == str(len(r["block"]))
        assert h["WARC-Record-ID"] == r["record_id"] and h.get("WARC-Target-URI") == r["target_uri"]
        if r["type"] != "response":
            source = sources[r["refers_to"]]
            assert h["WARC-Refers-To"] == source["record_id"] and h["WARC-Date"] == headers(source)["WARC-Date"]
            assert h["WARC-Source-Payload-Digest"] == headers(source)["WARC-Payload-Digest"] == sha(source["block"].partition(b"\r\n\r\n")[2])
            assert source["target_uri"] == r["target_uri"]
    again = warc.derive(warc.responses(frame(spark)).unionByName(warc.build(frame(spark)).filter("type = 'metadata'")))
    assert {tuple(map(str, r)) for r in again.collect()} == {tuple(map(str, r)) for r in warc.build(frame(spark)).filter("type <> 'response'").collect()}


def test_texts_and_facts(spark):
    rows = warc.build(frame(spark)).filter("page_id = '1' and target_uri = 'http://h/a'").collect()
    texts = {bytes(r.block).decode() for r in rows if r.type == "conversion"}
    assert texts == {"Head\none\ntwo <3\nlm", "other version"}
    facts = next(bytes(r.block).decode() for r in rows if r.type == "metadata" and b"title" in bytes(r.block))
    assert facts.split("\r\n")[:4] == ["title: A & B", "language: fr", "outlink: http://h/x?y=1&z", "outlink: http://h/a#t"]
    assert "source-content-type: text/html; charset=utf-8" in facts


@pytest.mark.parametrize("markup, text", [
    ("", ""), ("a < b", "a < b"), ("<p>a<p>b", "a\nb"), ("<b>a</b>b", "ab"), ("&nbsp;x&nbsp;y", "x y"), ("<!-- a", ""), ("<style>p</style>q", "q"),
    ("<script/>x", "x"), ("a<br/>b", "a\nb"), ("<![CDATA[x]]>y", "y"), ("<a href='>'>z", "'>z"),
])
def test_plain_text(markup, text):
    assert warc.plain_text(markup) == text


def test_hostile_markup_takes_linear_time():
    for piece in ("<", "<a ", "<!--", "</", "<script>", "&amp;", "<a =\""):
        assert warc.plain_text(piece * 100_000) is not None


def test_round_trip_through_files(spark, tmp_path):
    records = warc.build(frame(spark))
    warc.write_warc(records, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).select(*records.columns)
    assert {tuple(map(str, r)) for r in back.collect()} == {tuple(map(str, r)) for r in records.collect()}
    one = records.first().asDict(recursive=True)
    raw = warc.to_bytes(one)
    assert warc.from_bytes(raw + raw)[1]["block"] == one["block"]
    with pytest.raises(ValueError):
        warc.from_bytes(raw[:-10] + b"0123456789")
    assert warc.build(frame(spark).limit(0)).collect() == []


@pytest.mark.parametrize("markup, text", [
    ("<html><head><title>T</title><meta x><body><p>one</p>two</html>", "one\ntwo"), ("<head><title>a <b> c</title><link x><p>one", "one"),
    ("<head><title>T</title>bare text<p>one", "bare text\none"), ("<head><title>T<p>one", "one"), ("<head><script>a</script></head>b", "b"),
    ("a<noscript>b<p>c", "ab\nc"), ("a<template>b<p>c", "ab\nc"), ("a<noscript>b</noscript>c<noscript>d", "acd"),
    ("<p>a<script>x = '<!-- <p>';</script>b", "ab"), ("<script>if (a</b) '</scripts>'</SCRIPT >b", "b"), ("<style>/* <!-- */</style>q", "q"),
    ("<head><noscript><style>x</style></noscript><title>t</title></head><body>b", "b"),
])
def test_pages_without_end_tags(markup, text):
    assert warc.plain_text(markup) == text


def test_unclosed_titles_take_linear_time():
    for piece in ("<head><title>", "<noscript>", "<template>", "<script/>", "<title>x"):
        assert warc.plain_text("<head>" + piece * 100_000) is not None


class _Links(__import__("html.parser").parser.HTMLParser):
    """Links by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.links = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and "href" in dict(attrs):
            self.links.append(next(v for k, v in attrs if k == "href").strip())


@pytest.mark.parametrize("markup", [
    '<a href="/a b">x</a><script>var s = "<a href=/no>";</script><!-- <a href=/no2> --><A HREF=\'c?d=1&amp;e\' title="href=no">y</A><a name=z>q</a>',
    "<p><a class=x\n href = /y>t</a><a href=''>e</a><style>a[href='/no'] {}</style><a data-href=/no href=/z>",
])
def test_links_like_an_independent_parser(markup):
    parser = _Links()
    parser.feed(markup)
    assert warc.read_page(markup).links == parser.links and not any("no" in x for x in parser.links)


def test_damaged_pages_are_records(spark):
    damaged = spark.sql(r"select 1L as page_id, 'http://h/' as url, cast(unhex('3C703E61FF3C2F703EC3') as string) as html")
    records = warc.build(damaged).collect()
    assert [r.type for r in records] == ["response", "metadata", "conversion"] and bytes(records[2].block).decode() == "a\ufffd\n\ufffd"
    assert warc.responses(damaged).count() == 1
