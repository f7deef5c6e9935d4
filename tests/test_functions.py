import math
import re
from urllib.parse import urljoin

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.functions import products, text, urls


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def plain_price(value):
    """The rule in plain Python, as the truth to test against."""
    words = value.replace("$", "").replace(",", "").replace("USD", "").split()
    try:
        return float(words[0]) if words else None
    except ValueError:
        return None


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


PRICES = ["$1,299.00 - $1,499", "12.99 USD", "From $5", "€12", "  ", "", "1.0d", "1.5f", "0x1p3", "-5", "nan", "0", "1_000",
          "1__0", "inf", "-Infinity", "1e400", ".5", "5.", "+3", "USD", "U$SD 4", "\xa07\xa08", "1e5", "٣", "1 2"]


def test_parse_price_table(spark):
    found = column(spark, PRICES, text.parse_price)
    expected = [plain_price(p) if p != "٣" else None for p in PRICES]   # ASCII digits only
    assert all(same(a, b) for a, b in zip(found, expected)), list(zip(PRICES, found, expected))
    assert column(spark, [None], text.parse_price) == [None]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="0123456789.,$ USDe+-_\t\xa0 infa", max_size=12), min_size=20, max_size=60))
def test_parse_price_like_plain_python(spark, values):
    assert all(same(a, plain_price(v)) for a, v in zip(column(spark, values, text.parse_price), values))


def plain_description(value):
    value = re.sub(r"#html-body\s*\[[^\]]*\]\s*\{[^}]*\}", " ", value)
    value = re.sub(r"^Description\s*", "", value, count=1)
    return re.sub(r"\s+", " ", value).strip() or None


def test_clean_description(spark):
    values = ["DescriptionText", "Descriptions x", "a #html-body [x=1] {m:0;\nn:1}b", "a\xa0  b", " \t", "",
              "#html-body[a]{b}Description c", "Description Description d", " Description e", "x\x1fy"]
    assert column(spark, values, text.clean_description) == [plain_description(v) for v in values]


def test_strip_and_truncate(spark):
    values = ["\xa0 a b　\x1f", "", " ", "x"]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.strip_blank) == [v.strip() or None for v in values]
    cut = lambda c: text.truncate_text(c, 3)
    assert column(spark, ["abc", "abcd", "äöüß"], cut) == ["abc", "abc\n<!-- truncated -->", "äöü\n<!-- truncated -->"]


def test_json_text_like_the_standard_library(spark):
    import json
    values = [["a", 'q"\\', "é\n\t"], [], ["x"]]
    assert column(spark, values, text.json_list, "array<string>") == [json.dumps(v, ensure_ascii=False) for v in values]
    maps = ['{"k": "v", "a": "é\\""}', "{}"]
    assert column(spark, maps, lambda c: text.json_map(F.from_json(c, "map<string,string>"))) == maps


BASES = ["https://h.com/a/b/c.html?x=1#y", "http://h.com", "http://h.com/", "https://h.com/a/b/", "https://h.com/a?p=1", "ftp://h/x/y"]
REFS = ["", "p", "./p", "../p", "../../p", "../../../../p", "/p", "/p/../q", "//o.com/p", "//o.com", "?page=2", "#f", "?", "#",
        "p?q#f", "p/", "p//q", "/p//q", ".", "..", "./", "../", "a/./b/../c", "https://o.com/a/../b", "http://o.com/x",
        "mailto:a@b", "javascript:void(0)", "data:image/png;base64,x", "HTTPS://O.com/p", " /lead", "/a\nb", "https:rel", "g;x=1/../y",
        "https://o.com", "https://o.com?", "https://o.com/x#", "https://o.com/x?#f", "https://o.com?a=1#b", "https://o.com/a b",
        "http://", "https:///x", "é/ü?ö", "p:q", "1:2", ".../p", "..p", "p.."]


def test_resolve_url_like_the_standard_library(spark):
    pairs = [(b, r) for b in BASES for r in REFS]
    df = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "i int, base string, ref string")
    found = [r.out for r in df.select("i", urls.resolve_url("base", "ref").alias("out")).orderBy("i").collect()]
    wrong = [(b, r, got, urljoin(b, r)) for (b, r), got in zip(pairs, found) if got != urljoin(b, r)]
    assert not wrong


def test_resolve_null(spark):
    df = spark.createDataFrame([("http://h/x", None)], "base string, ref string")
    assert df.select(urls.resolve_url("base", "ref")).first()[0] is None


def test_product_urls(spark):
    cases = {
        "https://h/product/z": True, "https://h/product/cartridge-x": False, "https://h/catalog/x.html": False,
        "https://h/x.html": True, "https://h/product/z#r": False, "https://h/about": False, "https://h/PRODUCT/z": False,
        "https://h/product/z?next=/search": False, "javascript:/product/": False, "https://h/contact.html": False,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    rows = df.select("u", urls.is_product_url("u").alias("ok")).collect()
    assert {r.u: r.ok for r in rows} == cases
    relaxed = df.select("u", urls.is_product_url("u", deny=("#",)).alias("ok")).collect()
    assert {r.u for r in relaxed if r.ok} >= {"https://h/product/cartridge-x", "https://h/catalog/x.html"}


def test_missing_critical_and_keys(spark):
    df = spark.createDataFrame(
        [("s", "b", "d", 1.0), ("", None, "", 0.0), (None, "b", "d", None)], "sku string, brand string, description string, price double")
    rows = df.select(
        products.missing_critical(*[F.col(c) for c in df.columns]).alias("m"), products.dedup_key(F.col("sku"), F.lit("u")).alias("k")).collect()
    assert [r.m for r in rows] == [[], ["sku", "brand", "description", "price"], ["sku", "price"]]
    assert [r.k for r in rows] == ["s", "u", "u"]


def test_schema_gate(spark):
    rows = [("ok", "n", 1.0, 1.0, "selector"), ("inf", "n", float("inf"), 0.0, "hybrid"), ("null", "n", None, 1.0, "llm_fallback"),
            ("nan", "n", float("nan"), 1.0, "selector"), ("neg", "n", -0.5, 1.0, "selector"), ("name", "", 1.0, 1.0, "selector"),
            ("conf", "n", 1.0, 1.5, "selector"), ("confnan", "n", 1.0, float("nan"), "selector"), ("method", "n", 1.0, 1.0, "magic")]
    df = spark.createDataFrame(rows, "url string, name string, price double, extraction_confidence double, extraction_method string")
    good, bad = products.schema_gate(df)
    assert {r.url for r in good.collect()} == {"ok", "inf", "null"}
    assert {r.url for r in bad.collect()} == {"nan", "neg", "name", "conf", "confnan", "method"}
