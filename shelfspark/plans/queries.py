"""Registered queries: each takes (spark, sf_dir) and reads the given tables whole."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, urls
from ..operators import classify, extract, gapfill, induce, learned, metrics, navigate, provider, repair, rules, similar, validate
from ..operators.match import Field, match_selectors
from ..sources import products as product_files
from ..sources import state
from ..sources.packing import remove_replaced
from ..sources.page_state import load_page_state, merge_page_state
from ..sources.pages import as_pages, pack_archive, read_archive, read_pages, with_archive_key, write_archive
from ..streaming.catalog import judged_rows, rejected_rows, stream_catalog as run_stream, stream_products, to_refetch
from ..constants import MAX_IMAGES, MAX_SUGGESTIONS
from ..streaming.health import stream_health
from . import catalog_run, rendered
from .scratch import materialize, scratch_path

RUN_TS = "2026-01-01T00:00:00Z"
CAP = 50            # products per category of a capped run
BUDGET = 300        # calls of a run with answers
AUDIT = 100         # rows of an audit sample
QUERY_VECTOR = 0    # vec_id the nearest-products report asks for


# --- inputs --------------------------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def store_fixture(spark: SparkSession, sf_dir: str) -> None:
    """Render the shop's pages once and store them; later queries of this session read them. For measuring queries only."""
    fx = Fixture(spark, sf_dir)
    _STORED[spark.sparkContext.applicationId, sf_dir] = (materialize(fx.details(), "details"), materialize(fx.listing_pages(), "listing"))


class Fixture:
    """The rendered shop of one scale, and the usual steps on it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        # Each narrow row becomes a page: dealt over the cores before it grows, so that no HTML is shuffled.
        self.part = table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism, "p_partkey")
        self.shop = rendered.read_shop(table(spark, sf_dir, "part"))
        self.stored = _STORED.get((spark.sparkContext.applicationId, sf_dir))

    def details(self) -> DataFrame:
        return self.stored[0] if self.stored else rendered.detail_pages(self.part, self.shop)

    def listing_pages(self) -> DataFrame:
        return self.stored[1] if self.stored else rendered.listing_pages(self.part, self.shop)

    def site(self) -> DataFrame:
        """All pages of the shop: url, html."""
        return self.details().select("url", "html").unionByName(self.listing_pages())

    def categories(self) -> DataFrame:
        return rendered.categories(self.spark, self.shop)

    def responses(self) -> DataFrame:
        return rendered.responses(self.part, self.shop)

    def raw(self) -> DataFrame:
        return extract.extract_raw(self.details())

    def products(self) -> DataFrame:
        """Selector-only products."""
        return gapfill.merge_fallback(self.raw())[0]

    def answered(self) -> DataFrame:
        """Products with all answers merged."""
        built, _ = gapfill.merge_fallback(self.raw(), self.responses())
        return gapfill.merge_enrichment(built, self.responses())

    def validated(self) -> DataFrame:
        return validate.validate_products(materialize(self.products(), "products"))

    def listings(self) -> DataFrame:
        matched = catalog_run.match_site(self.listing_pages())
        return materialize(navigate.product_links(matched), "edges")

    def walk(self, cap=None) -> tuple[DataFrame, DataFrame]:
        edges = self.listings()
        return navigate.walk_pagination(self.categories(), edges, cap), edges


def scalars(df: DataFrame) -> DataFrame:
    """Lists joined with '|', maps as sorted k=v text, doubles rounded, run time left out."""

    def flat(field):
        c = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.array_join(c, "|").alias(field.name)
        if isinstance(field.dataType, T.MapType):
            entries = F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
            return F.array_join(F.array_sort(entries), "|").alias(field.name)
        if isinstance(field.dataType, T.DoubleType):
            return F.round(c, 6).alias(field.name)
        return c

    return df.select(*[flat(f) for f in df.schema.fields if f.name not in ("extracted_at", "seq")])


# --- extraction ----------------------------------------------------------------------------

def extract_catalog(spark, sf_dir):
    return scalars(Fixture(spark, sf_dir).products())


def raw_extraction(spark, sf_dir):
    return scalars(Fixture(spark, sf_dir).raw().drop("price").withColumn("price_text", text.strip(F.col("price_text"))))


def unextractable_pages(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    fields = extract.raw_fields(extract.match_selectors(fx.details(), extract.detail_fields()))
    return extract.unextractable(fields)


def breadcrumb_paths(spark, sf_dir):
    raw = extract.extract_raw(Fixture(spark, sf_dir).details().drop("category_path"))
    return scalars(raw.select("url", "category_path"))


def missing_fields(spark, sf_dir):
    return scalars(Fixture(spark, sf_dir).raw().select("url", "missing"))


def page_titles(spark, sf_dir):
    matched = match_selectors(table(spark, sf_dir, "pages").select("page_id", "html"), [Field("title", "h1", text=True, first=True)])
    return matched.select("page_id", extract.first_text("title").alias("title"))


def damaged_titles(spark, sf_dir):
    """Titles of pages with bytes that are no UTF-8."""
    damaged = F.concat(F.encode(F.substring_index("html", "<h1>", 1), "UTF-8"), F.encode(F.lit("<h1>"), "UTF-8"), F.unhex(F.lit("C3")),
                       F.encode(F.concat(F.lit("-"), F.regexp_extract("html", "(?s)<h1>(.*)$", 1)), "UTF-8"), F.unhex(F.lit("FFE282")))
    pages = table(spark, sf_dir, "pages").select("page_id", damaged.cast("string").alias("html"))
    matched = match_selectors(pages, [Field("title", "h1", text=True, first=True)])
    return matched.select("page_id", extract.first_text("title").alias("title"))


def nav_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    matched = match_selectors(pages, [Field("links", "nav a", attrs=("href",))])
    resolved = F.expr(urls.resolve_all_sql("_base", "url", "links.href"))
    return (
        matched.withColumn("_base", urls.split_url("url"))
        .select("page_id", F.posexplode(resolved).alias("pos", "link"))
        .select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")
    )


_LINK_FORMS = """explode(map(
    'rooted', href, 'relative', substring(href, 2), 'parent', concat('../', substring(href, 2)),
    'dotted', concat('./a/../', substring(href, 2)), 'host', concat('//cdn.example.com', href), 'query', '?page=9',
    'fragment', '#part', 'absolute', concat('mailto:', substring(href, 2)), 'empty', '')) as (form, ref)"""


def resolve_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    matched = match_selectors(pages, [Field("links", "nav a", attrs=("href",))])
    hrefs = matched.select("page_id", "url", F.posexplode("links.href").alias("pos", "href"))
    refs = hrefs.selectExpr("page_id", "url", "cast(pos as bigint) as pos", _LINK_FORMS)
    return refs.select("page_id", "pos", "form", urls.resolve_url("url", "ref").alias("link"))


def product_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.is_product_url("url").alias("is_product"))


def shop_product_urls(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    forms = F.array(
        F.col("url"), F.concat("url", F.lit("#reviews")), F.concat("url", F.lit("?next=/cart")),
        F.concat(F.lit("https://shop.example.com/"), F.col("slug"), F.lit(".html")),
        F.concat(F.lit("https://shop.example.com/catalog/"), F.col("slug"), F.lit(".html")))
    links = rendered.with_rules(fx.part, fx.shop).select("p_partkey", F.posexplode(forms).alias("form", "link"))
    return links.select("p_partkey", F.col("form").cast("bigint").alias("form"), urls.is_product_url("link").alias("is_product"))


# --- value functions -----------------------------------------------------------------------

def parse_prices(spark, sf_dir):
    shown = F.concat(F.lit(" $"), F.format_number("l_extendedprice", 2), F.lit(" USD\n"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(text.parse_price(shown), 2).alias("price"),
        text.parse_price(F.concat(F.lit("from "), shown)).alias("no_price"))


def shop_prices(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return rendered.with_rules(fx.part, fx.shop).select(
        "p_partkey", F.round(text.parse_price(rendered.price_text()), 2).alias("price"))


def clean_text(spark, sf_dir):
    noisy = F.concat(F.lit("Description\n"), F.col("text"), F.lit(" #html-body [data-x=1] {margin:0;\ncolor:red} end "))
    cleaned = table(spark, sf_dir, "documents").select("doc_id", text.clean_description(noisy).alias("cleaned"))
    return cleaned.select(
        "doc_id", F.md5("cleaned").alias("cleaned_md5"), F.length("cleaned").cast("bigint").alias("n_chars"),
        F.md5(text.truncate_text(F.col("cleaned"), 300)).alias("truncated_md5"))


# --- gap filling ---------------------------------------------------------------------------

def merge_fallback(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return scalars(gapfill.merge_fallback(fx.raw(), fx.responses())[0])


def gate_rejects(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return gapfill.merge_fallback(fx.raw(), fx.responses())[1].select("url", "gate_reason")


def merge_enrichment(spark, sf_dir):
    return scalars(Fixture(spark, sf_dir).answered())


def fallback_requests(spark, sf_dir):
    return scalars(gapfill.fallback_requests(Fixture(spark, sf_dir).raw()).select("request_key", "kind", "fields"))


def enrich_requests(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    requests = gapfill.enrich_requests(gapfill.merge_fallback(fx.raw(), fx.responses())[0])
    return scalars(requests.select("request_key", "kind", "name", "description"))


def _older(responses):
    """The answers with an earlier, different one to each request."""
    old = responses.withColumn("body", F.lit('{"sku": 5, "color": "old"}')).withColumn("answered_at", F.lit(1))
    return old.unionByName(responses.withColumn("answered_at", F.lit(2)))


def repeated_answers(spark, sf_dir):
    """Two answers to each request: the later one counts, and no product doubles."""
    fx = Fixture(spark, sf_dir)
    answers = _older(fx.responses())
    return scalars(gapfill.merge_enrichment(gapfill.merge_fallback(fx.raw(), answers)[0], answers))


# What the prose of the query below says of a product, by its number.
_SAID = {"material": ("oak", "brass", "wool"), "color": ("blue", "white", "green", "pink"), "size": ("small", "medium", "large"),
         "form": ("lamp", "chair", "shelf"), "texture": ("matte", "glossy"), "intended_use": ("indoor", "outdoor")}


def _prose(k: str) -> str:
    """Product text in which rules find all twelve attributes; SQL that Spark and DuckDB read alike."""
    pick = lambda values, n: "case " + " ".join(f"when {k} % {n} = {i} then '{v}'" for i, v in enumerate(values)) + " else '' end"
    parts = [pick(values, len(values)) for values in _SAID.values()] + [
        f"cast({k} % 50 + 1 as varchar(9)) || '/box'", f"cast({k} % 9 + 1 as varchar(9)) || ' mil'", pick(("powder-free", "powdered"), 2),
        pick(("non-sterile", "sterile", "sterile"), 5), pick(("absorbable", "non-absorbable"), 7), pick(("contains latex", "latex-free"), 6),
    ]
    return " || ', ' || ".join(f"({p})" for p in parts)


def offline_enrichment(spark, sf_dir):
    """Requests answered by the offline rules and merged back: all twelve attributes."""
    fx = Fixture(spark, sf_dir)
    number = "cast(regexp_extract(url, '-([0-9]+)$', 1) as bigint)"
    products = materialize(fx.products().withColumns({"name": F.lit("Item"), "description": F.expr(_prose(number))}), "products")
    vocabulary = {attribute: rules.words(*values) for attribute, values in _SAID.items()}
    answers = rules.rule_responses(gapfill.enrich_requests(products), vocabulary | rules.VALUE_RULES)
    return scalars(gapfill.merge_enrichment(products, answers).select("url", "specifications", "extraction_method", "extraction_confidence"))


# What answers say of a product; the last two follow from nothing in its text.
_TAUGHT = {"color": "split_part(p_name, ' ', 1)", "material": "split_part(p_name, ' ', 2)",
           "size": "case when p_size < 25 then 'small' else 'large' end",
           "texture": "case when p_partkey % 3 > 0 then 'matte' else 'glossy' end",
           "form": "case when p_partkey % 2 = 0 then split_part(p_type, ' ', 1) end"}


def _taught(fx) -> tuple[DataFrame, DataFrame]:
    """(enrichment requests of all products, answers to all of them)."""
    requests = materialize(gapfill.enrich_requests(fx.products(), tuple(_TAUGHT)), "requests")
    body = F.to_json(F.struct(*[F.expr(value).alias(name) for name, value in _TAUGHT.items()]))
    answers = rendered.with_rules(fx.part, fx.shop).select(F.concat(F.lit("enrich|"), "url").alias("request_key"), F.lit("enrich").alias("kind"), body.alias("body"))
    return requests, answers


def learned_cues(spark, sf_dir):
    """What answers to four fifths of the requests teach about each cue."""
    requests, answers = _taught(Fixture(spark, sf_dir))
    answered = learned.answered_requests(requests, answers, tuple(_TAUGHT))
    return learned.learn(answered.filter(learned.part_of() != 0))


def learned_attributes(spark, sf_dir):
    """Values for the fifth that was not learnt from; attributes that do not follow from the text have none."""
    requests, answers = _taught(Fixture(spark, sf_dir))
    model, limits = learned.train(learned.answered_requests(requests, answers, tuple(_TAUGHT)))
    return learned.learned_responses(requests.filter(learned.part_of() == 0), model, limits).select("request_key", "body")


def provider_answers(spark, sf_dir):
    """A callable that fails on every fifth product, then one that works: the second run asks only for what is open."""
    fx = Fixture(spark, sf_dir)
    requests = materialize(gapfill.enrich_requests(fx.products()), "requests")

    def connect(broken):
        def ask(request):
            words = request["name"].split()
            if broken and int(words[-1]) % 5 == 0:
                raise ValueError("down")
            return '{"color": "' + words[0] + '"}'

        return lambda: ask

    path = scratch_path(spark, "answers")
    provider.answer_requests(requests, connect(True), path, slices=2)
    provider.answer_requests(requests, connect(False), path)
    calls = provider.load_attempts(spark, path)
    return calls.groupBy("request_key").agg(F.max("body").alias("body"), F.count(F.lit(1)).alias("calls"), F.max("error").alias("error"))


def budget_requests(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    sent = catalog_run.plan_requests(materialize(fx.raw(), "raw"), fx.responses(), BUDGET)
    return scalars(sent.select("request_key", "kind", "url"))


def _prompt_rows(prompted):
    """Prompts by hash, and whether the page stands behind them; a page's own text is compared by its length."""
    head = F.substring_index("prompt", "\n\n", 1)
    prose = F.col("kind") == "enrich"
    return prompted.select(
        "request_key", "kind", F.md5(F.when(prose, F.col("prompt")).otherwise(head)).alias("prompt_md5"),
        F.col("prompt").endswith("</html>").alias("has_page"))


def request_prompts(spark, sf_dir):
    """All requests of a run with their prompts."""
    fx = Fixture(spark, sf_dir)
    sent = catalog_run.plan_requests(materialize(fx.raw(), "raw"), fx.responses())
    return _prompt_rows(gapfill.with_prompts(sent, fx.details()))


def first_round_requests(spark, sf_dir):
    """What a run without any answers asks, written and read back."""
    fx = Fixture(spark, sf_dir)
    site = materialize(fx.site(), "site")
    run = catalog_run.run_catalog(catalog_run.match_site(site), fx.categories(), RUN_TS)
    path = scratch_path(spark, "requests")
    state.write_requests(gapfill.with_prompts(run.requests_sent, site), path)
    return _prompt_rows(spark.read.schema("request_key string, kind string, prompt string").json(path))


def sanitise_attributes(spark, sf_dir):
    answers = Fixture(spark, sf_dir).responses().filter("kind = 'enrich'")
    return scalars(answers.select("request_key", gapfill.sanitise_attributes(gapfill.response_map(F.col("body"))).alias("attributes")))


_PART_RULES = {
    "material": rules.words("ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil", "rod"),
    "color": rules.words("red", "blue"),
    "size": rules.words("small", "large"),
    "pack_size": rules.VALUE_RULES["pack_size"],
}


def rule_attributes(spark, sf_dir):
    prose = F.concat("p_name", F.lit(", "), (F.col("p_size") * 10).cast("string"), F.when(F.col("p_size") % 2 == 0, "/box powder-free").otherwise(" rolls non-sterile"))
    found = rules.rule_attributes(prose, _PART_RULES)
    return scalars(table(spark, sf_dir, "part").select("p_partkey", found.alias("attributes")))


# --- validation and counters ---------------------------------------------------------------

def validate_catalog(spark, sf_dir):
    return Fixture(spark, sf_dir).validated().select("url", "dedup_key", "verdict", "valid", "reason")


def dedup_first(spark, sf_dir):
    stored = materialize(Fixture(spark, sf_dir).products(), "products")
    return validate.dedup_first(stored).select("url", "sku")


def validate_with_prior(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    path = scratch_path(spark, "keys")
    earlier = rendered.with_rules(fx.part, fx.shop).filter("p_partkey % 10 = 3 and sku is not null")
    state.save_keys(earlier.select(F.col("sku").alias("dedup_key"), F.lit(True).alias("valid")), path)
    stored = materialize(fx.products(), "products")
    return validate.validate_products(stored, state.load_keys(spark, path)).select("url", "verdict")


def validation_summary(spark, sf_dir):
    return scalars(validate.validation_summary(Fixture(spark, sf_dir).validated()))


def method_counts(spark, sf_dir):
    return validate.count_by_method(Fixture(spark, sf_dir).answered())


def schema_gate(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return gapfill.merge_fallback(fx.raw())[1].select("url", F.round("price", 2).alias("price"), "gate_reason")


# --- sinks and state -----------------------------------------------------------------------

def _stored_run(spark, sf_dir):
    """A selector-only run over all detail pages, stored: (products path, seen path, frame of verdicts)."""
    fx = Fixture(spark, sf_dir)
    products = materialize(gapfill.stamp(fx.products(), RUN_TS), "products")
    validated = materialize(validate.validate_products(products), "validated")
    jsonl, seen = scratch_path(spark, "jsonl"), scratch_path(spark, "seen")
    product_files.write_jsonl(validate.accepted(validated), jsonl)
    state.save_seen(validate.urls_to_mark(validated), seen)
    return jsonl, seen, validated


def jsonl_roundtrip(spark, sf_dir):
    jsonl, _, _ = _stored_run(spark, sf_dir)
    return scalars(product_files.read_products(spark, jsonl))


def csv_flat(spark, sf_dir):
    products = gapfill.stamp(Fixture(spark, sf_dir).products(), RUN_TS)
    return product_files.flatten_for_csv(products)


def csv_export(spark, sf_dir):
    jsonl, _, _ = _stored_run(spark, sf_dir)
    path = scratch_path(spark, "csv")
    product_files.export_csv(spark, jsonl, path)
    read = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return read.select(*[F.coalesce(c, F.lit("")).alias(c) for c in read.columns])


def pipeline_status(spark, sf_dir):
    jsonl, seen, _ = _stored_run(spark, sf_dir)
    return catalog_run.catalog_status(spark, seen, jsonl)[0]


def run_summary(spark, sf_dir):
    jsonl, seen, validated = _stored_run(spark, sf_dir)
    n_rows = product_files.export_csv(spark, jsonl, scratch_path(spark, "csv"))
    no_calls = spark.createDataFrame([], "request_key string")
    return scalars(validate.run_summary(validated, no_calls, state.load_seen(spark, seen), n_rows))


def seen_urls(spark, sf_dir):
    """Marking twice keeps the table distinct."""
    _, seen, validated = _stored_run(spark, sf_dir)
    fx = Fixture(spark, sf_dir)
    state.save_seen(materialize(rendered.with_rules(fx.part, fx.shop).select("url"), "urls"), seen)
    return state.load_seen(spark, seen)


def archive_keys(spark, sf_dir):
    path = scratch_path(spark, "archive")
    write_archive(as_pages(table(spark, sf_dir, "pages")), path)
    return with_archive_key(read_archive(spark, path)).select("page_id", "archive_key", F.sha2("html", 256).alias("html_hash"))


def latest_archived(spark, sf_dir):
    """An archive that was appended to twice, read with one row per URL: the later fetch."""
    path = scratch_path(spark, "archive")
    pages = as_pages(read_pages(spark, f"{sf_dir}/pages.parquet"))
    for at, version in enumerate((F.lit("old"), F.col("html"))):
        write_archive(pages.withColumn("html", version).withColumn("fetched_at", F.lit(at)), path)
    return read_archive(spark, path, latest=True).select("url", F.col("fetched_at").cast("bigint").alias("fetched_at"))


def changed_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    before = F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("old"))).otherwise(F.col("html"))
    earlier = pages.filter("page_id % 3 <> 0").select("url", F.sha2(before, 256).alias("html_hash"))
    return metrics.changed_pages(pages, earlier).select("page_id", "html_hash")


def page_state(spark, sf_dir):
    """State of all URLs after two crawls: the second finds every fifth page changed and does not reach every seventh."""
    path = scratch_path(spark, "page-state")
    pages = table(spark, sf_dir, "pages")
    merge_page_state(pages, path, "2026-01-01")
    later = F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("new"))).otherwise(F.col("html"))
    merge_page_state(pages.filter("page_id % 7 <> 0").withColumn("html", later), path, "2026-02-01")
    return load_page_state(spark, path)


def packed_archive(spark, sf_dir):
    """An archive of many appends, packed, appended to and packed again; the replaced files are gone after the first time."""
    path = scratch_path(spark, "archive")
    pages = as_pages(read_pages(spark, f"{sf_dir}/pages.parquet"))
    write_archive(pages.repartition(16), path)
    pack_archive(spark, path)
    remove_replaced(spark, path)
    write_archive(pages.withColumn("url", F.concat("url", F.lit("#again"))).repartition(16), path)
    pack_archive(spark, path)
    return read_archive(spark, path).select("page_id", "url", "archive_key", "html_hash")


# --- navigation ----------------------------------------------------------------------------

def listing_links(spark, sf_dir):
    edges = Fixture(spark, sf_dir).listings()
    return edges.select("url", F.col("n_links").cast("bigint").alias("n_links"), "next_url")


def walked_pages(spark, sf_dir):
    walked, _ = Fixture(spark, sf_dir).walk()
    return walked.select("cat_idx", "page_num", "url", F.col("n_links").cast("bigint").alias("n_links"))


def frontier_full(spark, sf_dir):
    walked, edges = Fixture(spark, sf_dir).walk()
    return navigate.frontier(walked, edges).select("cat_idx", "category", "page_num", F.col("pos").cast("bigint").alias("pos"), "url")


def frontier_capped(spark, sf_dir):
    walked, edges = Fixture(spark, sf_dir).walk(CAP)
    return navigate.frontier(walked, edges, CAP).select("cat_idx", "category", "page_num", F.col("pos").cast("bigint").alias("pos"), "url")


def empty_listings(spark, sf_dir):
    walked, _ = Fixture(spark, sf_dir).walk()
    return navigate.empty_listings(walked)


def _earlier_urls(fx):
    """URLs that an earlier run marked, read back from their table."""
    path = scratch_path(fx.spark, "seen")
    state.save_seen(rendered.with_rules(fx.part, fx.shop).filter("p_partkey % 5 = 0").select("url"), path)
    return state.load_seen(fx.spark, path)


def unseen_frontier(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    walked, edges = fx.walk()
    fresh = navigate.unseen(navigate.frontier(walked, edges), _earlier_urls(fx))
    return scalars(fresh.select("url", "category_path"))


def fetch_misses(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    walked, edges = fx.walk()
    urls_found = navigate.unseen(navigate.frontier(walked, edges))
    fetched = rendered.with_rules(fx.part, fx.shop).filter("p_partkey % 29 <> 0").select("url")
    return navigate.fetch_misses(urls_found, fetched).select("url")


def catalog_products(spark, sf_dir):
    """The whole run, selectors only: site pages in, accepted products out."""
    fx = Fixture(spark, sf_dir)
    run = catalog_run.run_catalog(catalog_run.match_site(fx.site()), fx.categories(), RUN_TS)
    return scalars(run.products())


def catalog_products_capped(spark, sf_dir):
    """The run with a bound on the products of each category and on the images of each product."""
    fx = Fixture(spark, sf_dir)
    run = catalog_run.run_catalog(catalog_run.match_site(fx.site()), fx.categories(), RUN_TS, cap=CAP, max_images=MAX_IMAGES)
    return scalars(run.products())


def recrawled_catalog(spark, sf_dir):
    """Every page twice, the earlier version without names and links: the same products as from the later one alone."""
    fx = Fixture(spark, sf_dir)
    site = fx.site()
    earlier = site.withColumn("html", F.regexp_replace("html", "page-title|class=\"result\"|href=", "gone"))
    pages = earlier.withColumn("fetched_at", F.lit(1)).unionByName(site.withColumn("fetched_at", F.lit(2)))
    run = catalog_run.run_catalog(catalog_run.match_site(pages), fx.categories(), RUN_TS)
    return scalars(run.products())


def catalog_products_full(spark, sf_dir):
    """The whole run with URLs of an earlier run left out."""
    fx = Fixture(spark, sf_dir)
    run = catalog_run.run_catalog(
        catalog_run.match_site(fx.site()), fx.categories(), RUN_TS, seen=_earlier_urls(fx))
    return scalars(run.validated.select("url", "name", "sku", "price", "dedup_key", "verdict"))


def catalog_products_answered(spark, sf_dir):
    """The whole run with all answers."""
    fx = Fixture(spark, sf_dir)
    run = catalog_run.run_catalog(
        catalog_run.match_site(fx.site()), fx.categories(), RUN_TS, responses=fx.responses())
    return _outcome(run)


def _outcome(run):
    return scalars(run.validated.select(
        "url", "sku", "brand", "price", "description", "specifications", "extraction_method", "extraction_confidence",
        "fields_via_llm", "verdict"))


def catalog_products_budgeted(spark, sf_dir):
    """The whole run with answers and a call budget."""
    fx = Fixture(spark, sf_dir)
    run = catalog_run.run_catalog(
        catalog_run.match_site(fx.site()), fx.categories(), RUN_TS, responses=fx.responses(), max_calls=BUDGET)
    return _outcome(run)


# --- page types ----------------------------------------------------------------------------

def page_types(spark, sf_dir):
    """Types as the stored pass over the whole site has them."""
    return catalog_run.match_site(Fixture(spark, sf_dir).site()).select("url", "page_type")


def _page_answers(pages):
    body = F.element_at(F.array(F.lit('{"page_type": "product_detail"}'), F.lit('{"page_type": "shop"}'), F.lit("nope")), (F.col("page_id") % 4 + 1).cast("int"))
    return pages.filter("page_id % 4 <> 3").groupBy("url").agg(F.min_by(body, "page_id").alias("body")).select(
        F.concat(F.lit("classify|"), F.col("url")).alias("request_key"), F.lit("classify").alias("kind"), "body")


def page_type_answers(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return classify.classify_pages(pages, _page_answers(table(spark, sf_dir, "pages"))).select("page_id", "page_type")


def page_type_counts(spark, sf_dir):
    both = Fixture(spark, sf_dir).site().unionByName(table(spark, sf_dir, "pages").select("url", "html"))
    return classify.page_type_counts(classify.classify_pages(both))


def classify_requests(spark, sf_dir):
    site = materialize(Fixture(spark, sf_dir).site(), "site")
    return classify.classify_requests(site, catalog_run.match_site(site)).select("request_key", "kind", "url")


# --- selector failures ---------------------------------------------------------------------

def _misses(spark, sf_dir):
    return materialize(repair.miss_events(Fixture(spark, sf_dir).raw()), "misses")


def miss_counts(spark, sf_dir):
    return repair.miss_counts(repair.miss_events(Fixture(spark, sf_dir).raw()))


def fields_to_repair(spark, sf_dir):
    events = _misses(spark, sf_dir)
    suggested = events.select("field").distinct().withColumn(
        "suggested", F.when(F.col("field") == "sku", F.array(F.lit(".sku"))).otherwise(F.array().cast("array<string>")))
    return repair.fields_to_repair(events, suggested)


def repair_requests(spark, sf_dir):
    return repair.repair_requests(_misses(spark, sf_dir)).select("field", "failures", "broken_selector", "url")


def repair_prompts(spark, sf_dir):
    """Repair requests with their prompts, compared by the hash of what stands before the page."""
    fx = Fixture(spark, sf_dir)
    prompted = repair.with_repair_prompts(repair.repair_requests(_misses(spark, sf_dir)), fx.details())
    return prompted.select("field", F.md5(F.substring_index("prompt", "\n\n", 1)).alias("prompt_md5"), F.col("prompt").endswith("</html>").alias("has_page"))


def repair_report(spark, sf_dir):
    events = _misses(spark, sf_dir)
    body = (
        F.when(F.col("field") == "sku", '{"selectors": [".sku", 5, "#sku", "[itemprop=sku]", ".x"]}')
        .when(F.col("field") == "brand", '{"selectors": []}').when(F.col("field") == "price", "nope")
    )
    answers = events.select("field").distinct().select(
        F.concat(F.lit("repair|"), F.col("field")).alias("request_key"), F.lit("repair").alias("kind"), body.alias("body")
    ).filter("body is not null")
    path = scratch_path(spark, "repair")
    state.write_repair_report(repair.repair_report(events, answers, max_suggestions=MAX_SUGGESTIONS), path)
    report = spark.read.schema("field string, failures bigint, suggested array<string>").json(path)
    return scalars(report)


def _drifted_pages(fx):
    """A third of the detail pages after the shop was rebuilt: other names for classes and attributes, the same content."""
    html = F.col("html")
    for old, new in {"page-title": "headline", "manufacturer-name": "made-by", "shop-by-manufacturer": "makers", "data-sku": "data-item",
                     "price-box": "offer", "class=\"price\"": "class=\"cost\"", "itemprop=\"price\"": "itemprop=\"amount\""}.items():
        html = F.replace(html, F.lit(old), F.lit(new))
    return fx.details().filter(F.regexp_extract("url", "-([0-9]+)$", 1).cast("long") % 3 == 1).select("url", html.alias("html"))


def selector_proposals(spark, sf_dir):
    """The best selector of each field on the rebuilt pages, from what an earlier run knows of them."""
    fx = Fixture(spark, sf_dir)
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in ("name", "sku", "price")])
    known = fx.products().select("url", F.inline(fields))
    proposals = induce.propose_selectors(_drifted_pages(fx), known)
    return proposals.filter("rank = 1").select("field", "selector", "take", "hits", "errors", "misses")


# --- metrics -------------------------------------------------------------------------------

def field_coverage(spark, sf_dir):
    return scalars(metrics.field_coverage(Fixture(spark, sf_dir).answered()))


def reject_rate(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    good, rejects = gapfill.merge_fallback(materialize(fx.raw(), "raw"))
    return scalars(metrics.reject_rate(validate.validate_products(materialize(good, "products")), rejects))


def _two_runs(fx, step):
    """Run 1 is selector-only, run 2 has the answers merged; `step` applies to each before the union."""
    raw = materialize(fx.raw(), "raw")
    first = gapfill.merge_fallback(raw)[0]
    second = gapfill.merge_enrichment(gapfill.merge_fallback(raw, fx.responses())[0], fx.responses())
    tag = lambda df, n: step(df).withColumn("run_id", F.lit(n))
    return tag(first, 1).unionByName(tag(second, 2))


def fallback_rate(spark, sf_dir):
    return scalars(metrics.fallback_rate(_two_runs(Fixture(spark, sf_dir), lambda df: df)))


def dup_rate_trend(spark, sf_dir):
    judge = lambda df: validate.validate_products(materialize(df, "products"))
    return scalars(metrics.dup_rate_trend(_two_runs(Fixture(spark, sf_dir), judge)))


def _daily_errors(spark, sf_dir):
    """rows_seen and duplicate_rate per category and run, from the event log: a run is a day, a category a group of users; on day 20 group 2 has a spike."""
    log = table(spark, sf_dir, "events").select(
        F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("run_id"),
        (F.col("user_id") % 4).alias("category"), "event_type")
    bad = (F.col("event_type") == "error") | ((F.col("run_id") == 20) & (F.col("category") == 2) & F.col("event_type").isin("view", "click", "purchase"))
    return log.groupBy("category", "run_id").agg(F.count(F.lit(1)).alias("rows_seen"), F.avg(bad.cast("double")).alias("duplicate_rate"))


def duplicate_spikes(spark, sf_dir):
    """Runs whose duplicate rate leaves its category's control limits; the state is carried over at day 12."""
    rates = materialize(_daily_errors(spark, sf_dir), "rates")
    first, state = metrics.rate_spikes(rates.filter("run_id < 12"), "category")
    second, _ = metrics.rate_spikes(rates.filter("run_id >= 12"), "category", state=materialize(state, "state"))
    return scalars(first.unionByName(second).select("category", "run_id", "expected", "upper", "spike"))


def summary_drift(spark, sf_dir):
    """Two runs compared from their stored summaries: rows and brands as they are, price quantiles by whether their true rank is within two percent."""
    runs = materialize(_two_runs(Fixture(spark, sf_dir), lambda df: df.withColumn("category", F.element_at("category_path", 1))), "runs")
    summaries = materialize(metrics.summarise_run(runs, ["run_id", "category"]), "summaries")
    found = materialize(metrics.compare_summaries(summaries.filter("run_id = 2"), summaries.filter("run_id = 1")), "found")
    wanted = {f"price_p{round(q * 100):02d}": q for q in metrics.QUANTILES}
    prices = {r.metric: r for r in found.filter(F.col("metric").isin(*wanted)).collect()}      # five rows

    def near(side, run_id):
        price = F.when(F.col("run_id") == run_id, F.col("price"))
        checks = []
        for metric, q in wanted.items():
            value = F.lit(prices[metric][side])
            below, upto = F.avg((price < value).cast("double")), F.avg((price <= value).cast("double"))
            checks += [F.lit(metric), F.when((below <= q + 0.02) & (upto >= q - 0.02), 1.0).otherwise(0.0)]
        return F.create_map(*checks).alias(side)

    measured = runs.agg(near("current", 2), near("prior", 1)).select(F.explode("current").alias("metric", "current"), "prior")
    measured = measured.select("metric", "current", F.try_element_at("prior", F.col("metric")).alias("prior"))
    return scalars(found.filter(~F.col("metric").isin(*wanted)).unionByName(measured))


def drift_report(spark, sf_dir):
    runs = materialize(_two_runs(Fixture(spark, sf_dir), lambda df: df), "runs")
    return scalars(metrics.drift_report(runs.filter("run_id = 2"), runs.filter("run_id = 1")))


def audit_sample(spark, sf_dir):
    return metrics.audit_sample(Fixture(spark, sf_dir).products().select("url", "name", "sku"), AUDIT)


def health_windows(spark, sf_dir):
    log = table(spark, sf_dir, "events")
    return scalars(metrics.health_windows(
        log, every="1 day", ok=F.col("event_type") != "error", latency=F.col("value"), alert_below=0.8))


def compare_selectors(spark, sf_dir):
    current = {"title": "h1", "links": ".menu a", "ad": "div.ad"}
    candidate = {"title": "article h1", "links": "nav a", "ad": "div.advert"}
    return scalars(metrics.compare_selectors(table(spark, sf_dir, "pages"), current, candidate))


def nearest_products(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter(F.col("vec_id") == QUERY_VECTOR).first()
    query = asked["embedding"] if asked else []
    return scalars(metrics.nearest_products(vectors, query, 10).select("vec_id", "label", "score"))


def similar_products(spark, sf_dir):
    """The ten products most alike to every hundredth one, all lists probed."""
    vectors = materialize(similar.usable_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    found = similar.similar(vectors.filter("id % 100 = 0"), similar.build_index(vectors, 16), 10)
    return scalars(found.select("query_id", F.col("rank").cast("bigint").alias("rank"), F.col("id").alias("vec_id"), "score"))


# --- streaming -----------------------------------------------------------------------------

def _streamed(spark, sf_dir):
    """Detail pages arrive in three steps, by category; the stream resumes after each."""
    fx = Fixture(spark, sf_dir)
    arrivals, out_dir = scratch_path(spark, "arrivals"), scratch_path(spark, "stream")
    pages = fx.details()
    step = F.least(F.floor(F.col("seq.cat_idx") / 2), F.lit(2))
    for i in range(3):
        pages.filter(step == i).write.mode("append").parquet(arrivals)
        run_stream(spark, arrivals, out_dir, RUN_TS)
    return out_dir


def stream_catalog(spark, sf_dir):
    return judged_rows(spark, _streamed(spark, sf_dir)).select("url", "dedup_key", "verdict")


def stream_rejects(spark, sf_dir):
    return rejected_rows(spark, _streamed(spark, sf_dir)).select("url", "gate_reason")


def stream_unextractable(spark, sf_dir):
    return to_refetch(spark, _streamed(spark, sf_dir))


def stream_retry(spark, sf_dir):
    """Pages without a product are fetched again and arrive with one: nothing is left to refetch."""
    fx = Fixture(spark, sf_dir)
    arrivals, out_dir = scratch_path(spark, "arrivals"), scratch_path(spark, "stream")
    fx.details().write.parquet(arrivals)
    run_stream(spark, arrivals, out_dir, RUN_TS)
    again = fx.details().join(to_refetch(spark, out_dir), "url", "left_semi")
    again = again.withColumn("html", F.lit('<h1 class="page-title"><span>Again</span></h1>'))
    again.write.mode("append").parquet(arrivals)
    run_stream(spark, arrivals, out_dir, RUN_TS)
    left = to_refetch(spark, out_dir).select("url", F.lit("left").alias("verdict"))
    return judged_rows(spark, out_dir).filter("batch_id > 0").select("url", "verdict").unionByName(left)


def stream_health_windows(spark, sf_dir):
    """Health windows of the event log as a stream, closed by its watermark."""
    log, out_dir = scratch_path(spark, "log"), scratch_path(spark, "health")
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(log)
    stream_health(spark.readStream.schema(events.schema).parquet(log), out_dir, late="0 seconds", every="1 day",
                  ok=F.col("event_type") != "error", latency=F.col("value"), alert_below=0.8)
    closed = spark.read.parquet(f"{out_dir}/windows")
    return scalars(closed.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


def stream_accepted(spark, sf_dir):
    return scalars(stream_products(spark, _streamed(spark, sf_dir)).select("url", "name", "sku", "price", "availability"))


QUERIES = {f.__name__: f for f in (
    extract_catalog, raw_extraction, unextractable_pages, breadcrumb_paths, missing_fields, page_titles, nav_links,
    resolve_links, product_urls, shop_product_urls, parse_prices, shop_prices, clean_text,
    merge_fallback, gate_rejects, merge_enrichment, fallback_requests, enrich_requests, budget_requests, request_prompts,
    sanitise_attributes, rule_attributes,
    validate_catalog, dedup_first, validate_with_prior, validation_summary, method_counts, schema_gate,
    jsonl_roundtrip, csv_flat, csv_export, pipeline_status, run_summary, seen_urls, archive_keys, changed_pages, page_state, packed_archive,
    listing_links, walked_pages, frontier_full, frontier_capped, empty_listings, unseen_frontier, fetch_misses,
    catalog_products, catalog_products_full, catalog_products_answered,
    page_types, page_type_answers, page_type_counts, classify_requests,
    miss_counts, fields_to_repair, repair_requests, repair_report,
    field_coverage, reject_rate, fallback_rate, dup_rate_trend, drift_report, audit_sample, health_windows,
    compare_selectors, nearest_products, stream_catalog, stream_accepted,
    repeated_answers, offline_enrichment, first_round_requests, latest_archived, catalog_products_capped, recrawled_catalog,
    learned_cues, learned_attributes, provider_answers, selector_proposals, damaged_titles, duplicate_spikes, summary_drift, similar_products,
    catalog_products_budgeted, repair_prompts, stream_rejects, stream_unextractable, stream_retry, stream_health_windows,
)}
