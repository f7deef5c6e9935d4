"""Gap filling and enrichment as request and response tables.

No model is called here. Requests are emitted as rows, answers come back as
responses(request_key, kind, body); no responses gives the selector-only result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CRITICAL_FIELDS, CURRENCY, ENRICHMENT_ATTRIBUTES
from ..functions.answers import json_members, json_texts, one_answer
from ..functions.products import compute_once, confidence, gate_reason
from ..functions.running import first_in_order
from ..functions.text import parse_price, strip, strip_blank, truncate_text
from ..plans.scratch import materialize
from ..schemas import PRODUCTS


def request_key(kind: str, url: Column) -> Column:
    return F.concat(F.lit(f"{kind}|"), url)


# --- requests ------------------------------------------------------------------------------

def fallback_requests(raw: DataFrame) -> DataFrame:
    """One request per row with missing critical fields, asking for those only."""
    return raw.filter(F.size("missing") > 0).select(
        request_key("fallback", F.col("url")).alias("request_key"),
        F.lit("fallback").alias("kind"), "seq", "url", F.col("missing").alias("fields"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"),
    )


def enrich_requests(products: DataFrame, attributes=ENRICHMENT_ATTRIBUTES) -> DataFrame:
    """One request per product with a name or a description (after the gaps were filled)."""
    has_prose = (F.coalesce("name", F.lit("")) != "") | (F.coalesce("description", F.lit("")) != "")
    return products.filter(has_prose).select(
        request_key("enrich", F.col("url")).alias("request_key"),
        F.lit("enrich").alias("kind"), "seq", "url",
        F.array(*[F.lit(a) for a in attributes]).alias("fields"), "name", "description",
    )


def budget_requests(requests: DataFrame, max_calls: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests that are sent, requests that are not): one shared budget, spent in arrival order; None sends all.

    A row's fallback comes before its enrichment. Only keys take part in the ranking, and only those of the one
    page in which the budget runs out are sorted. `requests` is read several times, so pass a stored table.
    """
    if max_calls is None:
        return requests, requests.limit(0)
    order = F.struct("seq.pos", F.when(F.col("kind") == "fallback", 0).otherwise(1).alias("_kind"), "request_key")
    keys = requests.select("request_key", F.col("seq.cat_idx").alias("_outer"), F.col("seq.page_num").alias("_inner"), order.alias("_order"))
    sent = first_in_order(keys, [], max_calls).select("request_key")
    return requests.join(sent, "request_key", "left_semi"), requests.join(sent, "request_key", "left_anti")


def with_prompts(requests: DataFrame, pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Add the prompt text; `max_chars` cuts a page's HTML. Call it after the budget, so that few pages are looked up for their HTML.

    The requests are stored first: with their true size known, a small set is sent to the page scan and
    no other page leaves it.
    """
    requests = materialize(requests, "requests")
    html = pages.select("url", "html").join(requests.filter("kind = 'fallback'").select("url"), "url", "left_semi")
    html = html.select("url", truncate_text(F.col("html"), max_chars).alias("_html"))
    asked = F.array_join("fields", ", ")
    fallback = F.concat(
        F.lit("Extract these fields of the product page below: "), asked,
        F.lit("\nAnswer with one JSON object. Leave out what the page does not state. A price is a plain number.\n\n"),
        F.coalesce("_html", F.lit("")),
    )
    enrich = F.concat(
        F.lit("Read the product text and state these attributes as one JSON object: "), asked,
        F.lit('\nLeave out what the text does not support. Write booleans as "true" or "false".\n\nName: '),
        F.coalesce("name", F.lit("")), F.lit("\nDescription: "), F.coalesce("description", F.lit("")),
    )
    prose = requests.filter("kind = 'enrich'").withColumn("prompt", enrich)
    lookups = requests.filter("kind = 'fallback'").join(html, "url", "left").withColumn("prompt", fallback).drop("_html")
    return lookups.unionByName(prose)


# --- responses -----------------------------------------------------------------------------

def parse_responses(responses: DataFrame, kind: str) -> DataFrame:
    """(request_key, answer): the critical fields of the body as a variant, null unless it is a JSON object."""
    answers = one_answer(responses.filter(F.col("kind") == kind))
    return answers.select("request_key", json_members(F.col("body"), CRITICAL_FIELDS).alias("answer"))


def response_map(body: Column, attributes=ENRICHMENT_ATTRIBUTES) -> Column:
    """JSON object -> map<string,string> of the attributes; anything else gives an empty map."""
    return json_texts(body, attributes)


def sanitise_attributes(answer: Column, attributes=ENRICHMENT_ATTRIBUTES) -> Column:
    """Keep requested keys with a value that is not blank, trimmed."""
    trimmed = F.transform_values(answer, lambda k, v: strip(v))
    return F.map_filter(trimmed, lambda k, v: k.isin(*attributes) & F.coalesce(v != "", F.lit(False)))


def _offer(field: str) -> Column:
    """What the answer says about one field: its JSON type, text, number, and whether it fills a gap.

    A value fills when its field is missing and the value is truthy: "", 0, false, null, [] and {} are not.
    """
    member = f"try_variant_get(answer, '$.{field}', 'variant')"
    return F.expr(f"""transform(array(named_struct(
            'type', schema_of_variant({member}),
            'text', try_variant_get(answer, '$.{field}', 'string'),
            'number', try_variant_get(answer, '$.{field}', 'double'))), v -> named_struct(
        'type', v.type, 'text', v.text, 'number', coalesce(v.number, case when v.text = 'true' then 1.0D end),
        'fills', array_contains(missing, '{field}') and coalesce(case
            when v.type = 'STRING' then v.text <> ''
            when v.type = 'BOOLEAN' then v.text = 'true'
            when v.type like 'ARRAY%' then v.text <> '[]'
            when v.type like 'OBJECT%' then v.text <> '{{}}'
            when v.type = 'VOID' then false
            else v.number <> 0 end, false)))[0]""").alias(f"_{field}")


def merge_fallback(raw: DataFrame, responses: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(products, rejects with `gate_reason`), both of `judge_fallback`; store that one where both are read."""
    return split_judged(judge_fallback(raw, responses))


def split_judged(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return judged.filter("gate_reason is null").drop("gate_reason"), judged.filter("gate_reason is not null")


def judge_fallback(raw: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Fill missing critical fields and build product rows, with `gate_reason` where a row must be dropped.

    A filled text field whose JSON type is not text, or an invalid price, drops the row. Missing fields
    take truthy values only; others stay as they are.
    """
    if responses is None:
        joined = raw.withColumn("answer", F.lit(None).cast("variant"))
    else:
        joined = (
            raw.withColumn("request_key", request_key("fallback", F.col("url")))
            .join(parse_responses(responses, "fallback"), "request_key", "left")
            .drop("request_key")
        )

    offers = compute_once(joined, [_offer(f) for f in CRITICAL_FIELDS], [c for c in joined.columns if c != "answer"])
    # Fields the selectors gave, url and category path aside; price text counts even if it is no number.
    given = [
        "name <> ''", "pack_size <> ''", "availability <> ''", "size(image_urls) > 0", "size(specifications) > 0",
        "sku <> '' and not _sku.fills", "brand <> '' and not _brand.fills",
        "description <> '' and not _description.fills", "price_text <> '' and not _price.fills",
    ]
    n_given = " + ".join(f"int(coalesce({g}, false))" for g in given)
    filled = ", ".join(f"case when _{f}.fills then '{f}' end" for f in CRITICAL_FIELDS)
    wrong_type = " or ".join(f"(_{f}.fills and _{f}.type <> 'STRING')" for f in ("sku", "brand", "description"))
    price = (
        F.when(F.expr("_price.fills and _price.type = 'STRING'"), parse_price(F.col("_price.text")))
        .otherwise(F.expr("case when _price.fills then _price.number else price end"))
    )
    now = lambda field: F.expr(f"case when _{field}.fills then _{field}.text else {field} end")
    noted = compute_once(offers, [
        F.expr(f"array_compact(array({filled}))").alias("fields_via_llm"),
        F.expr(f"{n_given}").alias("_n_given"),
        F.expr(f"{wrong_type} or (_price.fills and rlike(_price.type, '^(ARRAY|OBJECT)'))").alias("_wrong_type"),
        now("sku").alias("_sku_now"), now("brand").alias("_brand_now"),
        strip_blank(now("description")).alias("_description_now"), price.alias("_price_now"),
    ], ["*"])
    method = "case when size(fields_via_llm) = 0 then 'selector' when _n_given <= 1 then 'llm_fallback' else 'hybrid' end"
    built = noted.withColumn("extraction_method", F.expr(method)).select(
        *(["seq"] if "seq" in raw.columns else []),
        "name", "url", F.expr("coalesce(category_path, cast(array() as array<string>))").alias("category_path"),
        F.col("_brand_now").alias("brand"), F.col("_sku_now").alias("sku"), F.col("_price_now").alias("price"),
        F.lit(CURRENCY).alias("currency"), "pack_size", "availability", F.col("_description_now").alias("description"),
        "specifications", "image_urls", F.expr("cast(array() as array<string>)").alias("alternative_skus"),
        "extraction_method", confidence(F.col("extraction_method")).alias("extraction_confidence"), "fields_via_llm",
        F.expr("coalesce(_wrong_type, false)").alias("_wrong_type"),
    )
    wrong = F.when(F.col("_wrong_type"), "filled value has the wrong type")
    return built.withColumn("gate_reason", F.coalesce(wrong, gate_reason(built))).drop("_wrong_type")


def merge_enrichment(products: DataFrame, responses: DataFrame | None = None, attributes=ENRICHMENT_ATTRIBUTES) -> DataFrame:
    """Add attribute values for keys the selectors did not give; note it in method, confidence and provenance."""
    if responses is None:
        return products
    answers = one_answer(responses.filter("kind = 'enrich'")).select(
        "request_key", sanitise_attributes(response_map(F.col("body"), attributes), attributes).alias("_attrs"))
    known = F.coalesce(F.map_keys("specifications"), F.array().cast("array<string>"))
    added = F.map_filter(F.col("_attrs"), lambda k, v: ~F.array_contains(known, k))
    enriched = F.coalesce(F.size("_added") > 0, F.lit(False))
    promoted = enriched & (F.col("extraction_method") == "selector")
    return (
        products.withColumn("request_key", request_key("enrich", F.col("url")))
        .join(answers, "request_key", "left")
        .withColumn("_added", added)
        .withColumns({
            "specifications": F.when(enriched, F.map_concat("specifications", "_added")).otherwise(F.col("specifications")),
            "fields_via_llm": F.when(enriched, F.array_union("fields_via_llm", F.array(F.lit("specifications"))))
            .otherwise(F.col("fields_via_llm")),
            "extraction_confidence": F.when(promoted, F.least("extraction_confidence", F.lit(0.85)))
            .otherwise(F.col("extraction_confidence")),
            "extraction_method": F.when(promoted, "hybrid").otherwise(F.col("extraction_method")),
        })
        .select(*products.columns)
    )


def stamp(products: DataFrame, run_ts) -> DataFrame:
    """Add `extracted_at`, one value per run (a datetime, or a text with its zone), and put the columns in schema order (extra columns first)."""
    extra = [c for c in products.columns if c not in PRODUCTS.fieldNames()]
    stamped = products.withColumn("extracted_at", F.lit(run_ts).cast("timestamp"))
    return stamped.select(*extra, *PRODUCTS.fieldNames())
