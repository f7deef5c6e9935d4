"""Expected results in plain SQL over the given tables, computed without any HTML or package code.

`RULES` (what each part's page says) are shared with the fixture; everything derived from them is stated here.
"""

from .queries import AUDIT, BUDGET, CAP, QUERY_VECTOR
from .rendered import RULES, SHOP

_k = "p_partkey"
_ENTRY = "cast(p_partkey as varchar)"

# What the pages say, part by part.
_RULED = f"""
placed as (
  select *, cast(dense_rank() over (order by p_type) - 1 as integer) as cat_idx, {RULES['page_num']} as page_num from part),
ruled as (
  select *, {RULES['slug']} as slug, {RULES['bare']} as bare, {RULES['ftp']} as ftp, {RULES['drifted']} as drifted,
    case when not {RULES['no_name']} then p_name || ' ' || {_ENTRY} end as name,
    {RULES['sku']} as sku, {RULES['brand']} as brand, {RULES['description']} as description, {RULES['pack_size']} as pack_size,
    case when {RULES['ftp']} then 'ftp' else 'https' end || '://shop.example.com/product/' || {RULES['slug']} as url,
    split_part(p_name, ' ', 2) as noun, split_part(p_name, ' ', 1) as adjective,
    case when {RULES['bare']} then null when {_k} % 103 = 0 then 0.0 when {_k} % 101 = 0 then -5.0
         when {_k} % 6 = 0 then round(p_retailprice * 10, 2) when {_k} % 6 in (1, 2, 5) then round(p_retailprice, 2) end as price,
    not ({RULES['bare']}) and ({_k} % 103 = 0 or {_k} % 101 = 0 or {_k} % 6 <> 4) as has_price_text,
    case when {RULES['bare']} then null
         else ['in_stock', 'out_of_stock', 'backorder', 'in_stock', null][{_k} % 5 + 1] end as availability,
    case when {RULES['ftp']} then [] else ['{SHOP}/media/' || {_ENTRY} || '.png'] end as thumb,
    list_transform(range(1, case when {_k} % 50 = 0 then 13 else {_k} % 4 + 1 end),
                   lambda i: 'https://img.example.com/' || {_ENTRY} || '-' || cast(i as varchar) || '.jpg') as shots
  from placed),
said as (
  select *,
    case when bare then [] else (case when {_k} % 2 = 1 then list_concat(thumb, shots) else list_concat(shots, thumb) end) end as images,
    case when bare then '' else 'Color=' || adjective || '|Material=' || case when {_k} % 9 = 0 then adjective else noun end end as specs,
    coalesce(price < 0, false) as bad_price,
    sku is null or coalesce(price < 0, false) as m_sku, brand is null or coalesce(price < 0, false) as m_brand,
    description is null or coalesce(price < 0, false) as m_description,
    coalesce(price <= 0, true) as m_price
  from ruled),
pages_ok as (
  select *, concat_ws('|', case when m_sku then 'sku' end, case when m_brand then 'brand' end,
                      case when m_description then 'description' end, case when m_price then 'price' end) as missing
  from said where name is not null)"""

# Selector-only products.
_PRODUCTS = _RULED + """,
products as (
  select *, 'selector' as extraction_method, 1e0 as extraction_confidence, '' as fields_via_llm from pages_ok where not bad_price)"""

# Products with fallback answers merged.
_FILLED = _RULED + f""",
offers as (
  select *, {_k} % 7 as r,
    m_sku and {_k} % 7 = 0 as f_sku, m_brand and {_k} % 7 = 0 as f_brand,
    m_description and {_k} % 7 in (0, 4) as f_description, m_price and {_k} % 7 in (0, 3) as f_price,
    (m_sku and {_k} % 7 = 5) or (m_brand and {_k} % 7 = 3) as mistyped
  from pages_ok),
merged as (
  select * replace (
      case when f_sku then 'R-' || {_ENTRY} else sku end as sku,
      case when f_brand then 'Acme' else brand end as brand,
      case when f_description and r = 0 then 'Filled  text' when f_description then 'D' else description end as description,
      case when f_price and r = 0 then 7.5 when f_price then 3.0 else price end as price),
    concat_ws('|', case when f_sku then 'sku' end, case when f_brand then 'brand' end,
              case when f_description then 'description' end, case when f_price then 'price' end) as filled,
    1 + (pack_size is not null)::int + (availability is not null)::int + (len(images) > 0)::int + (specs <> '')::int
      + (sku is not null and not f_sku)::int + (brand is not null and not f_brand)::int
      + (description is not null and not f_description)::int + (has_price_text and not f_price)::int as n_given
  from offers),
built as (
  select *, case when filled = '' then 'selector' when n_given <= 1 then 'llm_fallback' else 'hybrid' end as method,
    case when filled = '' then 1e0 when n_given <= 1 then 6e-1 else 8e-1 end as score,
    case when mistyped then 'filled value has the wrong type' when price < 0 then 'price is negative or not a number' end as gate_reason
  from merged)"""

# ... and enrichment answers merged.
_ADDED = f"""case {_k} % 7 when 0 then 'color=red|material=vinyl|powder_free=true|size=5'
                 when 3 then 'sterile=false' when 5 then 'form=sponge' else '' end"""
_ANSWERED = _FILLED + f""",
answered as (
  select *, {_ADDED} as added,
    concat_ws('|', case when specs <> '' then specs end, case when {_ADDED} <> '' then {_ADDED} end) as all_specs,
    case when method = 'selector' and {_ADDED} <> '' then 'hybrid' else method end as extraction_method,
    case when method = 'selector' and {_ADDED} <> '' then 85e-2 else score end as extraction_confidence,
    concat_ws('|', case when filled <> '' then filled end, case when {_ADDED} <> '' then 'specifications' end) as fields_via_llm
  from built where gate_reason is null)"""

_KEY = "coalesce(nullif(sku, ''), url)"


def _judged(source: str, order: str = "cat_idx, p_partkey") -> str:
    return f"""
  select *, case when n > 1 then 'duplicate' when not regexp_matches(url, '^https?://') then 'invalid' else 'ok' end as verdict
  from (select *, {_KEY} as dedup_key, row_number() over (partition by {_KEY} order by {order}) as n from {source})"""


_PRODUCT_COLUMNS = """name, url, p_type as category_path, brand, sku, round(price, 6) as price, 'USD' as currency, pack_size,
  availability, description, specs as specifications, array_to_string(images, '|') as image_urls, '' as alternative_skus,
  extraction_method, extraction_confidence, fields_via_llm"""
_FILLED_COLUMNS = _PRODUCT_COLUMNS.replace(
    "extraction_method, extraction_confidence, fields_via_llm",
    "method as extraction_method, score as extraction_confidence, filled as fields_via_llm")
_ANSWERED_COLUMNS = _PRODUCT_COLUMNS.replace("specs as", "all_specs as")

# Links in arrival order, as the walk meets them.
_LINKS = _RULED + """,
links as (select *, row_number() over (partition by cat_idx order by p_partkey) as arrival from ruled where not ftp and not drifted)"""

_POS = "row_number() over (partition by cat_idx, page_num order by p_partkey) - 1"

_LISTINGS = f"""
bounds as (select max(p_partkey) // 144 as last_page from part),
cats as (select p_type, cast(row_number() over (order by p_type) - 1 as integer) as cat_idx, '{SHOP}/catalog/' || lower(p_type) as cat_url
         from (select distinct p_type from part)),
grid as (select cat_idx, cat_url, page_num, last_page, case when page_num = 0 then cat_url else cat_url || '?page=' || cast(page_num + 1 as varchar) end as url
         from cats, bounds, unnest(range(0, last_page + 1)) as t(page_num))"""

_JSON_TEXT = "'\"' || replace({0}, '\"', '\\\"') || '\"'"


def _json_list(values: str) -> str:
    return f"'[' || array_to_string(list_transform({values}, lambda v: '\"' || v || '\"'), ', ') || ']'"


_CSV_SPECS = f"""case when bare then '{{}}' else '{{"Material": "' || case when {_k} % 9 = 0 then adjective else noun end || '", "Color": "' || adjective || '"}}' end"""
_CSV_COLUMNS = f"""name, coalesce(brand, '') as brand, coalesce(sku, '') as sku, coalesce(cast(price as varchar), '') as price, 'USD' as currency,
  coalesce(pack_size, '') as pack_size, coalesce(availability, '') as availability, '["' || p_type || '"]' as category_path, url,
  coalesce(description, '') as description, {_json_list('images')} as image_urls, {_CSV_SPECS} as specifications,
  extraction_method, '1.0' as extraction_confidence, '[]' as fields_via_llm, '2026-01-01T00:00:00.000000Z' as extracted_at"""

_REQUESTS = f""",
requests as (
  select 'fallback|' || url as request_key, 'fallback' as kind, url, cat_idx, {_k}, 0 as ord from built where missing <> ''
  union all
  select 'enrich|' || url, 'enrich', url, cat_idx, {_k}, 1 from built where gate_reason is null),
sent as (select * from requests order by cat_idx, {_k}, ord limit {BUDGET})"""

# The text before a page, or the whole prompt of an enrichment.
_ATTRIBUTES = "material, color, powder_free, size, pack_size, sterile, absorbable, form, texture, intended_use, latex_free, thickness_mil"
_PROMPT = f"""case when r.kind = 'fallback'
  then 'Extract these fields of the product page below: ' || replace(b.missing, '|', ', ') || chr(10)
    || 'Answer with one JSON object. Leave out what the page does not state. A price is a plain number.'
  else 'Read the product text and state these attributes as one JSON object: {_ATTRIBUTES}' || chr(10)
    || 'Leave out what the text does not support. Write booleans as "true" or "false".' || chr(10) || chr(10)
    || 'Name: ' || b.name || chr(10) || 'Description: ' || coalesce(b.description, '') end"""

_MISSES = _RULED + """,
misses as (
  select * from (select cat_idx, p_partkey, url, unnest(string_split(missing, '|')) as field from pages_ok where missing <> ''))"""

_BROKEN = """case field when 'sku' then 'form[data-sku]'
    when 'brand' then '.pdp-brand-review a span, [href*=''shop-by-manufacturer''] span, .manufacturer-name'
    when 'price' then '.price-box .price, .price' else '#description, [itemprop=''description''], .product-info-main .description' end"""

_COVERED = {
    "name": "name is not null", "url": "true", "category_path": "true", "brand": "brand <> ''", "sku": "sku <> ''",
    "price": "price is not null", "currency": "true", "pack_size": "pack_size <> ''", "availability": "availability <> ''",
    "description": "description <> ''", "specifications": "all_specs <> ''", "image_urls": "len(images) > 0",
    "alternative_skus": "false", "extraction_method": "true", "extraction_confidence": "true", "fields_via_llm": "fields_via_llm <> ''",
}

_TWO_RUNS = _ANSWERED + f""",
runs as (
  select 1 as run_id, cat_idx, {_k}, url, sku, price, brand, images, 'selector' as extraction_method from pages_ok where not bad_price
  union all
  select 2, cat_idx, {_k}, url, sku, price, brand, images, extraction_method from answered)"""


def _shares(value: str, prefix: str) -> str:
    one = lambda run: f"""(select {value} as v, count(*) / (select count(*) from runs where run_id = {run}) as share from runs where run_id = {run} group by 1)"""
    return f"""select '{prefix}' || coalesce(c.v, p.v) as metric, coalesce(c.share, 0e0) as current, coalesce(p.share, 0e0) as prior
  from {one(2)} c full join {one(1)} p on c.v = p.v"""


_QUANTILES = " union all ".join(
    f"select 'price_p{round(q * 100):02d}', quantile_disc(price, {q}) filter (run_id = 2), quantile_disc(price, {q}) filter (run_id = 1) from runs"
    for q in (0.1, 0.25, 0.5, 0.75, 0.9))

_BASE_DIR = "regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '[^/]*$', '')"
_SITE = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_HREFS = """
hrefs as (
  select page_id, url, unnest(l) as href, unnest(range(0, len(l))) as pos
  from (select page_id, url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) as l from pages)),
parts as (select *, """ + _SITE + """ as site, """ + _BASE_DIR + """ as dir, substr(href, 2) as tail,
  regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) as query from hrefs)"""

_WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_TAUGHT = _PRODUCTS + f""",
requests as (
  select 'enrich|' || url as request_key, regexp_extract_all(lower(concat_ws(' ', name, description)), '[\\p{{L}}\\p{{N}}]+') as w,
    cast(('0x' || substr(md5('enrich|' || url), 1, 8)) as bigint) % 5 as part, *
  from products),
cued as (
  select request_key, part, unnest(list_distinct(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) as cue from requests),
given as (
  select * from (select request_key, part, unnest(['color', 'material', 'size', 'texture', 'form']) as attribute,
    unnest([adjective, noun, case when p_size < 25 then 'small' else 'large' end, case when {_k} % 3 > 0 then 'matte' else 'glossy' end,
            case when {_k} % 2 = 0 then split_part(p_type, ' ', 1) end]) as value from requests) where value is not null)"""

_LEARNED = """,
times as (select cue, count(*) as times from cued where part <> 0 group by 1 having count(*) >= 5),
votes as (
  select g.attribute, c.cue, g.value, count(*) as support from given g join cued c on c.request_key = g.request_key
  where g.part <> 0 group by 1, 2, 3 having count(*) >= 5),
model as (
  select attribute, v.cue, value, support, support / cast(times + 1 as double) as precision
  from (select *, row_number() over (partition by attribute, cue order by support desc, value) as nth from votes) v join times t on t.cue = v.cue where nth = 1)"""

ORACLES = {
    # extraction
    "extract_catalog": f"with {_PRODUCTS} select {_PRODUCT_COLUMNS} from products",
    "raw_extraction": f"""with {_RULED}
select url, p_type as category_path, name, brand, sku, pack_size, availability, description, specs as specifications,
  array_to_string(images, '|') as image_urls, missing,
  case when not has_price_text then null when {_k} % 103 = 0 then '$0.00' when {_k} % 101 = 0 then '-5.00'
       when {_k} % 6 = 0 then '$' || format('{{:,.2f}}', p_retailprice * 10)
       when {_k} % 6 = 1 then printf('%.2f', p_retailprice) || ' USD' when {_k} % 6 = 2 then printf('%.2f', p_retailprice)
       when {_k} % 6 = 3 then 'From $' || printf('%.2f', p_retailprice)
       else '$' || printf('%.2f', p_retailprice) || ' - $' || format('{{:,.2f}}', p_retailprice + 100) end as price_text
from pages_ok""",
    "unextractable_pages": f"with {_RULED} select url from ruled where name is null",
    "breadcrumb_paths": f"with {_RULED} select url, 'Catalog|' || p_type as category_path from pages_ok",
    "missing_fields": f"with {_RULED} select url, missing from pages_ok",
    "page_titles": "select page_id, replace(trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)), '&amp;', '&') as title from pages",
    "nav_links": f"with {_HREFS} select page_id, pos, site || href as link from parts",
    "resolve_links": f"""with {_HREFS}
select page_id, pos, unnest(['rooted', 'relative', 'parent', 'dotted', 'host', 'query', 'fragment', 'absolute', 'empty']) as form,
  unnest([site || href, site || dir || tail, site || regexp_replace(dir, '[^/]*/$', '') || tail, site || dir || tail,
          split_part(site, '//', 1) || '//cdn.example.com' || href, site || path || '?page=9', site || path || query || '#part',
          'mailto:' || tail, url]) as link
from parts""",
    "product_urls": """select page_id, url,
  not (contains(url, '/customer/') or contains(url, '/cart') or contains(url, '/checkout') or contains(url, '/search')
       or contains(url, '/contact') or contains(url, '/account') or contains(url, '/login') or contains(url, 'javascript:')
       or contains(url, '#') or contains(url, '/shop-by-manufacturer/') or contains(url, '/catalog'))
  and (contains(url, '/product/') or url like '%.html') as is_product from pages""",
    "shop_product_urls": """select p_partkey, unnest(range(0, 5)) as form, unnest([true, false, false, true, false]) as is_product from part""",
    # value functions
    "parse_prices": "select l_orderkey, l_linenumber, round(l_extendedprice, 2) as price, cast(null as double) as no_price from lineitem",
    "shop_prices": f"with {_RULED} select p_partkey, price from ruled",
    "clean_text": f"""
select doc_id, md5(c) as cleaned_md5, length(c) as n_chars,
  md5(case when length(c) > 300 then substr(c, 1, 300) || chr(10) || '<!-- truncated -->' else c end) as truncated_md5
from (select doc_id, trim(regexp_replace(text || ' end ', '{_WS}+', ' ', 'g')) as c from documents)""",
    # gap filling
    "merge_fallback": f"with {_FILLED} select {_FILLED_COLUMNS} from built where gate_reason is null",
    "gate_rejects": f"with {_FILLED} select url, gate_reason from built where gate_reason is not null",
    "merge_enrichment": f"with {_ANSWERED} select {_ANSWERED_COLUMNS} from answered",
    "fallback_requests": f"with {_RULED} select 'fallback|' || url as request_key, 'fallback' as kind, missing as fields from pages_ok where missing <> ''",
    "enrich_requests": f"with {_FILLED} select 'enrich|' || url as request_key, 'enrich' as kind, name, description from built where gate_reason is null",
    "budget_requests": f"with {_FILLED}{_REQUESTS} select request_key, kind, url from sent",
    "request_prompts": f"""with {_FILLED}{_REQUESTS}
select r.request_key, r.kind, md5({_PROMPT}) as prompt_md5, r.kind = 'fallback' as has_page
from requests r join built b on r.url = b.url""",
    "first_round_requests": f"""with {_PRODUCTS},
reachable as (select * from pages_ok where not ftp and not drifted),
requests as (
  select 'fallback|' || url as request_key, 'fallback' as kind, url from reachable where missing <> ''
  union all select 'enrich|' || url, 'enrich', url from reachable where not bad_price)
select r.request_key, r.kind, md5({_PROMPT}) as prompt_md5, r.kind = 'fallback' as has_page
from requests r join reachable b on r.url = b.url""",
    "repeated_answers": f"with {_ANSWERED} select {_ANSWERED_COLUMNS} from answered",
    "offline_enrichment": f"""with {_PRODUCTS}
select url, concat_ws('|', case when specs <> '' then specs end, case when {_k} % 7 < 2 then 'absorbable=' || case when {_k} % 7 = 0 then 'true' else 'false' end end,
  'color=' || ['blue', 'white', 'green', 'pink'][{_k} % 4 + 1], 'form=' || ['lamp', 'chair', 'shelf'][{_k} % 3 + 1], 'intended_use=' || ['indoor', 'outdoor'][{_k} % 2 + 1],
  case when {_k} % 6 < 2 then 'latex_free=' || case when {_k} % 6 = 0 then 'false' else 'true' end end,
  'material=' || ['oak', 'brass', 'wool'][{_k} % 3 + 1], 'pack_size=' || cast({_k} % 50 + 1 as varchar) || '/box',
  'powder_free=' || case when {_k} % 2 = 0 then 'true' else 'false' end, 'size=' || ['small', 'medium', 'large'][{_k} % 3 + 1],
  case when {_k} % 5 < 3 then 'sterile=' || case when {_k} % 5 = 0 then 'false' else 'true' end end,
  'texture=' || ['matte', 'glossy'][{_k} % 2 + 1], 'thickness_mil=' || cast({_k} % 9 + 1 as varchar)) as specifications,
  'hybrid' as extraction_method, 85e-2 as extraction_confidence from products""",
    "learned_cues": f"with {_TAUGHT}{_LEARNED} select attribute, cue, value, support, precision from model",
    "learned_attributes": f"""with {_TAUGHT}{_LEARNED},
predicted as (
  select a.request_key, m.attribute, m.value, m.precision,
    row_number() over (partition by a.request_key, m.attribute order by m.precision desc, m.support desc, m.value) as nth
  from cued a join model m on m.cue = a.cue where a.part = 0),
best as (select * from predicted where nth = 1),
judged as (
  select b.*, cast(floor(b.precision * 20) as bigint) as step, coalesce(g.value = b.value, false) as is_right
  from best b left join given g on g.request_key = b.request_key and g.attribute = b.attribute),
steps as (select attribute, step, count(*) as n, count(*) filter (is_right) as n_right from judged group by 1, 2),
sums as (select s.attribute, s.step, sum(a.n) as n, sum(a.n_right) as n_right from steps s join steps a on a.attribute = s.attribute and a.step >= s.step group by 1, 2),
bounds as (select attribute, min(step) / 20 as bound from sums where n >= 5 and n_right >= 0.9 * n group by 1),
sure as (select b.* from best b join bounds o on o.attribute = b.attribute where b.precision >= o.bound)
select request_key, '{{' || string_agg('"' || attribute || '":"' || value || '"', ',' order by attribute) || '}}' as body from sure group by request_key""",
    "provider_answers": f"""with {_PRODUCTS}
select 'enrich|' || url as request_key, '{{"color": "' || adjective || '"}}' as body,
  cast(case when {_k} % 5 = 0 then 2 else 1 end as bigint) as calls, case when {_k} % 5 = 0 then 'ValueError: down' end as error from products""",
    "selector_proposals": f"""with {_PRODUCTS},
third as (select * from products where {_k} % 3 = 1)
select 'name' as field, '.headline' as selector, 'text' as take, count(*) as hits, cast(0 as bigint) as errors, cast(0 as bigint) as misses from third having count(*) > 0
union all select 'sku', '[data-item]', 'data-item', count(*), 0, 0 from third where sku is not null having count(*) > 0
union all select 'price', '.cost', 'text', count(*), 0, 0 from third where price is not null having count(*) > 0""",
    "damaged_titles": "select page_id, chr(65533) || '-' || replace(rtrim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)), '&amp;', '&') as title from pages",
    "duplicate_spikes": """with recursive rates as (
  select user_id % 4 as category, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as run_id, count(*) as n,
    avg(case when event_type = 'error' or (date_diff('day', date '2024-01-01', cast(ts as date)) = 20 and user_id % 4 = 2 and event_type in ('view', 'click', 'purchase'))
      then 1e0 else 0e0 end) as rate
  from events group by 1, 2),
ordered as (select *, row_number() over (partition by category order by run_id) as t from rates),
chart as (
  select category, run_id, t, rate as mean, 1 as runs, cast(null as double) as expected, cast(null as double) as upper, false as spike from ordered where t = 1
  union all
  select category, run_id, t, case when spike then mean else mean + 0.2e0 * (rate - mean) end, runs + cast(not spike as integer), mean, upper, spike
  from (select o.category, o.run_id, o.t, o.rate, c.mean, c.runs, c.mean + 4e0 * sqrt((c.mean * (1 - c.mean) + 1 / cast(o.n as double)) / cast(o.n as double)) as upper,
          c.runs >= 5 and o.rate > c.mean + 4e0 * sqrt((c.mean * (1 - c.mean) + 1 / cast(o.n as double)) / cast(o.n as double)) as spike
        from chart c join ordered o on o.category = c.category and o.t = c.t + 1))
select category, run_id, round(expected, 6) as expected, round(upper, 6) as upper, spike from chart""",
    "summary_drift": f"""with {_TWO_RUNS},
brands as (select run_id, brand from runs where brand is not null group by 1, 2)
select 'rows' as metric, count(*) filter (run_id = 2) * 1e0 as current, count(*) filter (run_id = 1) * 1e0 as prior from runs
union all select 'brands', count(*) filter (run_id = 2) * 1e0, count(*) filter (run_id = 1) * 1e0 from brands
union all select 'common_brands', count(*) * 1e0, count(*) * 1e0 from (select brand from brands group by 1 having count(*) = 2)
union all select unnest(['price_p10', 'price_p25', 'price_p50', 'price_p75', 'price_p90']), 1e0, 1e0""",
    "similar_products": """with v as (
  select vec_id, embedding as e, sqrt(list_sum([x::double * x::double for x in embedding])) as size from embeddings
  where vec_id is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
scored as (
  select q.vec_id as query_id, c.vec_id, round(list_sum([p[1]::double * p[2]::double for p in list_zip(q.e, c.e)]) / (q.size * c.size), 9) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, rank, vec_id, round(score, 6) as score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 10""",
    "sanitise_attributes": f"with {_RULED} select 'enrich|' || url as request_key, {_ADDED} as attributes from ruled where {_k} % 7 <> 6",
    "rule_attributes": """select p_partkey, concat_ws('|',
  case when split_part(p_name, ' ', 1) in ('red', 'blue') then 'color=' || split_part(p_name, ' ', 1) end,
  'material=' || split_part(p_name, ' ', 2),
  case when p_size % 2 = 0 then 'pack_size=' || cast(p_size * 10 as varchar) || '/box' end,
  case when p_size % 2 = 0 then 'powder_free=true' end,
  case when split_part(p_name, ' ', 1) in ('small', 'large') then 'size=' || split_part(p_name, ' ', 1) end,
  case when p_size % 2 = 1 then 'sterile=false' end) as attributes from part""",
    # validation and counters
    "validate_catalog": f"""with {_PRODUCTS}
select url, dedup_key, verdict, verdict = 'ok' as valid,
  case verdict when 'duplicate' then 'duplicate: ' || dedup_key when 'invalid' then 'invalid url scheme' else 'ok' end as reason
from ({_judged('products')})""",
    "dedup_first": f"with {_PRODUCTS} select url, sku from ({_judged('products')}) where n = 1",
    "validate_with_prior": f"""with {_PRODUCTS}, earlier as (select distinct sku from ruled where {_k} % 10 = 3 and sku is not null)
select url, case when dedup_key in (select sku from earlier) then 'duplicate' else verdict end as verdict from ({_judged('products')})""",
    "validation_summary": f"""with {_PRODUCTS}
select count(*) as total_seen, count(*) filter (verdict = 'ok') as accepted, count(*) filter (verdict = 'duplicate') as rejected_duplicate,
  cast(0 as bigint) as rejected_incomplete, count(*) filter (verdict = 'invalid') as rejected_invalid,
  round(count(*) filter (verdict = 'ok') / count(*), 6) as acceptance_rate from ({_judged('products')})""",
    "method_counts": f"with {_ANSWERED} select extraction_method, count(*) as n_products from answered group by 1",
    "schema_gate": f"with {_RULED} select url, price, 'price is negative or not a number' as gate_reason from pages_ok where bad_price",
    # sinks and state
    "jsonl_roundtrip": f"with {_PRODUCTS} select {_PRODUCT_COLUMNS} from ({_judged('products')}) where verdict = 'ok'",
    "csv_flat": f"with {_PRODUCTS} select {_CSV_COLUMNS} from products",
    "csv_export": f"with {_PRODUCTS} select {_CSV_COLUMNS} from ({_judged('products')}) where verdict = 'ok'",
    "pipeline_status": f"""with {_PRODUCTS}
select (select count(*) from products) as urls_processed, count(*) filter (verdict = 'ok') as n_products from ({_judged('products')})""",
    "run_summary": f"""with {_PRODUCTS}
select count(*) as total_seen, count(*) filter (verdict = 'ok') as accepted, count(*) filter (verdict = 'duplicate') as rejected_duplicate,
  cast(0 as bigint) as rejected_incomplete, count(*) filter (verdict = 'invalid') as rejected_invalid,
  round(count(*) filter (verdict = 'ok') / count(*), 6) as acceptance_rate, cast(0 as bigint) as llm_calls,
  count(*) as checkpoints, count(*) filter (verdict = 'ok') as csv_rows from ({_judged('products')})""",
    "seen_urls": f"with {_RULED} select url from ruled",
    "archive_keys": "select page_id, substr(sha1(url), 1, 16) as archive_key, sha256(html) as html_hash from pages",
    "changed_pages": """
select page_id, sha256(html) as html_hash from pages p where not exists (
  select 1 from pages e where e.page_id % 3 <> 0 and e.url = p.url and (case when e.page_id % 5 = 0 then e.html || 'old' else e.html end) = p.html)""",
    "page_state": """
with twice as (select url, page_id % 7 <> 0 as met, page_id % 5 = 0 and page_id % 7 <> 0 as changed, html from pages)
select url, sha256(case when changed then html || 'new' else html end) as html_hash, '2026-01-01' as first_seen,
  case when changed then '2026-02-01' else '2026-01-01' end as changed_at, case when met then '2026-02-01' else '2026-01-01' end as seen_at,
  cast(case when changed then 2 else 1 end as bigint) as version from twice""",
    "packed_archive": """
select page_id, u as url, substr(sha1(u), 1, 16) as archive_key, sha256(html) as html_hash
from (select page_id, html, unnest([url, url || '#again']) as u from pages)""",
    "latest_archived": "select url, cast(1 as bigint) as fetched_at from pages group by url",
    # navigation
    "listing_links": f"""with {_RULED}, {_LISTINGS},
counts as (select cat_idx, page_num, count(*) as n from ruled where not ftp and not drifted group by 1, 2)
select url, coalesce(n, 0) as n_links,
  case when page_num < last_page then cat_url || '?page=' || cast(page_num + 2 as varchar) when cat_idx % 2 = 0 then cat_url || '?page=2' end as next_url
from grid left join counts using (cat_idx, page_num)""",
    "walked_pages": f"""with {_RULED}, {_LISTINGS},
counts as (select cat_idx, page_num, count(*) as n from ruled where not ftp and not drifted group by 1, 2)
select cat_idx, page_num, url, coalesce(n, 0) as n_links from grid left join counts using (cat_idx, page_num)""",
    "frontier_full": f"with {_LINKS} select cat_idx, p_type as category, page_num, {_POS} as pos, url from links",
    "frontier_capped": f"with {_LINKS} select * from (select cat_idx, p_type as category, page_num, {_POS} as pos, url, arrival from links) where arrival <= {CAP}".replace("select * from", "select cat_idx, category, page_num, pos, url from"),
    "empty_listings": f"""with {_RULED}, {_LISTINGS}
select cat_idx, page_num, url from grid where not exists (
  select 1 from ruled r where not ftp and not drifted and r.cat_idx = grid.cat_idx and r.page_num = grid.page_num)""",
    "unseen_frontier": f"with {_LINKS} select url, p_type as category_path from links where {_k} % 5 <> 0",
    "fetch_misses": f"with {_LINKS} select url from links where {_k} % 29 = 0",
    "catalog_products": f"""with {_PRODUCTS}, found as (select * from products where not ftp and not drifted)
select {_PRODUCT_COLUMNS} from ({_judged('found')}) where verdict = 'ok'""",
    "recrawled_catalog": f"""with {_PRODUCTS}, found as (select * from products where not ftp and not drifted)
select {_PRODUCT_COLUMNS} from ({_judged('found')}) where verdict = 'ok'""",
    "catalog_products_capped": f"""with {_PRODUCTS}, links as (
  select *, row_number() over (partition by cat_idx order by p_partkey) as arrival from ruled where not ftp and not drifted),
found as (select products.* replace (products.images[1:10] as images) from products join links using (p_partkey) where arrival <= {CAP})
select {_PRODUCT_COLUMNS} from ({_judged('found')}) where verdict = 'ok'""",
    "catalog_products_full": f"""with {_PRODUCTS}, found as (select * from products where not ftp and not drifted and {_k} % 5 <> 0)
select url, name, sku, round(price, 6) as price, dedup_key, verdict from ({_judged('found')})""",
    "catalog_products_answered": f"""with {_RULED},
reachable as (select * from pages_ok where not ftp and not drifted),
-- the budget is spent on reachable pages only
{_ANSWERED[len(_RULED) + 2:].replace('from pages_ok', 'from reachable')},
requests as (
  select 'fallback' as kind, {_k}, cat_idx, 0 as ord from built where missing <> ''
  union all select 'enrich', {_k}, cat_idx, 1 from built where gate_reason is null),
sent as (select * from requests order by cat_idx, {_k}, ord),
asked as (
  select p.*, exists (select 1 from sent s where s.{_k} = p.{_k} and s.kind = 'fallback') as fb,
    exists (select 1 from sent s where s.{_k} = p.{_k} and s.kind = 'enrich') as en from reachable p),
outcome as (
  select a.url, a.cat_idx, a.{_k}, en,
    case when fb then b.sku else a.sku end as sku, case when fb then b.brand else a.brand end as brand,
    case when fb then b.price else a.price end as price, case when fb then b.description else a.description end as description,
    case when fb then b.method else 'selector' end as method, case when fb then b.score else 1e0 end as score,
    case when fb then b.filled else '' end as filled, a.specs, case when en then {_ADDED.replace(_k, 'a.' + _k)} else '' end as added
  from asked a join built b on a.{_k} = b.{_k}
  where case when fb then b.gate_reason is null else not a.bad_price end)
select url, sku, brand, round(price, 6) as price, description,
  concat_ws('|', case when specs <> '' then specs end, case when added <> '' then added end) as specifications,
  case when method = 'selector' and added <> '' then 'hybrid' else method end as extraction_method,
  case when method = 'selector' and added <> '' then 85e-2 else score end as extraction_confidence,
  concat_ws('|', case when filled <> '' then filled end, case when added <> '' then 'specifications' end) as fields_via_llm, verdict
from ({_judged('outcome')})""",
    "catalog_products_budgeted": f"""with {_RULED},
reachable as (select * from pages_ok where not ftp and not drifted),
-- the budget is spent on reachable pages only
{_ANSWERED[len(_RULED) + 2:].replace('from pages_ok', 'from reachable')},
requests as (
  select 'fallback' as kind, {_k}, cat_idx, 0 as ord from built where missing <> ''
  union all select 'enrich', {_k}, cat_idx, 1 from built where gate_reason is null),
sent as (select * from requests order by cat_idx, {_k}, ord limit {BUDGET}),
asked as (
  select p.*, exists (select 1 from sent s where s.{_k} = p.{_k} and s.kind = 'fallback') as fb,
    exists (select 1 from sent s where s.{_k} = p.{_k} and s.kind = 'enrich') as en from reachable p),
outcome as (
  select a.url, a.cat_idx, a.{_k}, en,
    case when fb then b.sku else a.sku end as sku, case when fb then b.brand else a.brand end as brand,
    case when fb then b.price else a.price end as price, case when fb then b.description else a.description end as description,
    case when fb then b.method else 'selector' end as method, case when fb then b.score else 1e0 end as score,
    case when fb then b.filled else '' end as filled, a.specs, case when en then {_ADDED.replace(_k, 'a.' + _k)} else '' end as added
  from asked a join built b on a.{_k} = b.{_k}
  where case when fb then b.gate_reason is null else not a.bad_price end)
select url, sku, brand, round(price, 6) as price, description,
  concat_ws('|', case when specs <> '' then specs end, case when added <> '' then added end) as specifications,
  case when method = 'selector' and added <> '' then 'hybrid' else method end as extraction_method,
  case when method = 'selector' and added <> '' then 85e-2 else score end as extraction_confidence,
  concat_ws('|', case when filled <> '' then filled end, case when added <> '' then 'specifications' end) as fields_via_llm, verdict
from ({_judged('outcome')})""",
    # page types
    "page_types": f"""with {_RULED}, {_LISTINGS}
select url, case when name is not null and has_price_text then 'product_detail' else 'other' end as page_type from ruled
union all select url, 'category_listing' from grid""",
    "page_type_answers": """with first as (select url, arg_min(page_id, page_id) as p from pages where page_id % 4 <> 3 group by 1)
select page_id, case when first.p % 4 = 0 then 'product_detail' else 'other' end as page_type from pages left join first using (url)""",
    "page_type_counts": f"""with {_RULED}, {_LISTINGS}
select page_type, count(*) as n_pages from (
  select case when name is not null and has_price_text then 'product_detail' else 'other' end as page_type from ruled
  union all select 'category_listing' from grid union all select 'other' from pages) group by 1""",
    "classify_requests": f"""with {_RULED}
select 'classify|' || url as request_key, 'classify' as kind, url from ruled where name is null or not has_price_text""",
    # selector failures
    "miss_counts": f"with {_MISSES} select field, count(*) as failures from misses group by 1",
    "fields_to_repair": f"with {_MISSES} select field, count(*) as failures from misses where field <> 'sku' group by 1 having count(*) >= 5",
    "repair_requests": f"""with {_MISSES}
select field, failures, url, {_BROKEN} as broken_selector
from (select *, row_number() over (partition by field order by cat_idx, p_partkey) as n, count(*) over (partition by field) as failures from misses)
where n = 5""",
    "repair_prompts": f"""with {_MISSES}
select field, md5('The CSS selector for the field ' || field || ' finds nothing any more: ' || {_BROKEN} || chr(10)
  || 'Propose up to 3 selectors for it. Answer {{"selectors": ["..."]}}.') as prompt_md5, true as has_page
from (select field, count(*) as failures from misses group by 1) where failures >= 5""",
    "repair_report": f"""with {_MISSES}
select field, count(*) as failures, case when field = 'sku' and count(*) >= 5 then '.sku|#sku|[itemprop=sku]' else '' end as suggested from misses group by 1""",
    # metrics
    "field_coverage": f"with {_ANSWERED} " + " union all ".join(
        f"select '{f}' as field, round(avg(case when {c} then 1e0 else 0e0 end), 6) as coverage from answered" for f, c in _COVERED.items()),
    "reject_rate": f"""with {_PRODUCTS}, verdicts as ({_judged('products')}), gated as (select count(*) as g from pages_ok where bad_price)
select count(*) + g as rows_seen, round(g * 1e3 / (count(*) + g), 6) as gate_rejects_per_1000,
  round(count(*) filter (verdict <> 'ok') * 1e3 / (count(*) + g), 6) as verdict_rejects_per_1000 from verdicts, gated group by g""",
    "fallback_rate": f"""with {_TWO_RUNS}
select run_id, count(*) as n_products, round(avg((extraction_method = 'hybrid')::int), 6) as hybrid_rate,
  round(avg((extraction_method = 'llm_fallback')::int), 6) as llm_fallback_rate from runs group by 1""",
    "dup_rate_trend": f"""with {_TWO_RUNS}, rates as (
  select run_id, count(*) as rows_seen, avg((n > 1)::int) as rate
  from (select *, row_number() over (partition by run_id, {_KEY} order by cat_idx, {_k}) as n from runs) group by 1)
select run_id, rows_seen, round(rate, 6) as duplicate_rate, round(rate - lag(rate) over (order by run_id), 6) as change from rates""",
    "drift_report": f"""with {_TWO_RUNS}
select metric, round(current, 6) as current, round(prior, 6) as prior, round(current - prior, 6) as change from (
  {_QUANTILES.replace("'price_p10',", "'price_p10' as metric,", 1).replace("filter (run_id = 2),", "filter (run_id = 2) as current,", 1).replace("filter (run_id = 1) from", "filter (run_id = 1) as prior from", 1)}
  union all {_shares("cast(len(images) as varchar)", "images_")}
  union all {_shares("coalesce(brand, 'none')", "brand_")})""",
    "audit_sample": f"with {_PRODUCTS} select url, name, sku from products order by md5(url || '|0'), url limit {AUDIT}",
    "health_windows": """
select window_start, n_pages, round(ok_rate, 6) as ok_rate, round(avg_latency, 6) as avg_latency, max_latency, ok_rate < 0.8 as alert from (
  select date_trunc('day', ts) as window_start, count(*) as n_pages, avg((event_type <> 'error')::int) as ok_rate,
    avg(value) as avg_latency, max(value) as max_latency from events group by 1)""",
    "compare_selectors": """with counts as (
  select count(*) as n_pages, count(*) filter (regexp_matches(html, '<h1>[^<]')) as t, count(*) filter (regexp_matches(html, '<nav><ul><li><a ')) as l,
    count(*) filter (regexp_matches(html, '<div class="ad">[^<]')) as a from pages)
select n_pages, 'title' as field, t as current_hits, t as candidate_hits, 0e0 as hit_rate_change from counts
union all select n_pages, 'links', 0, l, round(l / n_pages, 6) from counts
union all select n_pages, 'ad', a, 0, round(-a / n_pages, 6) from counts""",
    "nearest_products": f"""
select vec_id, label, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = {QUERY_VECTOR})), 6) as score
from embeddings order by list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = {QUERY_VECTOR})) desc, vec_id limit 10""",
    # streaming
    "stream_catalog": f"with {_PRODUCTS} select url, dedup_key, verdict from ({_judged('products')})",
    "stream_rejects": f"with {_RULED} select url, 'price is negative or not a number' as gate_reason from pages_ok where bad_price",
    "stream_unextractable": f"with {_RULED} select url from ruled where name is null",
    "stream_retry": f"with {_RULED} select url, case when ftp then 'invalid' else 'ok' end as verdict from ruled where name is null",
    "stream_health_windows": """
select window_start, n_pages, round(ok_rate, 6) as ok_rate, round(avg_latency, 6) as avg_latency, max_latency, ok_rate < 0.8 as alert from (
  select date_trunc('day', ts) as window_start, count(*) as n_pages, avg((event_type <> 'error')::int) as ok_rate,
    avg(value) as avg_latency, max(value) as max_latency from events group by 1)
where window_start + interval 1 day <= (select max(ts) from events)""",
    "stream_accepted": f"with {_PRODUCTS} select url, name, sku, round(price, 6) as price, availability from ({_judged('products')}) where verdict = 'ok'",
}
