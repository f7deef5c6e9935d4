"""Fixed values of the catalog contract: selectors, URL patterns, column lists, limits."""

# --- fixed values: listing page selectors -----------------------------------
LISTING_SELECTORS = {
    "product_link": "a.result, link[itemprop='url']",
    "next_page": ".ais-Pagination-item--nextPage a, a.ais-Pagination-link[aria-label*='Next']",
}

# --- fixed values: detail page selectors ------------------------------------
DETAIL_SELECTORS = {
    "name": "h1.page-title span, h1[itemprop='name'], h1",
    "brand": ".pdp-brand-review a span, [href*='shop-by-manufacturer'] span, .manufacturer-name",
    "sku": "form[data-sku]",
    "price": ".price-box .price, .price",
    "description": "#description, [itemprop='description'], .product-info-main .description",
    "pack_size": ".product-info-pack-size, [data-attribute='pack-size']",
    "availability": "[itemprop='availability'], .stock.available, .stock.unavailable",
    "images": "[itemprop='image'], .product.media img, .gallery img",
    "specifications_rows": ".product.attributes tr, .additional-attributes tr",
    "breadcrumbs": ".breadcrumbs li",
}

# --- fixed values: page type signals ----------------------------------------
LISTING_SIGNAL = ".product-items, .products.list"
DETAIL_SIGNAL = "[itemprop='sku'], [itemprop='price']"
DETAIL_TITLE = "h1.page-title, h1.product-title, h1[itemprop='name']"
LISTING_CARDS = ".product-item, [itemtype*='Product']"
PAGE_TYPES = ("category_listing", "product_detail", "other")

# --- fixed values: product URL patterns -------------------------------------
URL_DENY = (
    "/customer/", "/cart", "/checkout", "/search", "/contact",
    "/account", "/login", "javascript:", "#",
    "/shop-by-manufacturer/", "/catalog",
)
URL_ALLOW_CONTAINS = "/product/"
URL_ALLOW_SUFFIX = ".html"

# --- fixed values: enrichment attributes, critical fields, methods ----------
ENRICHMENT_ATTRIBUTES = (
    "material", "color", "powder_free", "size", "pack_size",
    "sterile", "absorbable", "form", "texture", "intended_use",
    "latex_free", "thickness_mil",
)
CRITICAL_FIELDS = ("sku", "brand", "description", "price")
METHODS = ("selector", "llm_fallback", "hybrid")

# --- fixed values: CSV column order -----------------------------------------
CSV_COLUMNS = (
    "name", "brand", "sku", "price", "currency", "pack_size",
    "availability", "category_path", "url", "description",
    "image_urls", "specifications", "extraction_method",
    "extraction_confidence", "fields_via_llm", "extracted_at",
)

# --- fixed values: verdict reasons ------------------------------------------
REASON_INCOMPLETE = "incomplete: missing name or url"
REASON_DUPLICATE = "duplicate: "
REASON_INVALID = "invalid url scheme"

# --- fixed values: limits ---------------------------------------------------
MAX_IMAGES = 10             # not applied unless asked for, like the two below
TRUNCATION_MARK = "\n<!-- truncated -->"
REPAIR_THRESHOLD = 5
MAX_SUGGESTIONS = 3
CURRENCY = "USD"
