"""Table schemas shared by sources, operators and sinks."""

from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())

PAGES = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("duration_ms", T.LongType()),
])

CATEGORIES = T.StructType([
    T.StructField("cat_idx", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("slug", T.StringType()),
    T.StructField("url", T.StringType(), False),
])

SEQ = T.StructType([
    T.StructField("cat_idx", T.IntegerType()),
    T.StructField("page_num", T.LongType()),
    T.StructField("pos", T.IntegerType()),
])

PRODUCTS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("category_path", _STRINGS),
    T.StructField("brand", T.StringType()),
    T.StructField("sku", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("pack_size", T.StringType()),
    T.StructField("availability", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("specifications", T.MapType(T.StringType(), T.StringType())),
    T.StructField("image_urls", _STRINGS),
    T.StructField("alternative_skus", _STRINGS),
    T.StructField("extracted_at", T.TimestampType()),
    T.StructField("extraction_method", T.StringType()),
    T.StructField("extraction_confidence", T.DoubleType()),
    T.StructField("fields_via_llm", _STRINGS),
])

# Scalars as text: what a line of the JSON-lines file says, before any typing.
PRODUCTS_AS_TEXT = T.StructType([
    T.StructField(f.name, f.dataType if isinstance(f.dataType, (T.ArrayType, T.MapType)) else T.StringType())
    for f in PRODUCTS.fields
])

RESPONSES = T.StructType([
    T.StructField("request_key", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("body", T.StringType()),
])

SEEN = T.StructType([T.StructField("url", T.StringType())])

REPAIR = T.StructType([
    T.StructField("field", T.StringType()),
    T.StructField("failures", T.LongType()),
    T.StructField("suggested", _STRINGS),
])
