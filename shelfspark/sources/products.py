"""Product sinks and sources: JSON lines and flat CSV."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CSV_COLUMNS
from ..functions.products import gate_reason, schema_gate
from ..functions.text import json_list, json_map, parse_price, strip_blank
from ..schemas import PRODUCTS, PRODUCTS_AS_TEXT
from .packing import exists, read_packed

_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"     # always written in UTC


def write_jsonl(products: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object per line in schema order; nulls are kept, an infinite price becomes null."""
    finite = F.when(~F.col("price").isin(float("inf")), F.col("price"))
    (
        products.withColumn("price", finite).select(*PRODUCTS.fieldNames())
        .write.mode(mode).option("ignoreNullFields", False)
        .option("timeZone", "UTC").option("timestampFormat", _TIME_FORMAT).json(path)
    )


def read_products(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Products from JSON lines; a missing path gives no rows, blank lines are skipped.

    strict: any bad line fails the job, and rows have to satisfy the product schema again.
    lenient: lines that do not parse are skipped, scalars are kept as the text they had in the file.
    """
    schema = PRODUCTS if strict else PRODUCTS_AS_TEXT
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if not strict:
        return read_packed(spark, path, schema, "json", mode="DROPMALFORMED")
    # Price is read as text, since a product line may hold a number or a price text.
    typed = T.StructType([T.StructField("price", T.StringType()) if f.name == "price" else f for f in schema.fields])
    rows = read_packed(spark, path, typed, "json", mode="FAILFAST")
    return revalidate(rows.withColumn("price", parse_price(F.col("price"))))


def revalidate(rows: DataFrame) -> DataFrame:
    """Defaults for absent fields, then the schema gate as a check: the first bad row fails the job."""
    strings, entries = "array<string>", "map<string,string>"
    filled = rows.withColumns({
        "name": strip_blank(F.col("name")),
        "description": strip_blank(F.col("description")),
        "category_path": F.coalesce("category_path", F.array().cast(strings)),
        "currency": F.coalesce("currency", F.lit("USD")),
        "specifications": F.coalesce("specifications", F.create_map().cast(entries)),
        "image_urls": F.coalesce("image_urls", F.array().cast(strings)),
        "alternative_skus": F.coalesce("alternative_skus", F.array().cast(strings)),
        "extraction_method": F.coalesce("extraction_method", F.lit("selector")),
        "extraction_confidence": F.coalesce("extraction_confidence", F.lit(1.0)),
        "fields_via_llm": F.coalesce("fields_via_llm", F.array().cast(strings)),
    })
    reason = gate_reason(filled)
    passes = F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(reason).cast("boolean"))
    return filled.filter(passes).select(*PRODUCTS.fieldNames())


def invalid_products(products: DataFrame) -> DataFrame:
    """Stored rows that break the product schema, with `gate_reason`."""
    return schema_gate(products)[1]


def flatten_for_csv(products: DataFrame) -> DataFrame:
    """The fixed CSV columns as text: null is empty, lists and maps are JSON, all else as it is."""

    def flat(name):
        kind = products.schema[name].dataType
        if isinstance(kind, T.ArrayType):
            text = json_list(F.col(name))
        elif isinstance(kind, T.MapType):
            text = json_map(F.col(name))
        elif isinstance(kind, T.TimestampType):
            text = F.date_format(F.to_utc_timestamp(name, F.current_timezone()), _TIME_FORMAT)
        else:
            text = F.col(name).cast("string")
        return F.coalesce(F.when(F.col(name).isNotNull(), text), F.lit("")).alias(name)

    return products.select(*[flat(name) for name in CSV_COLUMNS])


def export_csv(spark: SparkSession, jsonl_path: str, csv_path: str) -> int:
    """JSON lines -> CSV with header, overwriting. Returns the row count; 0 and no output without a source.

    Rows are counted while they are written; nothing is read twice and nothing is shuffled. Lines end in
    LF: with CRLF the writer would also turn each line break inside a value into CRLF.
    """
    if not exists(spark, jsonl_path):
        return 0
    written = Observation("csv_rows")
    (
        flatten_for_csv(read_products(spark, jsonl_path, strict=False))
        .observe(written, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "")
        .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(csv_path)
    )
    return written.get["rows"]
