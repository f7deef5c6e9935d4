"""Rules on product columns: keys, gaps, schema gate, provenance."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import METHODS


def compute_once(df: DataFrame, columns: list[Column], keep=()) -> DataFrame:
    """`keep` plus `columns`, each column evaluated once per row.

    A plain select lets later filters and projections copy these expressions into themselves, several
    times over; rows that come out of a generator are not taken apart again.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def not_in(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in `known`: one anti join, in which each side is shuffled once at most."""
    return rows.join(known.select(key), key, "left_anti")


def _has_text(col: Column) -> Column:
    return F.coalesce(col != "", F.lit(False))


def dedup_key(sku: Column, url: Column) -> Column:
    """SKU if there is one, else URL; both share one key space."""
    return F.coalesce(F.nullif(sku, F.lit("")), url)


def is_complete(name: Column, url: Column) -> Column:
    return _has_text(name) & _has_text(url)


def valid_price(price: Column) -> Column:
    """Null or a number that is not negative; NaN fails (NaN >= 0 is true in Spark)."""
    return price.isNull() | (~F.isnan(price) & (price >= 0))


def missing_critical(sku: Column, brand: Column, description: Column, price: Column) -> Column:
    """Names of empty critical fields, in fixed order; price 0 counts as empty."""
    no_price = F.coalesce(price == 0, F.lit(True))
    return F.array_compact(F.array(
        F.when(~_has_text(sku), "sku"),
        F.when(~_has_text(brand), "brand"),
        F.when(~_has_text(description), "description"),
        F.when(no_price, "price"),
    ))


def confidence(method: Column) -> Column:
    return F.when(method == "selector", 1.0).when(method == "hybrid", 0.8).otherwise(0.6)


def gate_reason(df: DataFrame) -> Column:
    """Why a product row breaks the schema; null for a good row."""
    score = df["extraction_confidence"]
    return (
        F.when(~_has_text(df["name"]), "name is empty")
        .when(df["url"].isNull(), "url is missing")
        .when(~valid_price(df["price"]), "price is negative or not a number")
        .when(~F.coalesce(~F.isnan(score) & score.between(0.0, 1.0), F.lit(False)), "confidence outside 0..1")
        .when(~F.coalesce(df["extraction_method"].isin(*METHODS), F.lit(False)), "unknown method")
    )


def schema_gate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy the product schema, rejected rows with `gate_reason`)."""
    judged = df.withColumn("gate_reason", gate_reason(df))
    return judged.filter("gate_reason is null").drop("gate_reason"), judged.filter("gate_reason is not null")
