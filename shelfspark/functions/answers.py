"""Answers of a model or a person: one per request, read by one rule."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_answer(responses: DataFrame) -> DataFrame:
    """One answer per kind and request: the latest by `answered_at` where that column exists, then the greatest body text."""
    order = F.struct("answered_at", "body") if "answered_at" in responses.columns else F.struct("body")
    best = responses.groupBy("kind", "request_key").agg(F.max(order).alias("_best"))
    return best.select("request_key", "kind", F.col("_best.body").alias("body"))


def json_members(body: Column, names) -> Column:
    """The named members of a JSON object as one variant object; null for any other text. Of a repeated key the last value counts."""
    schema = ", ".join(f"`{n}` variant" for n in names)
    return F.when(F.json_object_keys(body).isNotNull(), F.to_variant_object(F.from_json(body, schema)))


def json_texts(body: Column, names) -> Column:
    """The named members of a JSON object as map<string,string>, in the order of the text; null values and other texts give no entry."""
    parsed = F.from_json(body, ", ".join(f"`{n}` string" for n in names))
    keys = F.array_intersect(F.array_distinct(F.json_object_keys(body)), F.array(*[F.lit(n) for n in names]))
    # Arrays of one, so that the text is parsed once and not for each name and key.
    values = F.transform(F.array(parsed), lambda p: F.create_map(*[x for n in names for x in (F.lit(n), p[n])]))
    entries = lambda v: F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(v, k).alias("value")))
    found = F.get(F.transform(values, lambda v: F.map_from_entries(F.filter(entries(v), lambda e: e["value"].isNotNull()))), 0)
    return F.coalesce(found, F.create_map().cast("map<string,string>"))
