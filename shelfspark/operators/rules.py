"""Attributes from prose by patterns: an offline provider for the response table.

It finds numbers with their units, yes or no words, and whatever words it is given; `learned` takes values from answers instead.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(*vocabulary: str) -> str:
    """Pattern whose first group is the first of these words in the text."""
    return r"(?i)\b(" + "|".join(w.replace(" ", r"\s+") for w in vocabulary) + r")\b"


def unit_count(units: str) -> str:
    """Pattern of a number per unit, such as 12/box."""
    return rf"(?i)\b([0-9]+\s*/\s*(?:{units}))\b"


# attribute -> pattern; the value is the first group in lower case. There is no vocabulary here: users add `words`.
VALUE_RULES = {
    "pack_size": unit_count(r"\p{L}+"),
    "thickness_mil": r"(?i)\b([0-9]+(?:\.[0-9]+)?)[\s-]*mil\b",
}
# attribute -> (pattern for "false", pattern for "true"), tried in this order.
FLAG_RULES = {
    "powder_free": (r"(?i)\bpowdered\b", r"(?i)\bpowder[\s-]+free\b"),
    "sterile": (r"(?i)\bnon[\s-]*sterile\b", r"(?i)\bsterile\b"),
    "absorbable": (r"(?i)\bnon[\s-]*absorbable\b", r"(?i)\babsorbable\b"),
    "latex_free": (r"(?i)\bcontains\s+latex\b", r"(?i)\blatex[\s-]+free\b"),
}


def rule_attributes(text: Column, value_rules: dict = VALUE_RULES, flag_rules: dict = FLAG_RULES) -> Column:
    """map<string,string> of the attributes the rules find in the text."""
    found = [
        F.struct(F.lit(key).alias("key"), F.nullif(F.lower(F.regexp_extract(text, pattern, 1)), F.lit("")).alias("value"))
        for key, pattern in value_rules.items()
    ] + [
        F.struct(F.lit(key).alias("key"), F.when(text.rlike(no), "false").when(text.rlike(yes), "true").alias("value"))
        for key, (no, yes) in flag_rules.items()
    ]
    return F.map_from_entries(F.filter(F.array(*found), lambda e: e["value"].isNotNull()))


def rule_responses(requests: DataFrame, value_rules: dict = VALUE_RULES, flag_rules: dict = FLAG_RULES) -> DataFrame:
    """Answers to enrichment requests, in the shape of the response table."""
    prose = F.concat_ws(" ", "name", "description")
    return requests.filter("kind = 'enrich'").select(
        "request_key", "kind", F.to_json(rule_attributes(prose, value_rules, flag_rules)).alias("body"))
