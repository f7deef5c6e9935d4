"""Text and number functions on Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import TRUNCATION_MARK

# Every character that Python's str.isspace() accepts; Java's \s is ASCII only.
SPACE_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
SPACE = "[" + "".join(f"\\u{ord(c):04X}" for c in SPACE_CHARS) + "]"
_TOKEN = "([^" + SPACE[1:] + "+)"

_CSS_RUN = rf"#html-body{SPACE}*\[[^\]]*\]{SPACE}*\{{[^}}]*\}}"
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_FLOAT = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_INFINITE = r"(?i)^[+-]?inf(?:inity)?$"


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(col: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode included."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def strip_blank(col: Column) -> Column:
    """Strip; blank becomes null."""
    return F.nullif(strip(col), F.lit(""))


def parse_price(col: Column) -> Column:
    """First number of a price text such as '$1,299.00 - $1,499' or '12.99 USD'; null if there is none."""
    bare = col
    for mark in ("$", ",", "USD"):
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    infinity = F.lit(float("inf"))

    def number(token):
        return (
            F.when(token.rlike(_FLOAT), F.replace(token, F.lit("_"), F.lit("")).try_cast("double"))
            .when(token.rlike(_INFINITE), F.when(token.startswith("-"), -infinity).otherwise(infinity))
            .when(token.rlike(r"(?i)^[+-]?nan$"), F.lit(float("nan")))
        )

    return let(F.regexp_extract(bare, _TOKEN, 1), number)


def clean_description(col: Column) -> Column:
    """Drop style runs and one leading label, collapse whitespace; blank becomes null."""
    text = F.regexp_replace(col, _CSS_RUN, " ")
    text = F.regexp_replace(text, rf"^Description{SPACE}*", "")
    return F.nullif(F.trim(F.regexp_replace(text, rf"{SPACE}+", " ")), F.lit(""))


def truncate_text(col: Column, n: int | None = None) -> Column:
    """Keep the first n characters of a long text and mark the cut; None keeps all."""
    if n is None:
        return col
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(TRUNCATION_MARK))).otherwise(col)


def json_text(col: Column) -> Column:
    """One string as a JSON literal."""
    wrapped = F.to_json(F.array(col))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def json_list(col: Column) -> Column:
    """array<string> as JSON with a blank after each comma."""
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(col, json_text)), F.lit("]"))


def json_map(col: Column) -> Column:
    """map<string,string> as JSON with a blank after each comma and colon, entries in map order."""
    pairs = F.transform(F.map_entries(col), lambda e: F.concat(json_text(e["key"]), F.lit(": "), json_text(e["value"])))
    return F.concat(F.lit("{"), F.concat_ws(", ", pairs), F.lit("}"))
