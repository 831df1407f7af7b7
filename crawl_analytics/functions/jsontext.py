"""JSON text in the spacing the raw files use: ``["a", "b"]`` and ``{"k": "v"}``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _escape_wide(text: Column) -> Column:
    """Non-ASCII characters as \\uXXXX."""
    wide = F.transform(
        F.regexp_extract_all(text, F.lit(r"[\x00-\x7f]+|(?s:.)"), F.lit(0)),
        lambda p: F.when(p.rlike(r"^[\x00-\x7f]+$"), p).otherwise(
            F.regexp_replace(F.lower(F.hex(F.encode(p, "UTF-16BE"))), "([0-9a-f]{4})", r"\\u$1")
        ),
    )
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), text).otherwise(F.array_join(wide, ""))


def json_string(text: Column) -> Column:
    """A quoted JSON string."""
    quoted = F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)
    return _escape_wide(quoted)


def json_list(texts: Column) -> Column:
    """A list of strings; NULL gives ``[]``."""
    body = F.array_join(F.transform(texts, json_string), ", ")
    return F.coalesce(F.concat(F.lit("["), body, F.lit("]")), F.lit("[]"))


def json_map(pairs: Column) -> Column:
    """A map of strings, in the order of its entries; NULL gives ``{}``."""
    body = F.array_join(
        F.transform(
            F.map_entries(pairs),
            lambda e: F.concat(json_string(e["key"]), F.lit(": "), json_string(e["value"])),
        ),
        ", ",
    )
    return F.coalesce(F.concat(F.lit("{"), body, F.lit("}")), F.lit("{}"))


def float_text(number: Column) -> Column:
    """A double as plain decimal text: all of its digits, at least one decimal."""
    plain = number.cast("string").try_cast("decimal(38,18)").cast("string")
    return F.coalesce(F.regexp_replace(plain, r"(\.\d+?)0*$", "$1"), number.cast("string"))


def number_text(text: Column) -> Column:
    """Text that is a plain number in the form ``float_text`` gives it; other text as it is."""
    return F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), float_text(text.try_cast("double"))).otherwise(text)


def map_text(text: Column) -> Column:
    """A JSON object of strings, given as text, in the raw files' spacing; other text as it is, NULL as ``{}``."""
    pairs = F.from_json(text, "map<string,string>")
    return F.coalesce(F.when(pairs.isNotNull(), json_map(pairs)), text, F.lit("{}"))
