"""Scalar expressions. All are built-in Catalyst expressions, none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of truth that a cast from text accepts.
TRUE, FALSE = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")


def int_div(a: str, b: str) -> Column:
    """Truncating division of two SQL expressions over integers; division by zero is an error in ANSI mode."""
    return F.expr(f"({a}) div ({b})")


def cast_bool(c: Column) -> Column:
    """Text to boolean by TRUE and FALSE after trimming, any case; other text is an error."""
    word = F.lower(F.trim(c))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False).when(c.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), c)))


def cast_int(c: Column, kind: str = "string") -> Column:
    """To a 64-bit integer: text is trimmed, fractions are cut off, booleans are 0 and 1."""
    if kind == "string":
        return F.trim(c).cast("long")
    return c.cast("long")


def cast_text(c: Column, kind: str = "string") -> Column:
    """To text."""
    return c.cast("string")


def like(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """LIKE with % and _ alone: no escape character, a backslash is itself."""
    escape = next(x for x in "\x01\x02\x03" if x not in pattern)
    made = F.lit(pattern)
    return F.ilike(c, made, F.lit(escape)) if ignore_case else F.like(c, made, F.lit(escape))


def json_get(c: Column, key: str) -> Column:
    """`c -> key`: JSON text of the member; a missing key is the JSON text null, a null column is null."""
    v = F.try_parse_json(c)
    found = F.to_json(F.try_variant_get(v, _path(key), "variant"))
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(found, F.lit("null")))


def json_get_text(c: Column, key: str) -> Column:
    """`c ->> key`: the member as text, strings without quotes; a missing key is null, a JSON null the text null."""
    v = F.try_parse_json(c)
    member = F.try_variant_get(v, _path(key), "variant")
    text = F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(v, _path(key), "string")).otherwise(F.to_json(member))
    return F.when(member.isNotNull() & F.is_variant_null(member), F.lit("null")).otherwise(text)


def _path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def two_valued(comparison: Column) -> Column:
    """A comparison that is false, not unknown, where an operand is null."""
    return F.coalesce(comparison, F.lit(False))


def exact_decimal(c: Column, precision: int, scale: int) -> Column:
    """To DECIMAL(precision, scale); fraction digits beyond scale are an error, never rounded."""
    text = c.cast("string")
    digits = F.length(F.rtrim(F.regexp_extract(text, r"\.(\d+)", 1), F.lit("0")))
    tiny = F.regexp_extract(text, r"[eE]-(\d+)$", 1)  # a number below 0.001 in scientific form
    digits = digits + F.when(tiny == "", 0).otherwise(tiny.cast("int"))
    fits = F.when(F.regexp_like(text, F.lit(r"^\s*[-+]?0*\.?0*([eE][-+]?\d+)?\s*$")), True).otherwise(digits <= scale)
    return F.when(fits, c.cast(f"decimal({precision},{scale})")).when(c.isNotNull(), F.raise_error(F.concat(F.lit("excess fraction digits: "), text)))
