"""Decoders from listing text to typed spec values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom.functions.text import WHITESPACE, blank_to_null

# Number pattern, word for a drive without a spindle, unit of a
# capacity that is not scaled, and the rating of a supply that names none.
NUMBER = r"\d+\.?\d*|\.\d*"
SOLID_STATE = "SSD"
GIGABYTE = "GB"
PLAIN_RATING = "plus"

# A digit, or dots enough to make a list.
_HAS_NUMBERS = r"(?s)\d|\..*\."
_LEADING_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def numbers(c: Column) -> Column:
    """All unsigned decimals in a text as ``array<double>``, null when none.

    A lone dot takes a place in a list but has no value.
    """
    found = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)).try_cast("array<double>")
    return F.when(c.rlike(_HAS_NUMBERS), found)


def token(c: Column) -> Column:
    """``none`` is null, ``yes`` and ``no`` are true and false, the rest stays."""
    lowered = F.lower(c)
    return (
        F.when(lowered == "none", F.lit(None).cast("string"))
        .when(lowered == "yes", F.lit("true"))
        .when(lowered == "no", F.lit("false"))
        .otherwise(c)
    )


def flag(c: Column) -> Column:
    """Yes and no in any case as true and false; null when it is neither."""
    lowered = F.lower(c)
    return F.when(lowered == "yes", True).when(lowered == "no", False)


def text_list(c: Column) -> Column:
    return F.split(c, ", ")


def capacity_gb(c: Column, scale_megabytes: bool = False) -> Column:
    """Capacity in GB from ``<number> <unit>``.

    Every unit but GB counts as a thousand GB; ``scale_megabytes`` reads MB as
    a thousandth instead.
    """
    words = F.split(c, " ")
    amount, unit = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    value = F.regexp_extract(F.btrim(amount, F.lit(WHITESPACE)), _LEADING_NUMBER, 0).try_cast(
        "double"
    )
    gigabytes = F.when(unit == GIGABYTE, value)
    if scale_megabytes:
        gigabytes = gigabytes.when(unit == "MB", value / 1000)
    return gigabytes.when((amount != "") & (unit != ""), value * 1000)


def drive_type_text(c: Column) -> Column:
    return F.when(c == SOLID_STATE, c)


def drive_type_numbers(c: Column) -> Column:
    return F.when(c != SOLID_STATE, numbers(c))


def drive_form_text(c: Column) -> Column:
    return F.when(~c.contains('"'), c)


def drive_form_numbers(c: Column) -> Column:
    return F.when(c.contains('"'), numbers(c))


def efficiency(c: Column) -> Column:
    """Second word of the rating in lower case, ``plus`` when there is none."""
    second = F.lower(F.get(F.split(c, " "), F.lit(1)))
    return F.when(c.isNotNull(), F.coalesce(second, F.lit(PLAIN_RATING)))


def price(c: Column, drop_thousands_commas: bool = False) -> Column:
    """Numbers of a price text; blank is null.

    ``$1,234.56`` reads as two numbers unless the commas are dropped first.
    """
    text = blank_to_null(c)
    if drop_thousands_commas:
        text = F.regexp_replace(text, r",(?=\d{3})", "")
    return numbers(text)


def first_number(values: Column) -> Column:
    """First of a number or pair: lower bound, count, version or width."""
    return F.get(values, F.lit(0))


def last_number(values: Column) -> Column:
    """Last of a number or pair: upper bound, size, speed or height."""
    return F.when(F.size(values) > 0, F.element_at(values, -1))


def is_pair(values: Column) -> Column:
    return F.size(values) == 2


def plain_number(value: Column) -> Column:
    """A double as a text that reads back to the same double: ``87``, ``9.99``, ``1e+30``.

    Decimal notation from a millionth up to below 1e21, an exponent elsewhere. What
    is no finite number is null.
    """
    text, size = value.cast("string"), F.abs(value)
    # The text has at most 17 digits, so either decimal type holds it without loss.
    digits = F.when(size < 1, text.try_cast("decimal(38,30)").cast("string")).otherwise(
        text.try_cast("decimal(38,16)").cast("string")
    )
    plain = F.regexp_replace(digits, r"\.?0+$", "")
    exponent = F.regexp_replace(F.regexp_replace(text, r"(?:\.0)?E-", "e-"), r"(?:\.0)?E", "e+")
    return (
        F.when(value == 0, "0")
        .when((size >= 1e-6) & (size < 1e21), plain)
        .when(size < float("inf"), exponent)
    )
