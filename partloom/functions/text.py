"""Cleaning rules for catalogue text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 "
    "           "
    "    　"
)
# Texts that stand for "no value".
NULL_TOKENS = ("nan", "None", "")
# Words without meaning inside a socket name.
SOCKET_FILLERS = ("SOCKET", "CPU", "PROCESSOR")
# Status domain, default status and default warranty in months.
STATUSES = ("ACTIV", "INACTIV")
DEFAULT_STATUS = "ACTIV"
DEFAULT_WARRANTY = 24

_WHITESPACE_RUN = "[" + WHITESPACE + "]+"
# Python reads a decimal literal here; Java's parser alone would take "36d" too. No part
# gives back what it has matched, so a long run of digits is read once.
_DECIMAL = r"^[+-]?(\d++(\.\d*+)?|\.\d++)([eE][+-]?\d++)?$"


def strip(c: Column) -> Column:
    """Drop leading and trailing whitespace of any kind, not just spaces."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    stripped = strip(c)
    return F.when(stripped != "", stripped)


def clean_text(c: Column) -> Column:
    """Strip, and turn the null tokens into null."""
    stripped = strip(c.cast("string"))
    return F.when(~stripped.isin(*NULL_TOKENS), stripped)


def null_to_blank(c: Column) -> Column:
    """Strip, and turn null into the empty text."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def is_standard_code(c: Column) -> Column:
    """Whether a text names a standard: the null tokens count as written."""
    return F.coalesce(~strip(c).isin(*NULL_TOKENS), F.lit(False))


def is_link_code(c: Column) -> Column:
    """Whether a text links a product to a standard: null tokens in any case."""
    tokens = [t.lower() for t in NULL_TOKENS]
    return F.coalesce(~F.lower(strip(c)).isin(*tokens), F.lit(False))


def hyphenate(c: Column) -> Column:
    """Each run of whitespace becomes one hyphen."""
    return F.regexp_replace(c, _WHITESPACE_RUN, "-")


def newline_to_space(c: Column) -> Column:
    return F.translate(c, "\n", " ")


def derive_sku(brand: Column, name: Column) -> Column:
    """SKU made from six letters of the brand and twenty of the name.

    A null part is spelled ``nan``, as the text form of a missing value.
    """
    brand_text = F.coalesce(brand.cast("string"), F.lit("nan"))
    name_text = F.coalesce(name.cast("string"), F.lit("nan"))
    return F.concat(
        F.upper(F.substring(brand_text, 1, 6)),
        F.lit("-"),
        F.upper(F.substring(hyphenate(name_text), 1, 20)),
    )


def _without_brackets(c: Column) -> Column:
    """A bracket and all up to the next closing one on its line become one blank."""

    def line(part: Column) -> Column:
        pieces = F.split(part, r"\)")
        closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        kept = F.transform(closed, lambda piece: F.substring_index(piece, "(", 1))
        return F.concat_ws(" ", kept, F.element_at(pieces, -1))

    lines = F.concat_ws("\n", F.transform(F.split(c, "\n"), line))
    return F.when(c.contains(")"), lines).otherwise(c)


def normalize_socket(c: Column) -> Column:
    """One spelling per CPU socket: AM5, LGA<n>, AM<n>, else the cleaned text.

    Brackets, filler words and all that is no letter or digit part the words that stay.
    They go one kind after the other, each by a split or a literal search: a single
    pattern with all of them under a repetition nests as deep as the text is long.
    """
    words = _without_brackets(F.upper(strip(c)))
    for filler in SOCKET_FILLERS:
        words = F.replace(words, F.lit(filler), F.lit(" "))
    words = F.trim(F.regexp_replace(words, "[^A-Z0-9]+", " "))
    named = F.regexp_replace(words, r"^.*AM5.*$", "AM5")
    named = F.regexp_replace(named, r"^.*?\bLGA ?([0-9]{3,5})\b.*$", "LGA$1")
    named = F.regexp_replace(named, r"^.*?\bAM([2-5])\b.*$", "AM$1")
    return F.nullif(named, F.lit(""))


def to_number(c: Column) -> Column:
    """The double a text spells, null when it spells none."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(_DECIMAL), text.try_cast("double"))


def warranty_months(c: Column) -> Column:
    """Whole months, cut not rounded; bad, missing and too large values take the default."""
    return F.coalesce(to_number(c).try_cast("int"), F.lit(DEFAULT_WARRANTY))


def status_or_default(c: Column, ignore_case: bool = False) -> Column:
    """The status when it is in the domain, else the default.

    The test reads the value as written, so ``inactiv`` becomes ``ACTIV``;
    ``ignore_case`` accepts any spelling instead.
    """
    text = strip(c)
    if ignore_case:
        text = F.upper(text)
    return F.when(text.isin(*STATUSES), text).otherwise(F.lit(DEFAULT_STATUS))
