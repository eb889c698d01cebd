"""Small column helpers that the native operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that parts words: [\x20\x09-\x0D].
WORD = r"[^\x20\x09-\x0D]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body uses it.

    A lambda evaluates the expressions inside it for every element; a value that is
    bound outside is a variable there and is not computed again.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def rest(values: Column, by: int) -> Column:
    """An array without its first ``by`` elements."""
    return F.slice(values, F.lit(by + 1), F.greatest(F.size(values) - by, F.lit(0)))


def neighbours(values: Column, by: int, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of each element and the one ``by`` places on, where there is one."""
    return bind(
        values,
        lambda v: F.zip_with(
            F.slice(v, F.lit(1), F.greatest(F.size(v) - by, F.lit(0))), rest(v, by), join
        ),
    )


def window_hashes(hashes: Column, width: int) -> Column:
    """A hash of each run of ``width`` hashes; ``width`` is a power of two."""
    step = 1
    while step < width:
        hashes = neighbours(hashes, step, lambda a, b: F.xxhash64(a, b))
        step *= 2
    return hashes


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """Names for added columns: the given ones, lengthened until no column is called so."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
