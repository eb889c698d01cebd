"""Find the catalogue columns in a file whose layout is not known beforehand.

Resolution reads the column names only, so it happens while the plan is built;
the rows are projected by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions import text
from partloom.schemas import RESOLVED_COLUMNS, WIDE_COLUMNS

# Column names that hold each catalogue column, in lower case.
NAME_COLUMNS = ("name", "product_name", "model", "title")
BRAND_COLUMNS = ("brand", "manufacturer", "maker")
SKU_COLUMNS = ("id", "sku", "part_number", "partnumber", "pn")
CATEGORY_COLUMNS = ("category", "categorie", "type")
# Exact names for the memory type, by priority.
MEMORY_COLUMNS = ("memory_type", "memorytype", "ram_type", "memory")
# Name fragments, any of which marks the column.
INTERFACE_FRAGMENTS = ("interface", "bus")
STORAGE_FRAGMENTS = ("m.2", "form_factor_storage", "storage_form")
UNKNOWN_CATEGORY = "Unknown"

# Columns every wide row gets.
WIDE_DEFAULTS = {
    "garantie_luni": 24,
    "status": "ACTIV",
    "depozit": "Central",
    "oras_depozit": "Bucuresti",
    "tara_depozit": "RO",
    "cantitate": 10,
    "prag_minim": 2,
}


def _position(header: Sequence[str], accepts: Callable[[str], bool]) -> int | None:
    hits = (i for i, name in enumerate(header) if accepts(name.lower()))
    return next(hits, None)


def resolve_header(header: Sequence[str]) -> dict[str, int | None]:
    """Position in ``header`` of each catalogue column, None where it has none."""
    exact = list(header)
    memory = next((exact.index(name) for name in MEMORY_COLUMNS if name in exact), None)
    return {
        "denumire": _position(header, lambda n: n in NAME_COLUMNS),
        "producator": _position(header, lambda n: n in BRAND_COLUMNS),
        "cod_sku": _position(header, lambda n: n in SKU_COLUMNS),
        "categorie": _position(header, lambda n: n in CATEGORY_COLUMNS),
        "socket": _position(header, lambda n: "socket" in n),
        "memory_type": memory,
        "form_factor": _position(header, lambda n: "form" in n and "factor" in n),
        "interface": _position(header, lambda n: any(f in n for f in INTERFACE_FRAGMENTS)),
        "storage_form": _position(header, lambda n: any(f in n for f in STORAGE_FRAGMENTS)),
    }


def resolve_columns(
    df: DataFrame,
    category_hint: str | None = None,
    header: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Project any product file onto the nine catalogue columns.

    ``header`` gives the names of the leading columns where they differ from
    those of ``df`` (a file read by position); ``keep`` names further columns
    to carry along.
    """
    header = list(header if header is not None else [c for c in df.columns if c not in keep])
    found = resolve_header(header)
    # Read by position: names may repeat, differ only in case, or hold dots.
    plain = df.toDF(*[f"_c{i}" for i in range(len(header))], *df.columns[len(header) :])

    def column(target: str) -> Column:
        i = found[target]
        if i is None:
            return F.lit(None).cast("string")
        return F.col(f"_c{i}").cast("string")

    name = column("denumire") if found["denumire"] is not None else F.col("_c0").cast("string")
    brand = column("producator") if found["producator"] is not None else F.lit("")
    sku = column("cod_sku") if found["cod_sku"] is not None else text.derive_sku(brand, name)
    category = (
        column("categorie")
        if found["categorie"] is not None
        else F.lit(category_hint or UNKNOWN_CATEGORY)
    )
    chosen = {"cod_sku": sku, "denumire": name, "categorie": category, "producator": brand}
    return plain.select(
        *[chosen.get(c, column(c)).alias(c) for c in RESOLVED_COLUMNS],
        *[F.col(c) for c in keep],
    )


def clean_resolved(df: DataFrame) -> DataFrame:
    """Strip the catalogue columns and null their null tokens."""
    return df.withColumns({c: text.clean_text(F.col(c)) for c in RESOLVED_COLUMNS})


def add_wide_defaults(df: DataFrame) -> DataFrame:
    """Constant columns, and one spelling per socket."""
    constants = {name: F.lit(value) for name, value in WIDE_DEFAULTS.items()}
    return df.withColumns({**constants, "socket": text.normalize_socket(F.col("socket"))})


def conform(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``columns`` in this order, null where ``df`` lacks one."""
    have = set(df.columns)
    return df.select(
        *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns],
        *[F.col(c) for c in keep],
    )


def wide_order(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return conform(df, WIDE_COLUMNS, keep)
