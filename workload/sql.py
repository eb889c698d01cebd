"""Pieces of check SQL."""

from __future__ import annotations

from workload import binding as b

STOCK = (
    "SELECT l_partkey AS produs_id, l_suppkey AS depozit_id, "
    "CAST(sum(l_quantity) AS BIGINT) AS cantitate, "
    "CAST(5 * max(l_linenumber) AS BIGINT) AS prag_minim FROM lineitem {where} GROUP BY ALL"
)
WAREHOUSE = (
    "SELECT s_suppkey AS depozit_id, s_name AS nume, n_name AS oras, r_name AS tara "
    "FROM supplier JOIN nation ON s_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey"
)
NO_TEXT = "CAST(NULL AS STRING)"
GROUPS = {"socket": "SOCKET_CPU", "memory_type": "MEM_TYPE", "form_factor": "FORM_FACTOR_MB"}


def links(codes: dict[str, str] = b.CODES, tokens: str = "lower(cod) NOT IN ('', 'nan', 'none')"):
    """Distinct (produs_id, grup, cod) of the parts."""
    parts = " UNION ALL ".join(
        f"SELECT p_partkey AS produs_id, '{GROUPS[name]}' AS grup, trim({text}) AS cod FROM part"
        for name, text in codes.items()
    )
    return f"SELECT DISTINCT * FROM ({parts}) WHERE cod IS NOT NULL AND {tokens}"


def codes(codes: dict[str, str] = b.CODES) -> str:
    """Distinct (grup, cod) of the parts."""
    return f"SELECT DISTINCT grup, cod FROM ({links(codes, "cod NOT IN ('', 'nan', 'None')")})"


def numbered(
    rows: str, keys: list[str], id_column: str, offset: str = "0", digits: int = 3
) -> str:
    """Rows with the id that the bucketed numbering gives their natural key."""
    text = " || chr(31) || ".join(f"coalesce({k}, '')" for k in keys)
    bucket = f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"
    order = ", ".join(f"{k} NULLS FIRST" for k in keys)
    return (
        f"SELECT *, (row_number() OVER (PARTITION BY {bucket} ORDER BY {order}) - 1) * {16**digits} "
        f"+ {bucket} + 1 + {offset} AS {id_column} FROM ({rows})"
    )


CATEGORY = numbered("SELECT DISTINCT p_type AS nume FROM part", ["nume"], "categorie_id")
MANUFACTURER = numbered("SELECT DISTINCT p_brand AS nume FROM part", ["nume"], "producator_id")
STANDARD = numbered(codes(), ["grup", "cod"], "standard_id")
