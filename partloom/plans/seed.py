"""A minimal catalogue from literal rows, loaded by names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partloom.operators import merge
from partloom.operators.keys import assign_ids

# The sample catalogue.
MANUFACTURERS = (
    ("AMD", "US"),
    ("Intel", "US"),
    ("ASUS", "TW"),
    ("MSI", "TW"),
    ("Kingston", "US"),
    ("Samsung", "KR"),
    ("Gigabyte", "TW"),
)
CATEGORIES = ("CPU", "Motherboard", "RAM", "Storage", "GPU", "Case")
STANDARDS = (
    ("SOCKET_CPU", "AM5", "AMD AM5 socket"),
    ("SOCKET_CPU", "LGA1700", "Intel LGA1700 socket"),
    ("MEM_TYPE", "DDR5", "DDR5 memory"),
    ("MEM_TYPE", "DDR4", "DDR4 memory"),
    ("FORM_FACTOR_MB", "ATX", "ATX motherboard"),
    ("FORM_FACTOR_MB", "mATX", "Micro-ATX motherboard"),
    ("STORAGE_FORM", "M.2 2280", "M.2 2280 NVMe/SATA"),
    ("STORAGE_FORM", '2.5"', "2.5-inch SATA"),
    ("INTERFATA", "PCIe x16", "PCI Express x16 slot"),
)
PRODUCTS = (
    ("AMD-R5-7600", "Ryzen 5 7600", "CPU", "AMD", 36),
    ("INTEL-i5-12400", "Core i5-12400", "CPU", "Intel", 36),
    ("ASUS-B650-PLUS", "ASUS TUF GAMING B650-PLUS", "Motherboard", "ASUS", 36),
    ("MSI-B660M-MORTAR", "MSI MAG B660M MORTAR", "Motherboard", "MSI", 36),
    ("KINGSTON-D5-16", "Kingston Fury 16GB DDR5 (2x8)", "RAM", "Kingston", 36),
    ("KINGSTON-D4-16", "Kingston HyperX 16GB DDR4 (2x8)", "RAM", "Kingston", 36),
    ("SAMSUNG-980-1TB", "Samsung 980 1TB M.2 NVMe", "Storage", "Samsung", 36),
    ("SAMSUNG-870-1TB", 'Samsung 870 EVO 1TB 2.5"', "Storage", "Samsung", 36),
    ("GIGABYTE-RTX4060", "Gigabyte RTX 4060", "GPU", "Gigabyte", 36),
    ("ASUS-CASE-ATX", "ASUS Prime Case ATX", "Case", "ASUS", 24),
)
LINKS = (
    ("AMD-R5-7600", "SOCKET_CPU", "AM5"),
    ("AMD-R5-7600", "MEM_TYPE", "DDR5"),
    ("INTEL-i5-12400", "SOCKET_CPU", "LGA1700"),
    ("INTEL-i5-12400", "MEM_TYPE", "DDR4"),
    ("ASUS-B650-PLUS", "SOCKET_CPU", "AM5"),
    ("ASUS-B650-PLUS", "MEM_TYPE", "DDR5"),
    ("ASUS-B650-PLUS", "FORM_FACTOR_MB", "ATX"),
    ("MSI-B660M-MORTAR", "SOCKET_CPU", "LGA1700"),
    ("MSI-B660M-MORTAR", "MEM_TYPE", "DDR4"),
    ("MSI-B660M-MORTAR", "FORM_FACTOR_MB", "mATX"),
    ("KINGSTON-D5-16", "MEM_TYPE", "DDR5"),
    ("KINGSTON-D4-16", "MEM_TYPE", "DDR4"),
    ("SAMSUNG-980-1TB", "STORAGE_FORM", "M.2 2280"),
    ("SAMSUNG-870-1TB", "STORAGE_FORM", '2.5"'),
    ("GIGABYTE-RTX4060", "INTERFATA", "PCIe x16"),
    ("ASUS-CASE-ATX", "FORM_FACTOR_MB", "ATX"),
)
WAREHOUSE = ("Central", "Bucuresti", "RO")
OPENING_QUANTITY, OPENING_THRESHOLD = 10, 2

PRODUCT_DDL = (
    "cod_sku string, denumire string, categorie string, producator string, "
    "garantie_luni int, status string"
)


def seed_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The sample catalogue as tables."""
    makers = spark.createDataFrame(list(MANUFACTURERS), "nume string, tara string")
    names = spark.createDataFrame([(c,) for c in CATEGORIES], "nume string")
    codes = spark.createDataFrame(list(STANDARDS), "grup string, cod string, descriere string")
    site = spark.createDataFrame([WAREHOUSE], "nume string, oras string, tara string")
    rows = spark.createDataFrame([(*p, "ACTIV") for p in PRODUCTS], PRODUCT_DDL)
    links = spark.createDataFrame(list(LINKS), "cod_sku string, grup string, cod string")

    def table(name: str, df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
        return merge.table_rows(assign_ids(df, keys, id_column), name)

    tables = {
        "manufacturer": table("manufacturer", makers, ["nume"], "producator_id"),
        "category": table("category", names, ["nume"], "categorie_id"),
        "standard": table("standard", codes, ["grup", "cod"], "standard_id"),
        "warehouse": table("warehouse", site, ["nume", "oras", "tara"], "depozit_id"),
    }
    for name in ("product", "product_standard", "stock"):
        tables[name] = merge.table_rows(spark.createDataFrame([], "x int"), name)
    tables["product"] = merge.new_products(
        tables["product"], rows, tables["category"], tables["manufacturer"], ["denumire"]
    )
    tables["product_standard"] = merge.new_links(
        tables["product_standard"], links, tables["product"], tables["standard"]
    )
    tables["stock"] = merge.opening_stock(
        tables["product"], tables["warehouse"], *WAREHOUSE, OPENING_QUANTITY, OPENING_THRESHOLD
    )
    return tables
