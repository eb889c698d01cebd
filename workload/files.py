"""Files written from the driver's tables and read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.operators import specs
from partloom.operators.reshape import union_by_name
from partloom.plans import spec_dataset
from partloom.plans.wide_catalog import export_wide_csv, read_wide_csv, write_wide
from partloom.schemas import WIDE_DDL
from partloom.session import scratch_path
from partloom.sources import csv_files, discovery, parts_files

from workload import binding as b
from workload import cleaning, sql
from workload.registry import query
from workload.specs import STATUS_SQL, flat_record, odd_layout_specs, wide_sql


def _records(spark, sf_dir, category):
    return specs.decode_wide(b.raw_specs(spark, sf_dir), category)


def _register_roundtrips(category: str) -> None:
    suffix = category.replace("-", "_")
    expected = wide_sql(category, item="")

    @query(f"json_lines_roundtrip_{suffix}", expected)
    def json_lines_roundtrip(spark, sf_dir):
        path = scratch_path(spark, "jsonl")
        parts_files.write_json_lines(_records(spark, sf_dir, category), category, path)
        records = parts_files.read_parts_json(spark, path, category, json_lines=True)
        return flat_record(records, category)

    @query(f"csv_roundtrip_{suffix}", expected)
    def csv_roundtrip(spark, sf_dir):
        path = scratch_path(spark, "csv")
        parts_files.write_parts_csv(_records(spark, sf_dir, category), category, path)
        return flat_record(parts_files.read_parts_csv(spark, path, category), category)


for _category in ("memory", "internal-hard-drive", "webcam", "case-fan"):
    _register_roundtrips(_category)


# Arrays of at most this many records, one array per file.
ARRAY_RECORDS = 1000


def _write_arrays(lines, path):
    """Files of one JSON array each, from (id, line) with dense ids."""
    bucket = F.floor(F.col("id") / ARRAY_RECORDS).alias("bucket")
    listed = lines.groupBy(bucket).agg(F.array_join(F.collect_list("line"), ",").alias("lines"))
    arrays = listed.select("bucket", F.concat(F.lit("["), "lines", F.lit("]")).alias("value"))
    arrays.write.partitionBy("bucket").text(path)


@query("json_array_scan", wide_sql("memory", item=""))
def json_array_scan(spark, sf_dir):
    """Files that hold one JSON array each, fields that are numbers or lists."""
    path = scratch_path(spark, "arrays")
    records = parts_files.to_records(
        _records(spark, sf_dir, "memory"), "memory", keep=("item_id",)
    )
    fields = [c for c in records.columns if c != "item_id"]
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line")
    _write_arrays(records.select(F.col("item_id").alias("id"), line), path)
    return flat_record(parts_files.read_parts_json(spark, path, "memory"), "memory")


@query("count_parts", "SELECT 'complete' AS load_status, count(*) AS parts FROM part")
def count_parts(spark, sf_dir):
    """Records counted over all files of a folder."""
    path = scratch_path(spark, "counted")
    line = F.to_json(F.struct(F.col("p_name").alias("name"), "p_size")).alias("line")
    parts = b.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), line)
    _write_arrays(parts, path)
    counted = parts_files.count_parts(spark, path, file_pattern="*.txt")
    return counted.groupBy(F.lit("complete").alias("load_status")).agg(
        F.sum("parts").alias("parts")
    )


@query(
    "category_subset",
    "SELECT category, label, count(*) AS cnt FROM "
    f"({b.raw_specs_sql()}) WHERE category IN ('webcam', 'memory') GROUP BY 1, 2",
)
def category_subset(spark, sf_dir):
    """A category layout, of which a subset reads only its own folders."""
    root = scratch_path(spark, "layout")
    parts_files.write_by_category(b.raw_specs(spark, sf_dir), root)
    rows = parts_files.read_by_category(spark, root, ("webcam", "memory"))
    return rows.groupBy("category", "label").agg(F.count("*").alias("cnt"))


@query(
    "wide_parquet_roundtrip",
    cleaning.WIDE_SQL,
)
def wide_parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "wide")
    write_wide(cleaning.wide_catalog(spark, sf_dir), path)
    return spark.read.parquet(path).drop(*cleaning.ORDER)


# Names with a line break, a quote and a comma, which a CSV value may hold.
LONG_NAME = "denumire || chr(10) || '\"' || producator || '\", x'"
BROKEN_WIDE_SQL = (
    f"SELECT * REPLACE (coalesce({LONG_NAME}, denumire) AS denumire) FROM ({cleaning.WIDE_SQL})"
)


def broken_wide(spark, sf_dir):
    """The wide catalogue with names that span lines."""
    name = F.expr(f"coalesce({LONG_NAME}, denumire)")
    return cleaning.wide_catalog(spark, sf_dir).withColumn("denumire", name)


@query("wide_csv_roundtrip", BROKEN_WIDE_SQL)
def wide_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "wide-csv")
    export_wide_csv(broken_wide(spark, sf_dir), path)
    rows = read_wide_csv(spark, path)
    columns = [c.split(" ") for c in WIDE_DDL.split(", ")]
    return rows.select(*[F.col(name).cast(kind) for name, kind in columns])


# Text that is hard on a CSV reader: accents, quotes, commas, and line breaks.
ACCENTED = "replace(p_name, 'e', 'é') || ', \"' || p_brand || '\"'"
BROKEN = "p_name || chr(10) || '\"' || p_brand || '\"'"


@query(
    "read_mixed_files",
    f"SELECT p_brand || '-u' AS cod_sku, {ACCENTED} AS denumire, p_type AS categorie, "
    f"p_brand AS producator, CAST(p_size AS STRING) AS socket FROM part UNION ALL "
    f"SELECT p_brand || '-l', {ACCENTED}, 'Unknown', p_brand, NULL FROM part UNION ALL "
    f"SELECT p_brand || '-m', {BROKEN}, 'Unknown', '', NULL FROM part",
)
def read_mixed_files(spark, sf_dir):
    """A folder of CSV files that differ in layout, encoding and line breaks."""
    root = scratch_path(spark, "mixed")
    parts = b.read(spark, sf_dir, "part")
    folders = {
        "utf8": (
            [f"{ACCENTED} AS Name", "p_brand || '-u' AS sku", "p_brand AS Brand"]
            + ["p_type AS `Type`", "CAST(p_size AS STRING) AS `CPU socket`"],
            csv_files.UTF8,
        ),
        "latin": (
            ["p_brand || '-l' AS id", f"{ACCENTED} AS Model", "p_brand AS Maker"],
            csv_files.LATIN1,
        ),
        "lines": ([f"{BROKEN} AS `First col`", "p_brand || '-m' AS pn"], csv_files.UTF8),
    }
    for folder, (columns, encoding) in folders.items():
        (
            parts.selectExpr(*columns)
            .write.option("header", True)
            .option("escape", '"')
            .option("encoding", encoding)
            .csv(f"{root}/{folder}")
        )
    products = csv_files.read_folder(spark, root)
    return products.select("cod_sku", "denumire", "categorie", "producator", "socket")


@query(
    "discover_file",
    "SELECT p_type AS category, 'shortest' AS rule FROM part GROUP BY p_type "
    "ORDER BY length(p_type), p_type LIMIT 1",
)
def discover_file(spark, sf_dir):
    """The first pattern with a hit, then the shortest path."""
    root = scratch_path(spark, "discover")
    b.read(spark, sf_dir, "part").write.partitionBy("p_type").csv(root)
    path = discovery.find_file(spark, root, ["*.tsv", "part-*.csv", "*"])
    found = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"))
    category = F.regexp_extract("path", "p_type=([^/]+)/", 1).alias("category")
    return found.select(category, F.lit("shortest").alias("rule")).distinct()


@query(
    "missing_sources",
    "SELECT p_name AS denumire, p_brand AS producator FROM part",
)
def missing_sources(spark, sf_dir):
    """An absent source adds nothing and does not stop the others."""
    root = scratch_path(spark, "present")
    parts = b.read(spark, sf_dir, "part").selectExpr("p_name AS name", "p_brand AS brand")
    parts.write.option("header", True).csv(f"{root}/files")
    found = csv_files.read_folder(spark, f"{root}/files")
    absent = csv_files.read_folder(spark, f"{root}/none") or csv_files.empty_products(spark)
    return union_by_name([found, absent]).select("denumire", "producator")


@query(
    "export_parts_folder",
    f"SELECT category, load_status, items AS parts, items AS json_rows, items AS csv_rows "
    f"FROM ({STATUS_SQL}) WHERE items > 0",
)
def export_parts_folder(spark, sf_dir):
    """Listing texts of all layouts to category files, and those to JSON Lines, CSV and counts."""
    root = scratch_path(spark, "dataset")
    spec_dataset.write_categories(odd_layout_specs(spark, sf_dir), f"{root}/in")
    counts = spec_dataset.export_parts_folder(spark, f"{root}/in", f"{root}/out")
    found = counts
    for suffix, name in (("jsonl", "json_rows"), ("csv", "csv_rows")):
        files = spark.read.text(f"{root}/out/{suffix}/*")
        header = F.lit(suffix == "csv") & F.col("value").startswith("name,")
        rows = files.where(~header).select(*parts_files.file_columns("_metadata.file_path"))
        written = rows.groupBy("category", "load_status").agg(F.count("*").alias(name))
        found = found.join(written, ["category", "load_status"])
    return found


@query(
    "mapped_standards",
    f"SELECT grup, count(*) AS links FROM ({sql.links()}) GROUP BY 1",
)
def mapped_standards(spark, sf_dir):
    """Links of all parts by a standards map that is read from a file."""
    path = scratch_path(spark, "map")
    rows = spark.createDataFrame(list(b.STANDARDS_MAP.items()), "raw_column string, grup string")
    rows.coalesce(1).write.option("header", True).option("sep", ";").csv(path)
    wide = b.wide_parts(spark, sf_dir)
    mapping = csv_files.read_standards_map(spark, path, wide.columns)
    links = b.standard_links(wide, mapping)
    return links.groupBy("grup").agg(F.count("*").alias("links"))
