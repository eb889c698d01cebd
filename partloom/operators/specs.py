"""Labelled listing texts to typed part records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions import decode, text
from partloom.operators.joins import lacking
from partloom.schemas import RULE_KINDS, SPEC_CATEGORIES, SPEC_MAP, SpecField, spec_layout


def spec_map_frame(spark: SparkSession) -> DataFrame:
    """The label map as rows (category, label, field, rule); its size is fixed."""
    return spark.createDataFrame(
        list(SPEC_MAP), "category string, label string, field string, rule string"
    )


def _mapped(raw: DataFrame, how: str) -> DataFrame:
    trimmed = raw.withColumn("label", text.strip(F.col("label")))
    rules = F.broadcast(spec_map_frame(raw.sparkSession))
    return trimmed.join(rules, ["category", "label"], how)


def unknown_labels(raw: DataFrame) -> DataFrame:
    """Rows whose label the category does not know, or that have a value and no label."""
    return _mapped(_labelled(raw), "left_anti")


def _labelled(raw: DataFrame) -> DataFrame:
    """The rows with something to decode; an item without any label has an empty one."""
    return raw.where(F.col("label").isNotNull() | F.col("value").isNotNull())


def decode_long(
    raw: DataFrame, fail_on_unknown: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """One typed value per labelled text of any category.

    An unknown label stops the job, or is left out for :func:`unknown_labels`
    to report. A blank text is null under every rule.
    """
    mapped = _mapped(_labelled(raw), "left" if fail_on_unknown else "inner")
    if fail_on_unknown:
        message = F.concat(F.lit("no mapping for label "), F.coalesce("label", F.lit("null")))
        mapped = mapped.withColumn(
            "field", F.coalesce(F.col("field"), F.raise_error(message).cast("string"))
        )
    rule, value = F.col("rule"), F.col("value")
    # Blank is null for every rule; other texts are decoded as they stand.
    return mapped.withColumn("value", _unless_blank(value)).select(
        "category",
        "item_id",
        "name",
        "position",
        "field",
        "rule",
        F.when(rule == "number", decode.numbers(value))
        .when(rule == "capacity", _single(decode.capacity_gb(value)))
        .when(rule == "drive_type", decode.drive_type_numbers(value))
        .when(rule == "drive_form", decode.drive_form_numbers(value))
        .alias("numbers"),
        F.when(rule.isin("token", "flag"), decode.token(value))
        .when(rule == "efficiency", decode.efficiency(value))
        .when(rule == "drive_type", decode.drive_type_text(value))
        .when(rule == "drive_form", decode.drive_form_text(value))
        .alias("text"),
        F.when(rule == "list", decode.text_list(value)).alias("items"),
        *keep,
    )


def decode_with_status(raw: DataFrame) -> DataFrame:
    """Decoded values, and whether their category was taken in whole.

    An item with an unknown label breaks off its category: the item is left
    out and the other items of the category are marked ``incomplete``.
    """
    unknown = unknown_labels(raw).select("category", "item_id").distinct()
    kept = lacking(raw, unknown, ["category", "item_id"])
    # One row per broken category; there are as many as the label map has.
    broken = unknown.select("category").where(F.col("category").isin(*SPEC_CATEGORIES)).distinct()
    marked = kept.join(
        F.broadcast(broken.withColumn("load_status", F.lit("incomplete"))), "category", "left"
    )
    status = F.coalesce(F.col("load_status"), F.lit("complete"))
    return decode_long(marked.withColumn("load_status", status), keep=("load_status",))


def _unless_blank(value: Column) -> Column:
    return F.when(text.strip(value) != "", value)


def _single(value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(value))


def gathered(raw: DataFrame) -> DataFrame:
    """One row per item of any known category: its raw text per field, its first unknown label.

    Of a label given twice the later value stays. Values are reduced per field before
    an item's are put together, so an item holds one text per field of its layout however
    many rows name it. Rows are dealt by all they hold first: the reduction sorts the rows of
    a task, and those that a file's part is unpacked to have no bound.
    """
    raw = raw.repartition(*raw.columns)
    rows = _mapped(raw.where(F.col("category").isin(*SPEC_CATEGORIES)), "left")
    spoken = F.col("label").isNotNull() | F.col("value").isNotNull()
    unknown = F.when(spoken & F.col("field").isNull(), F.coalesce("label", F.lit("null")))
    by_field = rows.groupBy("category", "item_id", "field").agg(
        F.max("name").alias("_name"),
        F.max("price_text").alias("_price"),
        F.min(unknown).alias("_unknown"),
        F.max_by("value", "position").alias("value"),
    )
    text_of = F.when(F.col("field").isNotNull(), F.struct("field", "value"))
    return by_field.groupBy("category", "item_id").agg(
        F.max("_name").alias("_name"),
        F.max("_price").alias("_price"),
        F.min("_unknown").alias("_unknown"),
        F.map_from_entries(F.collect_list(text_of)).alias("_texts"),
    )


def category_status(items: DataFrame) -> DataFrame:
    """Rows (category, load_status, items): what stays of each category of gathered items.

    An item with an unknown label is left out and breaks off its category.
    """
    broken = F.count("_unknown")
    return items.groupBy("category").agg(
        F.when(broken > 0, "incomplete").otherwise("complete").alias("load_status"),
        (F.count("*") - broken).alias("items"),
    )


def records_of(
    items: DataFrame, category: str, drop_thousands_commas: bool = False
) -> DataFrame:
    """Typed records of one category of gathered items, without those with an unknown label."""
    texts = [
        F.col("_texts")[f.field].alias(f"_{f.field}") for f in spec_layout(category)
    ]
    own = items.where(F.col("category") == category)
    flat = own.select("item_id", "_name", "_price", "_unknown", *texts)
    return _records(flat, category, drop_thousands_commas, False)


def _typed(field: SpecField) -> list[Column]:
    """Typed columns of a field, from its raw text column of the same name."""
    value = F.col(f"_{field.field}")
    if field.rule == "drive_type":
        parts = (decode.drive_type_text(value), decode.drive_type_numbers(value))
    elif field.rule == "drive_form":
        parts = (decode.drive_form_text(value), decode.drive_form_numbers(value))
    else:
        simple = {
            "number": decode.numbers,
            "capacity": lambda c: _single(decode.capacity_gb(c)),
            "token": decode.token,
            "flag": decode.flag,
            "efficiency": decode.efficiency,
            "list": decode.text_list,
        }
        return [simple[field.rule](value).alias(field.field)]
    return [parts[0].alias(field.field), parts[1].alias(f"{field.field}_numbers")]


def _gathered(raw: DataFrame, category: str) -> DataFrame:
    """One row per item of a category: its raw text per field, and its first unknown label."""
    layout = spec_layout(category)
    rows = raw.where(F.col("category") == category)
    label, position = text.strip(F.col("label")), F.col("position")
    texts = [
        F.max_by("value", F.when(label == f.label, position)).alias(f"_{f.field}") for f in layout
    ]
    known = F.coalesce(label.isin([f.label for f in layout]), F.lit(False))
    spoken = F.col("label").isNotNull() | F.col("value").isNotNull()
    unknown = F.min(F.when(spoken & ~known, F.coalesce(label, F.lit("null"))))
    return rows.groupBy("item_id").agg(
        F.max("name").alias("_name"),
        F.max("price_text").alias("_price"),
        unknown.alias("_unknown"),
        *texts,
    )


def decode_wide(
    raw: DataFrame,
    category: str,
    drop_thousands_commas: bool = False,
    fail_on_unknown: bool = True,
) -> DataFrame:
    """One typed record per item of a category.

    Texts are gathered per item first and decoded after, each column by its own
    rule; of a label given twice the later value stays. An item with an unknown label
    stops the job, unless it is asked to be left out; :func:`records_with_status` and
    :func:`category_status` leave it out and say so.
    """
    return _records(_gathered(raw, category), category, drop_thousands_commas, fail_on_unknown)


def records_with_status(
    raw: DataFrame, category: str, drop_thousands_commas: bool = False
) -> DataFrame:
    """Records of a category and whether it was taken in whole.

    An item with an unknown label is left out and marks all other records of its
    category ``incomplete``. Items and mark come from one aggregate over the rows.
    """
    items = _gathered(raw, category)
    broken = items.agg(F.count("_unknown").alias("n")).scalar()
    records = _records(items, category, drop_thousands_commas, False)
    status = F.when(broken > 0, "incomplete").otherwise("complete")
    return records.withColumn("load_status", status)


def _records(
    items: DataFrame, category: str, drop_thousands_commas: bool, fail_on_unknown: bool
) -> DataFrame:
    layout = spec_layout(category)
    if fail_on_unknown:
        message = F.concat(F.lit("no mapping for label "), F.col("_unknown"))
        name = F.when(F.col("_unknown").isNull(), F.col("_name")).otherwise(F.raise_error(message))
        items = items.withColumn("_name", name)
    else:
        items = items.where(F.col("_unknown").isNull())
    blanked = {f"_{f.field}": _unless_blank(F.col(f"_{f.field}")) for f in layout}
    return items.withColumns(blanked).select(
        "item_id",
        text.newline_to_space(F.col("_name")).alias("name"),
        decode.price(F.col("_price"), drop_thousands_commas).alias("price"),
        *[column for f in layout for column in _typed(f)],
    )


def record_kinds(category: str) -> dict[str, str]:
    """Kind of each record column after name: numbers, text, boolean, items, mixed."""
    return {"price": "numbers", **{f.field: RULE_KINDS[f.rule] for f in spec_layout(category)}}


def record_columns(category: str) -> Sequence[str]:
    """Typed column names of a category, mixed fields with their second column."""
    columns = ["name"]
    for field, kind in record_kinds(category).items():
        columns.append(field)
        if kind == "mixed":
            columns.append(f"{field}_numbers")
    return columns
