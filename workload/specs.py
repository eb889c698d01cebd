"""Spec decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions import decode, text
from partloom.operators import specs

from workload import binding as b
from workload.registry import query

NUMBER = r"\d+\.?\d*|\.\d*"


def numbers_sql(value: str) -> str:
    """List of the decimals in a text, null when there is none."""
    return (
        f"(SELECT CASE WHEN len(x) = 0 OR (len(x) = 1 AND x[1] IS NULL) THEN NULL ELSE x END "
        f"FROM (SELECT list_transform(regexp_extract_all({value}, '{NUMBER}'), "
        "lambda n: try_cast(n AS DOUBLE)) AS x))"
    )


def _summary(values: str, name: str) -> str:
    return (
        f"CAST(len({values}) AS INTEGER) AS {name}_size, {values}[1] AS {name}_first, "
        f"{values}[len({values})] AS {name}_last"
    )


def summary(values, name: str) -> list:
    """A number list as flat columns: size, first and last value."""
    return [
        F.when(values.isNotNull(), F.size(values)).alias(f"{name}_size"),
        decode.first_number(values).alias(f"{name}_first"),
        decode.last_number(values).alias(f"{name}_last"),
    ]


TEXTS = {
    "speed": f"'DDR' || {b.SIZE} || '-' || {b.SIZE} || '00'",
    "dotted": f"{b.SIZE} || '. . ' || p_name || ' 1..' || {b.SIZE}",
    "none": "p_name",
    "price": f"CASE WHEN p_size > 45 THEN ' ' ELSE '$' || {b.SIZE} || ',250.75' END",
}


@query(
    "spec_numbers",
    "WITH t AS (SELECT p_partkey, "
    + ", ".join(f"{numbers_sql(v)} AS {k}" for k, v in TEXTS.items())
    + " FROM part) SELECT p_partkey, "
    + ", ".join(_summary(k, k) for k in ("speed", "dotted", "none"))
    + ", len(speed) = 2 AS speed_pair FROM t",
)
def spec_numbers(spark, sf_dir):
    parts = b.read(spark, sf_dir, "part").select(
        "p_partkey", *[decode.numbers(F.expr(v)).alias(k) for k, v in TEXTS.items()]
    )
    columns = [c for k in ("speed", "dotted", "none") for c in summary(F.col(k), k)]
    return parts.select("p_partkey", *columns, decode.is_pair(F.col("speed")).alias("speed_pair"))


@query(
    "spec_price",
    f"WITH t AS (SELECT p_partkey, {numbers_sql('v')} AS price, "
    f"{numbers_sql("replace(v, ',', '')")} AS whole FROM "
    f"(SELECT p_partkey, {TEXTS['price']} AS v FROM part)) "
    f"SELECT p_partkey, {_summary('price', 'price')}, {_summary('whole', 'whole')} FROM t",
)
def spec_price(spark, sf_dir):
    value = F.expr(TEXTS["price"])
    parts = b.read(spark, sf_dir, "part").select(
        "p_partkey",
        decode.price(value).alias("price"),
        decode.price(value, drop_thousands_commas=True).alias("whole"),
    )
    return parts.select(
        "p_partkey", *summary(F.col("price"), "price"), *summary(F.col("whole"), "whole")
    )


TOKEN = (
    "CASE p_type WHEN 'ECONOMY' THEN 'None' WHEN 'LARGE' THEN 'YES' WHEN 'MEDIUM' THEN 'no' "
    "WHEN 'PROMO' THEN 'none ' ELSE CASE p_size % 4 WHEN 0 THEN '1' WHEN 1 THEN 't' "
    "WHEN 2 THEN 'Y' ELSE p_name END END"
)


def token_sql(value: str) -> str:
    return (
        f"CASE lower({value}) WHEN 'none' THEN NULL WHEN 'yes' THEN 'true' WHEN 'no' THEN 'false' "
        f"ELSE {value} END"
    )


@query(
    "spec_tokens",
    f"SELECT p_partkey, {token_sql(TOKEN)} AS token, CASE lower({TOKEN}) WHEN 'yes' THEN true "
    "WHEN 'no' THEN false END AS flag FROM part",
)
def spec_tokens(spark, sf_dir):
    value = F.expr(TOKEN)
    return b.read(spark, sf_dir, "part").select(
        "p_partkey", decode.token(value).alias("token"), decode.flag(value).alias("flag")
    )


LIST = f"p_name || ', ' || p_brand || CASE WHEN p_size > 25 THEN ',' || {b.SIZE} ELSE ', ' END"


@query(
    "spec_lists",
    f"WITH t AS (SELECT p_partkey, string_split({LIST}, ', ') AS x FROM part) SELECT p_partkey, "
    "CAST(len(x) AS INTEGER) AS items, array_to_string(x, '|') AS joined FROM t",
)
def spec_lists(spark, sf_dir):
    items = decode.text_list(F.expr(LIST))
    return b.read(spark, sf_dir, "part").select(
        "p_partkey", F.size(items).alias("items"), F.array_join(items, "|").alias("joined")
    )


CAPACITY = (
    f"CASE p_type WHEN 'ECONOMY' THEN {b.SIZE} || ' GB' WHEN 'LARGE' THEN {b.SIZE} || '.5 TB' "
    f"WHEN 'MEDIUM' THEN {b.SIZE} || ' MB' WHEN 'PROMO' THEN {b.SIZE} WHEN 'SMALL' THEN ' GB' "
    f"ELSE {b.SIZE} || 'x GB' END"
)


def capacity_sql(value: str, megabytes: str = "* 1000") -> str:
    amount = f"split_part({value}, ' ', 1)"
    unit = f"split_part({value}, ' ', 2)"
    number = f"try_cast(regexp_extract({amount}, '^[0-9]+(\\.[0-9]*)?') AS DOUBLE)"
    return (
        f"CASE WHEN {amount} = '' OR {unit} = '' THEN NULL WHEN {unit} = 'GB' THEN {number} "
        f"WHEN {unit} = 'MB' THEN {number} {megabytes} ELSE {number} * 1000 END"
    )


@query(
    "spec_capacity",
    f"WITH t AS (SELECT p_partkey, {CAPACITY} AS v FROM part) SELECT p_partkey, "
    f"{capacity_sql('v')} AS gb, {capacity_sql('v', '/ 1000')} AS gb_scaled FROM t",
)
def spec_capacity(spark, sf_dir):
    value = F.expr(CAPACITY)
    return b.read(spark, sf_dir, "part").select(
        "p_partkey",
        decode.capacity_gb(value).alias("gb"),
        decode.capacity_gb(value, scale_megabytes=True).alias("gb_scaled"),
    )


DRIVE_TYPE = f"CASE WHEN p_size > 25 THEN 'SSD' ELSE {b.SIZE} || '00 RPM' END"
DRIVE_FORM = f"CASE WHEN p_size > 25 THEN 'M.2-' || {b.SIZE} ELSE {b.SIZE} || '.5\"' END"


@query(
    "spec_drive",
    f"WITH t AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'SSD' END AS type_label, "
    f"CASE WHEN p_size <= 25 THEN {numbers_sql(DRIVE_TYPE)} END AS rpm, "
    f"CASE WHEN p_size > 25 THEN {DRIVE_FORM} END AS form_label, "
    f"CASE WHEN p_size <= 25 THEN {numbers_sql(DRIVE_FORM)} END AS inches FROM part) "
    f"SELECT p_partkey, type_label, form_label, {_summary('rpm', 'rpm')}, "
    f"{_summary('inches', 'inches')} FROM t",
)
def spec_drive(spark, sf_dir):
    kind, form = F.expr(DRIVE_TYPE), F.expr(DRIVE_FORM)
    parts = b.read(spark, sf_dir, "part").select(
        "p_partkey",
        decode.drive_type_text(kind).alias("type_label"),
        decode.drive_form_text(form).alias("form_label"),
        decode.drive_type_numbers(kind).alias("rpm"),
        decode.drive_form_numbers(form).alias("inches"),
    )
    return parts.select(
        "p_partkey",
        "type_label",
        "form_label",
        *summary(F.col("rpm"), "rpm"),
        *summary(F.col("inches"), "inches"),
    )


RATING = (
    f"CASE WHEN p_size > 40 THEN '80+' WHEN p_size > 30 THEN NULL ELSE '80+ ' || "
    f"upper({b.FIRST_WORD}) || ' x' END"
)


@query(
    "spec_efficiency",
    f"SELECT p_partkey, CASE WHEN p_size > 40 THEN 'plus' WHEN p_size <= 30 "
    f"THEN lower({b.FIRST_WORD}) END AS efficiency FROM part",
)
def spec_efficiency(spark, sf_dir):
    rating = decode.efficiency(F.expr(RATING)).alias("efficiency")
    return b.read(spark, sf_dir, "part").select("p_partkey", rating)


@query(
    "spec_names",
    "SELECT p_partkey, p_name || ' ' || p_brand AS name FROM part",
)
def spec_names(spark, sf_dir):
    """Names with line breaks made one line."""
    name = text.newline_to_space(F.expr("p_name || chr(10) || p_brand")).alias("name")
    return b.read(spark, sf_dir, "part").select("p_partkey", name)


# Field and rule per bound label, as the check database needs them.
FIELDS = {(f.category, f.label): (f.field, f.rule) for f in specs.SPEC_MAP}
MAP_SQL = "VALUES " + ", ".join(
    f"('{c}', '{label}', '{FIELDS[c, label][0]}', '{FIELDS[c, label][1]}')"
    for _, c, label, _ in b.SPEC_TEXTS
)


def decoded_sql(map_sql: str) -> str:
    return (
        "SELECT category, item_id, name, price_text, position, field, rule, "
        f"CASE WHEN rule = 'number' THEN {numbers_sql('v')} "
        f"WHEN rule = 'capacity' AND {capacity_sql('v')} IS NOT NULL THEN [{capacity_sql('v')}] "
        f"WHEN rule = 'drive_type' AND v <> 'SSD' THEN {numbers_sql('v')} "
        f"WHEN rule = 'drive_form' AND contains(v, '\"') THEN {numbers_sql('v')} END AS numbers, "
        f"CASE WHEN rule IN ('token', 'flag') THEN {token_sql('v')} "
        "WHEN rule = 'efficiency' THEN CASE WHEN contains(v, ' ') THEN lower(split_part(v, ' ', 2)) "
        "ELSE 'plus' END WHEN rule = 'drive_type' AND v = 'SSD' THEN v "
        "WHEN rule = 'drive_form' AND NOT contains(v, '\"') THEN v END AS text, "
        "CASE WHEN rule = 'list' THEN string_split(v, ', ') END AS items "
        "FROM (SELECT *, CASE WHEN trim(value) <> '' THEN value END AS v FROM raw "
        f"JOIN ({map_sql}) m(category, label, field, rule) USING (category, label))"
    )


DECODED_SQL = decoded_sql(MAP_SQL)


def long_sql(texts) -> str:
    return (
        f"WITH raw AS ({b.raw_specs_sql(texts)}), d AS ({DECODED_SQL}) SELECT category, item_id, "
        f"name, position, field, rule, text, {_summary('numbers', 'numbers')}, "
        "array_to_string(items, '|') AS items FROM d"
    )


def flat_long(decoded):
    return decoded.select(
        "category",
        "item_id",
        "name",
        "position",
        "field",
        "rule",
        "text",
        *summary(F.col("numbers"), "numbers"),
        F.array_join("items", "|").alias("items"),
    )


@query("spec_decode", long_sql(b.SPEC_TEXTS))
def spec_decode(spark, sf_dir):
    """Typed value of every labelled text of every category."""
    return flat_long(specs.decode_long(b.raw_specs(spark, sf_dir)))


LABELS_WITH_UNKNOWN = (*b.SPEC_TEXTS, b.UNKNOWN_LABEL)


@query("spec_decode_known", long_sql(b.SPEC_TEXTS))
def spec_decode_known(spark, sf_dir):
    """Unknown labels are left out, the rest is decoded."""
    raw = b.raw_specs(spark, sf_dir, LABELS_WITH_UNKNOWN)
    return flat_long(specs.decode_long(raw, fail_on_unknown=False))


@query(
    "spec_unknown_labels",
    f"SELECT 'webcam' AS category, p_partkey AS item_id, 'Shipping Weight' AS label, "
    f"{b.SIZE} AS value FROM part WHERE p_type = 'PROMO'",
)
def spec_unknown_labels(spark, sf_dir):
    raw = b.raw_specs(spark, sf_dir, LABELS_WITH_UNKNOWN)
    return specs.unknown_labels(raw).select("category", "item_id", "label", "value")


def with_unknown_labels(spark, sf_dir):
    """All labelled texts; the larger parts of one category have an unknown label too."""
    raw = b.raw_specs(spark, sf_dir, LABELS_WITH_UNKNOWN)
    nothing = (F.col("label") == b.UNKNOWN_LABEL[2]) & (F.col("value").cast("int") <= 25)
    kept = ~F.coalesce(nothing, F.lit(False))
    return raw.withColumns({c: F.when(kept, F.col(c)) for c in ("value", "label")})


@query(
    "spec_load_status",
    "SELECT category, CASE WHEN category = 'webcam' THEN 'incomplete' ELSE 'complete' END "
    f"AS load_status, count(*) AS cnt FROM ({b.raw_specs_sql()}) JOIN part ON item_id = p_partkey "
    "WHERE category <> 'webcam' OR p_size <= 25 GROUP BY 1, 2",
)
def spec_load_status(spark, sf_dir):
    """Items with an unknown label break off their category; what is left is kept."""
    kept = specs.decode_with_status(with_unknown_labels(spark, sf_dir))
    return kept.groupBy("category", "load_status").agg(F.count("*").alias("cnt"))


# Every layout: the parts in turn are of each category, with a text for each of its labels.
RULE_TEXTS = {
    "number": f"{b.SIZE} || ' x ' || {b.SIZE} || '.5 W'",
    "capacity": f"{b.SIZE} || CASE WHEN p_size > 25 THEN ' GB' ELSE ' TB' END",
    "token": b.FIRST_WORD,
    "flag": "CASE WHEN p_size > 25 THEN 'Yes' ELSE 'no' END",
    "efficiency": f"'80+ ' || upper({b.SECOND_WORD})",
    "list": "p_name || ', ' || p_brand",
    "drive_type": f"CASE WHEN p_size > 25 THEN 'SSD' ELSE {b.SIZE} || '00 RPM' END",
    "drive_form": f"CASE WHEN p_size > 25 THEN 'M.2' ELSE {b.SIZE} || '.5\"' END",
}
CATEGORY_OF = {c: i for i, c in enumerate(specs.SPEC_CATEGORIES)}
LAYOUT_ROWS = [
    (CATEGORY_OF[f.category], i, f.category, f.label, f.field, f.rule)
    for i, f in enumerate(specs.SPEC_MAP)
]
LAYOUT_MAP = "VALUES " + ", ".join(str(row[2:]) for row in LAYOUT_ROWS)
RULE_CASE = " ".join(f"WHEN '{rule}' THEN {text}" for rule, text in RULE_TEXTS.items())
LAYOUTS_SQL = (
    "SELECT category, p_partkey AS item_id, p_name AS name, "
    f"{b.PRICE} AS price_text, CAST(position AS INTEGER) AS position, label, "
    f"CASE rule {RULE_CASE} END AS value FROM part JOIN (VALUES "
    + ", ".join(str(row) for row in LAYOUT_ROWS)
    + f") m(number, position, category, label, field, rule) ON p_partkey % {len(CATEGORY_OF)} = number"
)


def layout_specs(spark, sf_dir):
    """Labelled texts of all layouts."""
    fields = "number int, position int, category string, label string, field string, rule string"
    layouts = F.broadcast(spark.createDataFrame(LAYOUT_ROWS, fields))
    parts = b.read(spark, sf_dir, "part").withColumn(
        "number", F.expr(f"CAST(p_partkey % {len(CATEGORY_OF)} AS INT)")
    )
    return parts.join(layouts, "number").selectExpr(
        "category",
        "p_partkey AS item_id",
        "p_name AS name",
        f"{b.PRICE} AS price_text",
        "position",
        "label",
        f"CASE rule {RULE_CASE} END AS value",
    )


@query(
    "spec_decode_layouts",
    f"WITH raw AS ({LAYOUTS_SQL}), d AS ({decoded_sql(LAYOUT_MAP)}) SELECT category, item_id, "
    f"name, position, field, rule, text, {_summary('numbers', 'numbers')}, "
    "array_to_string(items, '|') AS items FROM d",
)
def spec_decode_layouts(spark, sf_dir):
    """Typed values of every label of all layouts."""
    return flat_long(specs.decode_long(layout_specs(spark, sf_dir)))


# Items with a label that none knows, in every third category, and some without a label.
ODD = f"p_partkey % {len(CATEGORY_OF)} % 3 = 0 AND p_size <= 25"
STATUS_SQL = (
    "SELECT category, CASE WHEN number % 3 = 0 AND broken > 0 THEN 'incomplete' ELSE 'complete' END "
    "AS load_status, items - broken AS items FROM (SELECT category, number, "
    f"count(*) AS items, count(*) FILTER ({ODD}) AS broken FROM part JOIN (VALUES "
    + ", ".join(f"({i}, '{c}')" for c, i in CATEGORY_OF.items())
    + f") m(number, category) ON p_partkey % {len(CATEGORY_OF)} = number GROUP BY 1, 2)"
)


def odd_layout_specs(spark, sf_dir):
    """All layouts, where items of every third have a label of their own or none."""
    raw = layout_specs(spark, sf_dir)
    numbers = spark.createDataFrame([*CATEGORY_OF.items()], "category string, number int")
    parts = b.read(spark, sf_dir, "part").where(ODD)
    odd = parts.join(
        F.broadcast(numbers), F.expr(f"p_partkey % {len(CATEGORY_OF)} = number")
    ).selectExpr(
        "category",
        "p_partkey AS item_id",
        "p_name AS name",
        f"{b.PRICE} AS price_text",
        "999 AS position",
        "CASE WHEN p_size > 5 THEN 'Shipping Weight' END AS label",
        "'1 kg' AS value",
    )
    return raw.unionByName(odd)


@query("spec_records_status", STATUS_SQL)
def spec_records_status(spark, sf_dir):
    """Records per category, all layouts in one pass, where some items have unknown labels."""
    return specs.category_status(specs.gathered(odd_layout_specs(spark, sf_dir)))


# Flat columns of a record per kind, in Spark and in the check SQL.
def flat_record(df, category: str):
    columns = [F.col("name")]
    for field, kind in specs.record_kinds(category).items():
        value = F.col(field)
        if kind == "numbers":
            columns.extend(summary(value, field))
        elif kind == "items":
            columns.append(F.array_join(value, "|").alias(field))
        elif kind == "mixed":
            columns.append(value)
            columns.extend(summary(F.col(f"{field}_numbers"), f"{field}_numbers"))
        else:
            columns.append(value)
    return df.select(*[c for c in ("item_id",) if c in df.columns], *columns)


def wide_sql(category: str, item: str = "item_id, ") -> str:
    inner, outer = [], []

    def pick(column: str, field: str) -> str:
        return f"any_value({column}) FILTER (field = '{field}')"

    for field, kind in specs.record_kinds(category).items():
        if field == "price":
            continue
        if kind in ("numbers", "mixed"):
            name = field if kind == "numbers" else f"{field}_numbers"
            inner.append(f"{pick('numbers', field)} AS n_{field}")
            outer.append(_summary(f"n_{field}", name))
        if kind in ("text", "mixed"):
            inner.append(f"{pick('text', field)} AS t_{field}")
            outer.append(f't_{field} AS "{field}"')
        if kind == "boolean":
            inner.append(f"{pick('text', field)} AS t_{field}")
            outer.append(f'try_cast(t_{field} AS BOOLEAN) AS "{field}"')
        if kind == "items":
            inner.append(f"{pick('items', field)} AS i_{field}")
            outer.append(f"array_to_string(i_{field}, '|') AS \"{field}\"")
    return (
        f"WITH raw AS ({b.raw_specs_sql()}), d AS ({DECODED_SQL}), w AS (SELECT item_id, name, "
        f"{numbers_sql('price_text')} AS price, {', '.join(inner)} FROM d "
        f"WHERE category = '{category}' GROUP BY item_id, name, price_text) "
        f"SELECT {item}name, {_summary('price', 'price')}, {', '.join(outer)} FROM w"
    )


def _register(category: str) -> None:
    name = "spec_records_" + category.replace("-", "_")

    @query(name, wide_sql(category))
    def spec_records(spark, sf_dir):
        return flat_record(specs.decode_wide(b.raw_specs(spark, sf_dir), category), category)


BOUND_CATEGORIES = tuple(dict.fromkeys(c for _, c, _, _ in b.SPEC_TEXTS))
for _category in BOUND_CATEGORIES:
    _register(_category)
