"""The corpus operators bound to the driver's tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm import (
    contamination,
    html_text,
    licenses,
    line_dups,
    mixing,
    near_dups,
    packing,
    pii,
    quality,
    search,
    sql,
    suffix_dedup,
    toxicity,
    tries,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> str:
    """The public byte-level vocabulary that the packing contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_quality_rules", sql.quality_sql())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[
            f"m.{c}"
            for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        ],
        "base_failed",
        "kept",
        "posterior",
    )


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    machine = toxicity.train(toxicity.labelled_texts(documents, read(spark, sf_dir, "labels")))
    return toxicity.scores(documents, machine).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op3_near_duplicates", sql.NEAR_SQL)
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), vocabulary())


@query("op5_license_scan", sql.license_sql())
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(read(spark, sf_dir, "documents")).select(
        "doc_id",
        F.array_join("licenses", ",").alias("licenses"),
        "best_license",
        "best_score",
        "n_matches",
    )


@query("op6_pii_surrogates")
def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(read(spark, sf_dir, "documents"), key="partloom").select(
        "doc_id", "n_entities", F.array_join("entity_kinds", ",").alias("entity_kinds"), "text"
    )


@query("op7_line_dedup", sql.LINES_SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dups.without_repeated_runs(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


@query("op8_suffix_dedup", sql.REPEATS_SQL)
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(read(spark, sf_dir, "documents"))


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_text.main_text(pages, html_text.trained(pages))


@query("op10_decontamination", sql.contamination_sql())
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), width=10
    )
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op11_prefix_trie", sql.trie_sql())
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie(tries.regrafted(tries.sequences(read(spark, sf_dir, "conversations"))))


@query("op12_source_mix", sql.mixing_sql())
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query("op13_lexical_search", sql.search_sql())
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
