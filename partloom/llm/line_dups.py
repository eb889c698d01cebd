"""Line deduplication by winnowing over line hashes.

Non-blank lines of a document are hashed. Of every window of consecutive line hashes
the smallest is selected, the rightmost of equal ones. Equal windows select the same
line, so a repeated window is sure to have a fingerprint that occurs twice. Only
around fingerprints that do occur twice are the windows compared in full: each window
is joined to its first occurrence in the order of documents. Neighbouring windows with
an earlier occurrence extend each other both ways to a run, and the later runs are
deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.expressions import bind, neighbours, unused, words
from partloom.llm.storage import written

WINDOW = 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _windows(text: Column, width: int) -> Column:
    """The windows of a text: fingerprint, whether newly selected, content hashes, lines."""

    def window(lines: Column, start: Column) -> Column:
        part = F.slice(lines, start + 1, F.lit(width))
        least = F.array_min(
            F.transform(part, lambda x, i: F.struct(x["h"].alias("h"), (-start - i).alias("p")))
        )
        hashes = F.transform(part, lambda x: x["h"])
        return F.struct(
            start.alias("start"),
            least["h"].alias("print"),
            least["p"].alias("place"),
            F.xxhash64(hashes).alias("key_a"),
            F.xxhash64(F.lit(1), F.transform(part, lambda x: x["g"])).alias("key_b"),
            F.transform(part, lambda x: x["i"]).alias("lines"),
        )

    hashed = F.transform(
        _lines(text),
        lambda l, i: F.when(
            l.rlike(r"[^\x20\x09-\x0D]"),
            bind(
                F.regexp_replace(l, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""),
                lambda s: F.struct(
                    F.xxhash64(s).alias("h"), F.xxhash64(F.lit(2), s).alias("g"), i.alias("i")
                ),
            ),
        ),
    )
    return bind(
        F.filter(hashed, lambda x: x.isNotNull()),
        lambda lines: F.when(
            F.size(lines) >= width,
            F.transform(
                F.sequence(F.lit(0), F.size(lines) - width), lambda start: window(lines, start)
            ),
        ),
    )


def _long_lines(text: Column, least: int) -> Column:
    """The windows of one line that has ``least`` words or more."""
    return bind(
        _lines(text),
        lambda lines: F.filter(
            _windows(text, 1), lambda w: F.size(words(F.get(lines, w["lines"][0]))) >= least
        ),
    )


def repeated_lines(
    documents: DataFrame, width: int = WINDOW, long_line: int | None = None
) -> DataFrame:
    """Rows (doc_id, text_hash, removed): the lines that go, by number, of each document."""
    identity = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    spread = documents.select(*identity, F.explode(_windows(F.col("text"), width)).alias("w"))
    if long_line is not None:
        singles = _long_lines(F.col("text"), long_line)
        spread = spread.unionByName(documents.select(*identity, F.explode(singles).alias("w")))
    windows = written(
        spread.select(
            "doc_id",
            "text_hash",
            "w.*",
        ),
        "windows",
    )
    # A line that several windows select is one fingerprint.
    prints = (
        windows.groupBy("print")
        .agg(
            F.min(F.struct("doc_id", "text_hash", "place")).alias("a"),
            F.max(F.struct("doc_id", "text_hash", "place")).alias("b"),
        )
        .where("a <> b")
        .select("print")
    )
    place = F.struct("doc_id", "text_hash", "start")
    near = windows.join(prints, "print", "left_semi").select(
        "key_a", "key_b", "doc_id", "text_hash", "start", "lines"
    )
    near = written(near, "near")
    first = (
        near.groupBy("key_a", "key_b")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first <> last")
        .drop("last")
    )
    later = near.join(first, ["key_a", "key_b"]).where(place > F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("removed")
    )


def without_repeated_runs(
    documents: DataFrame, width: int = WINDOW, long_line: int | None = None
) -> DataFrame:
    """The columns of ``documents``, with later repeated runs of lines cut from text.

    A run is ``width`` or more consecutive lines; blank lines between them do not count
    and stay, and white space at the ends of a line is ignored in comparisons. A line
    goes if it lies in ``width`` consecutive lines that occur earlier: in a row with a
    smaller doc_id, or further up in the same text. A line of ``long_line`` words or more,
    where that is given, also goes if it occurs earlier by itself. Added columns: n_lines (non-blank
    lines before), n_removed, n_runs (maximal runs of removed lines); an n_chars column
    is counted anew where the text changes.

    Null text stays null, and a text of fewer than ``width`` lines stays as it is (but
    for long lines). Rows
    that share doc_id and text are one document and get the same result; rows of one
    doc_id with other texts are ordered by a hash of the text; null ids come first.
    """
    names = [c for c in documents.columns if c not in ("n_lines", "n_removed", "n_runs")]
    hashed, owner, of, removed, left = unused(names, "_hash", "_id", "_gone", "_removed", "_text")
    marked = documents.select(*names, F.xxhash64("text").alias(hashed))
    gone = repeated_lines(documents, width, long_line).select(
        F.col("doc_id").alias(owner), F.col("text_hash").alias(of), F.col("removed").alias(removed)
    )
    joined = marked.join(
        gone, F.col("doc_id").eqNullSafe(F.col(owner)) & (F.col(hashed) == F.col(of)), "left"
    )
    changed = F.col(removed).isNotNull()
    text = bind(
        _lines(F.col("text")),
        lambda lines: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(removed)),
                lambda i: F.get(lines, i),
            ),
            "\n",
        ),
    )
    full = F.filter(_lines(F.col("text")), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))
    breaks = F.filter(
        neighbours(F.col(removed), 1, lambda a, b: b - a), lambda gap: gap > 1
    )
    out = (
        joined.withColumn(left, F.when(changed, text).otherwise(F.col("text")))
        .withColumn("n_lines", F.size(full).cast("long"))
        .withColumn("n_removed", F.when(changed, F.size(removed)).otherwise(0).cast("long"))
        .withColumn("n_runs", F.when(changed, F.size(breaks) + 1).otherwise(0).cast("long"))
    )
    if "n_chars" in names:
        length = F.length(left).cast(documents.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    kept = [F.col(left).alias("text") if c == "text" else F.col(c) for c in names]
    return out.select(*kept, "n_lines", "n_removed", "n_runs")
