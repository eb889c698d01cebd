"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled by a hash of their ids and queue up, once for each
time they may be used. A document's virtual finish time is the words of its source up to
its own end, divided by the source's target: all sources reach their target at time 1.
Documents of all sources are sorted by that time over the whole cluster, and the mix is
cut where it has the words it may hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.expressions import WORD
from partloom.llm.ranges import running
from partloom.llm.storage import written
from partloom.operators.joins import lookup

WEIGHTS = (5, 2, 1)
REPEATS = 3


def _sized(documents: DataFrame) -> DataFrame:
    """One narrow row a document, with its place in the shuffle of its source."""
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return documents.select(
        "doc_id",
        F.col("source").isNull().alias("unnamed"),
        F.coalesce("source", F.lit("")).alias("named"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(identity), 1, 15), 16, 10).cast("long").alias("draw"),
    )


def targets(
    sized: DataFrame, weights: Sequence[int], percent: int, repeats: int
) -> tuple[DataFrame, int]:
    """Rows (unnamed, named, number, before_total, total, longest, target) and the mix's size.

    Sources share the mix by weight. One whose share is above ``repeats`` times its size
    is full there, and the others share what is left: with sources in the order in which
    they fill up, the level of those that do not is the largest of the levels at which
    the first so many are full.
    """
    totals = sized.groupBy("unnamed", "named").agg(
        F.sum("size").alias("total"), F.max("size").alias("longest"), F.lit(1).alias("one")
    )
    listed = running(totals, ["unnamed", "named"], ["one", "total"], "sources")
    choices = F.array(*[F.lit(int(w)) for w in weights])
    weighed = written(
        listed.withColumn("number", F.col("before_one"))
        .withColumn("weight", F.get(choices, (F.col("number") % len(weights)).cast("int")).cast("long"))
        .withColumn("most", repeats * F.col("total"))
        .withColumn("fill", F.col("most") / F.col("weight"))
        .drop("one", "before_one"),
        "weights",
    )
    all_weights, all_words = weighed.agg(F.sum("weight"), F.sum("total")).first()
    budget = (all_words or 0) * percent // 100
    filled = running(weighed, ["fill", "number"], ["most", "weight"], "fills")
    level = filled.agg(
        F.max((F.lit(budget) - F.col("before_most")) / (F.lit(all_weights or 0) - F.col("before_weight")))
    ).first()[0]
    target = F.least(F.col("most").cast("double"), F.lit(level).cast("double") * F.col("weight"))
    return weighed.withColumn("target", target).drop("most", "fill", "weight"), budget


def _finish(copy: Column) -> Column:
    return (copy * F.col("total") + F.col("reach")) / F.col("target")


def _last(placed: DataFrame, budget: int, repeats: int) -> tuple | None:
    """The place in the queue of the document that fills the mix, and the words it gives."""
    # At this time every source has reached its target, whatever the length of its documents.
    horizon = placed.where("target > 0").agg(F.max(F.col("longest") / F.col("target"))).first()[0]
    if horizon is None or budget <= 0:
        return None
    copies = F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))
    queue = (
        placed.where("size > 0")
        .withColumn("copy", F.explode(copies))
        .withColumn("finish", _finish(F.col("copy")))
        .where(F.col("finish") <= (1 + horizon) * 1.000001)
        .select("finish", "number", "copy", "reach", "size")
    )
    order = ["finish", "number", "copy", "reach"]
    return (
        running(queue, order, ["size"], "queue")
        .where((F.col("before_size") < budget) & (F.col("before_size") + F.col("size") >= budget))
        .select(*order, F.lit(budget) - F.col("before_size"))
        .first()
    )


def mixed(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    percent: int = 100,
    repeats: int = REPEATS,
) -> DataFrame:
    """How many words of each document a mix of sources by weight takes.

    Sources, ordered by name and unnamed last, get ``weights`` in turn and share a mix of
    ``percent`` of all words. No document is used more than ``repeats`` times; a source
    whose share would need more leaves the rest to the others. Whole documents are taken,
    but for the one that fills the mix, whose last use is cut there.

    Returned, one row for each row of ``documents``: doc_id, source, size (its words),
    source_size (those of its source), target (words the mix should have of that source)
    and taken (words the mix takes of the document, repeats counted). Null text has no
    words; documents without words are taken nothing of. Rows that share a doc_id queue
    up one by one; null ids are shuffled together. An empty table, or one without words,
    gives targets of 0. Other columns are ignored. Reruns give the same rows.
    """
    sized = written(_sized(documents), "sizes")
    sources, budget = targets(sized, weights, percent, repeats)
    shares = written(sources, "targets")
    rows = lookup(sized, shares.select("unnamed", "named", "number"), ["unnamed", "named"], "inner")
    # Places are counted over all sources in a row, as one source may hold most documents.
    queued = running(rows, ["number", "draw", "doc_id", "size"], ["size"], "shuffled")
    placed = written(
        lookup(queued, shares.drop("unnamed", "named"), ["number"], "inner").withColumn(
            "reach", F.col("before_size") - F.col("before_total") + F.col("size")
        ),
        "placed",
    )
    last = _last(placed, budget, repeats)
    if last is None:
        taken = F.lit(0 if budget <= 0 else repeats) * F.col("size")
    else:
        end = F.struct(*[F.lit(last[c]).alias(c) for c in ("finish", "number", "copy", "reach")])

        def uses(copy: int) -> Column:
            place = F.struct(
                _finish(F.lit(copy).cast("long")).alias("finish"),
                F.col("number"),
                F.lit(copy).cast("long").alias("copy"),
                F.col("reach"),
            )
            return (
                F.when(F.col("size") == 0, 0)
                .when(place < end, F.col("size"))
                .when(place == end, F.lit(last[4]))
                .otherwise(0)
            )

        taken = sum((uses(copy) for copy in range(1, repeats)), uses(0))
    return placed.select(
        "doc_id",
        F.when(~F.col("unnamed"), F.col("named")).alias("source"),
        "size",
        F.col("total").alias("source_size"),
        "target",
        taken.cast("long").alias("taken"),
    )
