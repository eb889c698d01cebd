"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.storage import Steps


def _large_star(links: DataFrame) -> DataFrame:
    """Each node tells its larger neighbours the smallest node it knows."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    # Links may repeat here; the next step makes them distinct.
    return (
        both.where("other > node")
        .join(least, "node")
        .select(F.col("least").alias("a"), F.col("other").alias("b"))
        .where("a <> b")
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Each node moves its smaller neighbours below the smallest of them."""
    down = links.select(
        F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")
    ).where("node <> other")
    least = down.groupBy("node").agg(F.min("other").alias("least"))
    moved = down.join(least, "node")
    return (
        moved.select(F.col("least").alias("a"), F.col("other").alias("b"))
        .unionByName(least.select(F.col("least").alias("a"), F.col("node").alias("b")))
        .where("a <> b")
        .distinct()
    )


def stars(links: DataFrame) -> DataFrame:
    """Links (a, b) from the smallest node of each component to each of its others.

    ``links`` has node ids in a and b. Each round is written to the shared folder,
    so no plan grows with the rounds. The rounds end when only stars are left; their
    number grows with the logarithm of the longest chain.
    """
    steps, turn = Steps(links.sparkSession), 0
    current = steps.write(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a <> b")
        .distinct(),
        "links0",
    )
    while not _are_stars(current):
        current = steps.write(_small_star(_large_star(current)), f"links{turn + 1}")
        steps.drop(f"links{turn}")
        turn += 1
    return current


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component) for every linked node; component is its smallest node."""
    return members(stars(links))


def members(found: DataFrame) -> DataFrame:
    """Rows (id, component) for every node of :func:`stars`."""
    centres = found.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return found.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(centres)


def _are_stars(links: DataFrame) -> bool:
    """Whether distinct links (a, b), a < b, have no node below two others or below and above."""
    ends = links.select(F.col("a").alias("id"), F.lit(0).alias("below")).unionByName(
        links.select(F.col("b").alias("id"), F.lit(1).alias("below"))
    )
    told = ends.groupBy("id").agg(F.sum("below").alias("n"), F.min("below").alias("low"))
    return told.where("n > 1 OR (n = 1 AND low = 0)").isEmpty()
