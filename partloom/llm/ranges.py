"""Running sums over a global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.storage import written


def running(df: DataFrame, order: Sequence[str], sums: Sequence[str], name: str) -> DataFrame:
    """The rows of ``df`` with before_<c>: the sum of c over all rows that come earlier.

    Rows are dealt to tasks by ranges of ``order`` and written with the number of their
    range, as ranges drawn anew after a lost executor would have other bounds. Each range
    then starts from the total of those before it: one row a range, so their number is
    that of shuffle partitions and not of the input. Equal rows may change places.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(
        df.repartitionByRange(ranges, *order).withColumn("range_id", F.spark_partition_id()),
        name,
    )
    earlier = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("range_id")
        .agg(*[F.sum(c).alias(f"all_{c}") for c in sums])
        .select(
            "range_id",
            *[F.coalesce(F.sum(f"all_{c}").over(earlier), F.lit(0)).alias(f"start_{c}") for c in sums],
        )
    )
    above = (
        Window.partitionBy("range_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = {
        f"before_{c}": F.col(f"start_{c}") + F.coalesce(F.sum(c).over(above), F.lit(0))
        for c in sums
    }
    return dealt.join(F.broadcast(starts), "range_id").select(
        *df.columns, *[column.alias(c) for c, column in before.items()]
    )
