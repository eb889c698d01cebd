"""Key sidecars: which keys a written run may hold, in two bytes a key.

A sidecar is a Bloom filter in chunks of 32,768 bits, one row a chunk: of each key two
hashes name a bit each. A key whose bits are not both set is not in the run; about one
key in seventy that is not there seems to be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BITS = 32_768
BITS_PER_KEY = 16
_DDL = "chunk long, bits binary"


def chunks_for(keys: int) -> int:
    """Chunks of a sidecar for so many keys."""
    return max(1, -(-keys * BITS_PER_KEY // CHUNK_BITS))


def _bits(key: Column, chunks: Column) -> list[Column]:
    """The two bits of a key in a sidecar of so many chunks."""
    return [F.pmod(F.xxhash64(key, F.lit(seed)), chunks * CHUNK_BITS) for seed in (1, 2)]


def write_index(keys: DataFrame, key: Column, chunks: int, path: str) -> None:
    """Write the sidecar of the keys of a run, in so many chunks."""
    places = keys.select(F.explode(F.array(*_bits(key, F.lit(chunks)))).alias("bit"))
    located = places.select(
        F.shiftright("bit", 15).alias("chunk"), F.col("bit").bitwiseAND(CHUNK_BITS - 1).alias("bit")
    )
    filters = located.groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))
    filters.sortWithinPartitions("chunk").write.parquet(path)


def _is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.shiftright(byte, 0).bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0


def runs_that_may_hold(
    spark: SparkSession, keys: DataFrame, key: Column, sidecars: Sequence[tuple[str, int]]
) -> list[int]:
    """Positions of the sidecars (path, chunks) that may hold any of the keys.

    Keys times sidecars are looked up, so this is for few keys; of a sidecar only the
    rows of wanted chunks are joined.
    """
    tables = F.array(
        *[F.struct(F.lit(i).alias("run"), F.lit(c).cast("long").alias("chunks")) for i, (_, c) in enumerate(sidecars)]
    )
    wanted = keys.select(key.alias("key")).distinct().select("key", F.inline(tables))
    one, two = _bits(F.col("key"), F.col("chunks"))
    wanted = wanted.select("run", one.alias("one"), two.alias("two"))
    held = None
    for i, (path, _) in enumerate(sidecars):
        rows = spark.read.schema(_DDL).parquet(path).withColumn("run", F.lit(i))
        held = rows if held is None else held.unionByName(rows)
    for bit in ("one", "two"):
        inside = F.col(bit).bitwiseAND(CHUNK_BITS - 1)
        wanted = (
            wanted.withColumn("chunk", F.shiftright(bit, 15))
            .join(held, ["run", "chunk"])
            .where(_is_set(F.col("bits"), inside))
            .drop("chunk", "bits")
        )
    return sorted(row.run for row in wanted.select("run").distinct().collect())
