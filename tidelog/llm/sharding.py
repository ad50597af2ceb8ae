"""Sharding by jump consistent hashing, with DataFrame functions only.

A key starts in shard 0 and jumps forward: from shard b the next jump goes to
``floor((b + 1) / r)``, where r in (0, 1] is drawn from a hash of (key, b). The
last landing place below the number of shards is the key's shard. Whether a key
jumps from b depends on the key and b alone, so with one more shard a row
either stays or moves into the new shard, and no ring table is needed.

Slots number the rows of a shard from 0 without gaps. A shard may hold any
number of rows, so each is cut by a hash of the key into ``SLICES`` slices: rows
are numbered within a slice, and a table of at most shards x slices offsets
(a fixed bound, hence broadcast) is added.

Defined results: a null key is hashed as null and gets a shard like any other;
repeated keys share their shard and get different slots; null text has size 16
and no checksum of its own (that of the empty text, 0). An empty table gives an
empty result. Columns of the input may have any names; an added column replaces
one of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.tables import fresh, table

SHARDS, SLICES, OVERHEAD = 40, 256, 16
#: Draws are 31-bit, as in the published algorithm.
DRAW = float(1 << 31)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of ``key`` among ``shards`` (0 to shards - 1), by jump consistent hashing."""

    def step(at: Column, b: Column) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, b), 33) + 1) / F.lit(DRAW)
        jump = F.floor((b + 1) / draw)
        return F.when(at["next"] == b, F.struct(b.alias("shard"), jump.alias("next"))).otherwise(at)

    start = F.struct(F.lit(0).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("next"))
    steps = F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))
    return F.aggregate(steps, start, step, lambda at: at["shard"].cast("int"))


def assign_shards(rows: DataFrame, key: str = "doc_id", shards: int = SHARDS, slices: int = SLICES) -> DataFrame:
    """``rows`` plus shard, slot and grown_shard (the shard among one more)."""
    rows = rows.select(*[c for c in rows.columns if c not in ("shard", "slot", "grown_shard")])
    part, first, of_shard, of_part = fresh([*rows.columns, "shard", "slot"], "slice", "first_slot", "of_shard", "of_slice")
    placed = rows.withColumns({
        "shard": jump_hash(F.col(key), shards),
        "grown_shard": jump_hash(F.col(key), shards + 1),
        part: F.pmod(F.xxhash64(F.col(key), F.lit("slice")), F.lit(slices)).cast("int"),
    })
    counts = placed.groupBy("shard", part).agg(F.count(F.lit(1)).alias("rows_in"))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias(of_shard), F.col(part).alias(of_part), F.coalesce(F.sum("rows_in").over(before), F.lit(0)).alias(first))
    within = Window.partitionBy("shard", part).orderBy(F.col(key), *[F.col(c) for c in rows.columns if c in ("size", "text_crc32")])
    numbered = placed.withColumn("slot", F.row_number().over(within))
    joined = numbered.join(F.broadcast(offsets), (F.col("shard") == F.col(of_shard)) & (F.col(part) == F.col(of_part)))
    return joined.withColumn("slot", F.col("slot") + F.col(first) - 1).select(*rows.columns, "shard", "slot", "grown_shard")


def write_shards(rows: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS) -> None:
    """Write ``rows`` as Parquet with a folder per shard."""
    assign_shards(rows, key, shards).write.mode("overwrite").partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and grown shard of every row of ``documents``, by the ``key`` law."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law")
    )
    return assign_shards(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
