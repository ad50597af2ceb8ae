"""Operators over a total order that don't need the order in one partition.

The log of a tenant is totally ordered, and a tenant may hold any share of all
rows. Ordered operators therefore work in buckets of the order key: a window
within a bucket, a small table with one row per bucket that carries state from
bucket to bucket, and a join of the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bucket in units of the order key.
BUCKET = 1 << 20


def bucket(order: Column, width: int = BUCKET) -> Column:
    return F.floor(order / F.lit(width)).cast("bigint")


def forward_fill(rows: DataFrame, keys: list[str], order: str, value: Column, into: str, *, inclusive: bool = True, width: int = BUCKET) -> DataFrame:
    """``rows`` plus ``into``: the last non-null ``value`` up to each row (or before it) in its group.

    Works on groups of any size; rows of one bucket of one group share a task.
    """
    # Keys as one struct: its equality holds for null keys too, so that one partitioning serves windows and join.
    work = rows.withColumns({"_key": F.struct(*keys), "_value": value, "_bucket": bucket(F.col(order), width)})
    in_bucket = Window.partitionBy("_key", "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = work.withColumn("_local", F.last("_value", True).over(in_bucket)).drop("_value")
    # One row per bucket: its last value, and the last one of the buckets before it.
    ends = work.groupBy("_key", "_bucket").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_key", "_bucket", F.last("_end", True).over(before).alias("_carry"))
    joined = local.join(carried, ["_key", "_bucket"])
    return joined.select(*rows.columns, F.coalesce("_local", "_carry").alias(into))


#: Buckets (one small row each) up to which their offsets are broadcast.
FEW_BUCKETS = 2_000_000


def number_in_bucket(rows: DataFrame, keys: list[str], order: str, ties: list[str] | None = None, width: int = BUCKET) -> DataFrame:
    """``rows`` plus ``_bucket``, unless they have it, and ``_number`` in it."""
    work = rows if "_bucket" in rows.columns else rows.withColumn("_bucket", bucket(F.col(order), width))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(order, *(ties or []))
    return work.withColumn("_number", F.row_number().over(inner))


def number_across(numbered: DataFrame, keys: list[str], into: str, broadcast: bool = False) -> DataFrame:
    """Rows numbered in buckets plus ``into``, their number in the group. They are read twice, best from files."""
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if broadcast and counts.limit(FEW_BUCKETS + 1).count() <= FEW_BUCKETS:
        offsets = F.broadcast(offsets)
    columns = [c for c in numbered.columns if c not in ("_bucket", "_number")]
    return numbered.join(offsets, [*keys, "_bucket"]).withColumn(into, F.col("_number") + F.col("_offset")).select(*columns, into)


def sequence_number(rows: DataFrame, keys: list[str], order: str, into: str, ties: list[str] | None = None, width: int = BUCKET) -> DataFrame:
    """``rows`` plus ``into``: the row's number in its group, from 1, by ``order`` and ``ties``."""
    return number_across(number_in_bucket(rows, keys, order, ties, width), keys, into)
