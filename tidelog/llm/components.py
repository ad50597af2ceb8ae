"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a group-by and a join on node ids; nothing of the graph reaches
the driver but a count and a checksum, and each round is cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tables import cut_with, packed


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest among it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _cut(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` cut, and their number and checksum."""
    done, seen = cut_with(edges, n=F.count(F.lit(1)), x=F.bit_xor(F.xxhash64("u", "v")))
    return packed(done, seen["n"]), (seen["n"], seen["x"])


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): every node u of ``edges`` (u, v) that is not the smallest of its component, with that smallest node v."""
    now, mark = _cut(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct())
    while mark[0]:
        before = mark
        now, mark = _cut(_small_star(_large_star(now)))
        if mark == before:
            break
    return now
