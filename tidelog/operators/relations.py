"""Relation metadata in force at each change, and naming of its cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMN = "struct<name:string,type_oid:bigint,typmod:int,flags:int>"
RELATION = f"struct<schema_name:string,table_name:string,identity:string,columns:array<{COLUMN}>>"
#: Relation messages up to which their ranges are broadcast without a look at their size.
FEW_RELATIONS = 10_000


def with_relation(decoded: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``decoded`` rows plus ``rel``: the last relation message of the row's rel_oid up to it.

    Relation messages are few: each becomes the range of the log in which it
    holds, and changes are joined to ranges. No change is sorted or moved where
    the ranges are small enough to broadcast (adaptive execution sees to that;
    where ``known``, the relations in force before the log, are given, their
    number is looked at first).
    """
    after = Window.partitionBy("tenant", "rel_oid").orderBy("seq")
    said = messages(decoded, known)
    ranges = said.select(
        F.col("tenant").alias("_tenant"), F.col("rel_oid").alias("_oid"), F.col("seq").alias("_from"), F.lead("seq").over(after).alias("_to"), F.col("relation").alias("rel")
    )
    if known is not None and said.limit(FEW_RELATIONS + 1).count() <= FEW_RELATIONS:
        ranges = F.broadcast(ranges)
    holds = (F.col("seq") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("seq") < F.col("_to")))
    joined = decoded.join(ranges, F.col("tenant").eqNullSafe(F.col("_tenant")) & (F.col("rel_oid") == F.col("_oid")) & holds, "left")
    return joined.select(*decoded.columns, "rel")


def messages(decoded: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Relation messages (tenant, rel_oid, seq, relation); those that were ``known`` come before all others."""
    said = decoded.filter(F.col("tag") == "R").select("tenant", "rel_oid", "seq", "relation")
    return said if known is None else said.unionByName(known.select("tenant", "rel_oid", F.lit(-(1 << 63)).alias("seq"), "relation"))


def named_cells(raw: Column, rel: Column) -> Column:
    """Cells by position with the relation's names and types; cells beyond its columns have no name and OID 0."""

    def name(c: Column, i: Column) -> Column:
        column = F.get(rel["columns"], i)
        return F.struct(
            F.coalesce(column["name"], F.lit("")).alias("name"), F.coalesce(column["type_oid"], F.lit(0).cast("bigint")).alias("type_oid"),
            (c["kind"] == "n").alias("is_null"), c["text"].alias("text"), (c["kind"] == "u").alias("unchanged"),
            (F.coalesce(column["flags"], F.lit(0)).bitwiseAND(1) == 1).alias("is_key"),
        )

    return F.transform(raw, name)


def current_relations(decoded: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The latest relation of each (tenant, rel_oid)."""
    return messages(decoded, known).groupBy("tenant", "rel_oid").agg(F.max_by("relation", "seq").alias("relation"))
