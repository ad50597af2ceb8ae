"""Progress by log position: what is confirmed, where it is kept and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.lsn import format_lsn, parse_lsn

SCHEMA = "SlotName string, ConfirmedLSN string, UpdatedAt timestamp"


def confirmed(transactions: DataFrame) -> DataFrame:
    """(tenant, confirmed_lsn): the highest end of a committed transaction, empty ones included."""
    done = transactions.filter(F.col("status") == "COMMITTED")
    return done.groupBy("tenant").agg(F.max("end_lsn").alias("confirmed_lsn"))


def advance(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of ``new`` (SlotName, lsn, UpdatedAt) into ``stored``; a position never goes back."""
    before = stored.select("SlotName", parse_lsn(F.col("ConfirmedLSN")).alias("lsn"), "UpdatedAt")
    both = before.unionByName(new.select("SlotName", "lsn", "UpdatedAt"))
    top = both.groupBy("SlotName").agg(F.max("lsn").alias("lsn"), F.min_by("UpdatedAt", F.struct(-F.col("lsn"), "UpdatedAt")).alias("UpdatedAt"))
    return top.select("SlotName", format_lsn(F.col("lsn")).alias("ConfirmedLSN"), "UpdatedAt")


#: Older versions that are kept beside the one in force, for readers that have begun on them.
KEPT = 2


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that hold data, in order."""
    place, files = _folder(spark, path)
    if not files.exists(place):
        return []
    folders = [f.getPath() for f in files.listStatus(place) if f.getPath().getName().startswith("version=")]
    return sorted(int(f.getName().partition("=")[2]) for f in folders if any(x.getPath().getName().startswith("part-") for x in files.listStatus(f)))


def save(spark: SparkSession, path: str, new: DataFrame, version: int) -> None:
    """Write a version of the checkpoint table (versions are folders; the highest holds) from the one before.

    A version that is written again replaces itself and isn't read for it. Old
    versions are deleted.
    """
    advance(load(spark, path, version), new).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")
    prune(spark, path)


def prune(spark: SparkSession, path: str) -> None:
    """Delete versions but the latest and those kept beside it."""
    for old in versions(spark, path)[: -KEPT - 1]:
        delete(spark, f"{path}/version={old}")


def delete(spark: SparkSession, path: str) -> None:
    place, files = _folder(spark, path)
    files.delete(place, True)


def load(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The checkpoint table's latest version, or the latest before a number; empty if there is none."""
    found = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/version={found[-1]}") if found else spark.createDataFrame([], SCHEMA)


def gather(spark: SparkSession, paths: list[str], path: str) -> None:
    """Upsert the checkpoint tables of all tenants into the fleet's. Rows are one a tenant; only one writer at a time."""
    from functools import reduce

    if not paths:
        return
    rows = reduce(DataFrame.unionByName, [load(spark, p) for p in paths])
    save(spark, path, rows.select("SlotName", parse_lsn(F.col("ConfirmedLSN")).alias("lsn"), "UpdatedAt"), max(versions(spark, path), default=-1) + 1)


def write_lsn(spark: SparkSession, path: str, lsn: int) -> None:
    """The position as a line of text, for a start without the checkpoint table."""
    place, files = _folder(spark, path)
    out = files.create(place, True)
    try:
        out.write(bytearray(f"{lsn >> 32:X}/{lsn & 0xFFFFFFFF:08X}\n".encode()))
    finally:
        out.close()


def read_lsn(spark: SparkSession, path: str) -> str | None:
    """What ``write_lsn`` has written, or None."""
    place, files = _folder(spark, path)
    if not files.exists(place):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path).collect())  # one line


def resume_lsn(checkpoints: DataFrame, slot: str, fallback_text: str | None = None) -> int:
    """Position to start from: the checkpoint's, else the fallback file's first line, else 0."""
    row = checkpoints.filter(F.col("SlotName") == slot).select(parse_lsn(F.col("ConfirmedLSN")).alias("lsn")).first()
    if row and row["lsn"]:
        return row["lsn"]
    if fallback_text:
        high, slash, low = fallback_text.splitlines()[0].strip().partition("/")
        if slash:
            return int(high or "0", 16) << 32 | int(low or "0", 16)
    return 0
