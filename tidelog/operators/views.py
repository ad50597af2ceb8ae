"""Typed views over a journal: JSON deltas as columns of the source table's types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.config import DEFAULT_PREFIX, quoted
from tidelog.functions.pgtypes import view_type

AUDIT = ["JournalID", "XID", "LSN", "Operation", "UserID", "Origin", "CommittedAt", "CapturedAt"]


@dataclass(frozen=True)
class SourceColumn:
    name: str
    udt: str
    precision: int | None = None
    scale: int | None = None


def typed_view(journal: DataFrame, columns: list[SourceColumn], prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Source columns by name with their types, then the audit columns with the prefix.

    Values are read from the JSON as text in one pass and cast with ``try_cast``,
    so that what the type can't hold becomes null instead of failing the query.
    Numbers go through a decimal of full precision.
    """
    ddl = ", ".join(f"{quoted(c.name)} {_parsed(c)}" for c in columns)
    parsed = journal.withColumn("_row", F.from_json("Data", ddl))
    cells = [F.col("_row")[c.name].try_cast(view_type(c.udt, c.precision, c.scale)).alias(c.name) if c.udt != "money" else _money(F.col("_row")[c.name]).alias(c.name) for c in columns]
    return parsed.select(*cells, *[F.col(a).alias(f"{prefix}{a}") for a in AUDIT])


def _parsed(c: SourceColumn) -> str:
    kind = view_type(c.udt, c.precision, c.scale)
    return kind if kind in ("boolean", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") and c.udt != "money" else "string"


def _money(text):
    return F.regexp_replace(text, r"[$,]", "").try_cast("decimal(19,2)")


def create_view(journal: DataFrame, name: str, columns: list[SourceColumn], prefix: str = DEFAULT_PREFIX) -> bool:
    """Create or replace the temporary view of a table; False where it has no columns."""
    if not columns:
        return False
    typed_view(journal, columns, prefix).createOrReplaceTempView(name)
    return True
