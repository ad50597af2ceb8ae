"""Routing of changes: the session table's rows aside, untracked tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import config

#: Lists of names up to this length become a literal set, longer ones a join.
LITERAL_NAMES = 1000


def is_session_row(prefix: str = config.DEFAULT_PREFIX) -> Column:
    return (F.col("schema_name") == "public") & (F.col("table_name") == config.session_table(prefix))


def split(changes: DataFrame, prefix: str = config.DEFAULT_PREFIX) -> tuple[DataFrame, DataFrame]:
    """(session rows, all others)."""
    session = F.coalesce(is_session_row(prefix), F.lit(False))
    return changes.filter(session), changes.filter(~session)


def cell_text(row: Column, name: str) -> Column:
    """Text of the cell of that name, null if there is none or it is null."""
    found = F.filter(row, lambda c: (c["name"] == name) & ~c["is_null"])
    return F.get(found, 0)["text"]


def session_context(session_rows: DataFrame) -> DataFrame:
    """(tenant, begin_seq, user_id, app_name) that the session rows of each transaction leave.

    A delete's row is its old image. A later row overwrites an earlier one, but
    for its null cells.
    """
    row = F.when(F.col("tag") == "D", F.col("old")).otherwise(F.col("new"))
    return context_of(session_rows.select("tenant", "begin_seq", "seq", cell_text(row, "UserID").alias("UserID"), cell_text(row, "AppName").alias("AppName")))


def context_of(seen: DataFrame) -> DataFrame:
    """``session_context`` of rows that have their ``UserID`` and ``AppName`` as texts."""
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c]
    return seen.groupBy("tenant", "begin_seq").agg(latest("UserID").alias("user_id"), latest("AppName").alias("app_name"))


def tracked(changes: DataFrame, untracked: list[str] | DataFrame) -> DataFrame:
    """Changes of all tables but the named ones (unqualified, case-sensitive).

    ``untracked`` is a list or a DataFrame of (tenant, table_name).
    """
    if isinstance(untracked, DataFrame):
        return changes.join(untracked.select("tenant", "table_name").distinct(), ["tenant", "table_name"], "left_anti")
    if len(untracked) <= LITERAL_NAMES:
        return changes.filter(~F.col("table_name").isin(untracked)) if untracked else changes
    names = changes.sparkSession.createDataFrame([(n,) for n in untracked], "table_name string")
    return changes.join(names, "table_name", "left_anti")
