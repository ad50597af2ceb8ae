"""What a tenant's source needs before its stream is read."""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidelog.sources import admin

log = logging.getLogger("tidelog")


def published(spark: SparkSession, path: str, tenant: str) -> list[tuple[str, str]]:
    """(schema, table) of the tenant's tables as the table of (tenant, table_schema, table_name) at ``path`` lists them; none without one."""
    if not path:
        return []
    rows = spark.read.parquet(path).filter(F.col("tenant") == tenant).select("table_schema", "table_name").orderBy("table_schema", "table_name")
    return [(r["table_schema"], r["table_name"]) for r in rows.collect()]  # one tenant's catalogue


def statements(prefix: str, publication: str, tables: list[tuple[str, str]]) -> list[str]:
    """The session table, the publication of the listed tables or of all, and the tables' full identity."""
    return [admin.create_session_table(prefix), admin.create_publication(publication, tables or None), *admin.full_identity(tables)]


def prepare(client, prefix: str, publication: str, tables: list[tuple[str, str]]) -> int:
    """Run the statements; returns how many went through.

    One that fails, as where what it makes is there already, leaves the others.
    A client without ``execute`` has a source that needs no preparing.
    """
    if not hasattr(client, "execute"):
        return 0
    done = 0
    for statement in statements(prefix, publication, tables):
        try:
            client.execute(statement)
            done += 1
        except Exception as reason:
            log.warning("%s: %s", statement, reason)
    return done
