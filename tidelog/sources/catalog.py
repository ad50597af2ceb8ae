"""Scans of source catalogues and of the tenants' configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import config
from tidelog.operators.views import SourceColumn

SYSTEM_SCHEMAS = ["pg_catalog", "information_schema"]
CONFIG = [
    "ID", "Name", "DBHost", "DBHostPort", "DBName", "DBUser", "DBPassword", "DBCDCHost", "DBCDCHostPort", "DBCDCName", "DBCDCUser", "DBCDCPassword", "TablePrefix", "UntrackedTables",
]


def active_tenants(configs: DataFrame) -> DataFrame:
    """Configurations in force, by name. The filter and the columns reach the scan."""
    return configs.filter(F.col("State") == 1).select(*[c for c in CONFIG if c in configs.columns]).orderBy("Name")


def worker_configs(configs: DataFrame, prefix: str = config.DEFAULT_PREFIX) -> DataFrame:
    """A worker's settings from each configuration row; ``prefix`` is that of rows without one."""
    return configs.withColumns({
        "SlotName": config.slot_name(F.col("Name")), "TablePrefix": config.prefix_or_default(F.col("TablePrefix"), prefix), "DBHostPort": config.int_or_default(F.col("DBHostPort")),
        "DBCDCHostPort": config.int_or_default(F.col("DBCDCHostPort")), "Untracked": config.untracked_tables(F.col("UntrackedTables")),
    })


def slot_collisions(workers: DataFrame) -> DataFrame:
    """Slot names that more than one tenant would get."""
    return workers.groupBy("SlotName").agg(F.count(F.lit(1)).alias("tenants"), F.sort_array(F.collect_set("Name")).alias("names")).filter(F.col("tenants") > 1)


def publication_exists(publications: DataFrame, name: str) -> bool:
    return not publications.filter(F.col("pubname") == name).isEmpty()


def user_tables(tables: DataFrame) -> DataFrame:
    """Base tables outside the system's schemas, in order."""
    kept = tables.filter((F.col("table_type") == "BASE TABLE") & ~F.col("table_schema").isin(SYSTEM_SCHEMAS))
    return kept.select("table_schema", "table_name").orderBy("table_schema", "table_name")


def publication_tables(published: DataFrame, name: str, tables: DataFrame | None = None) -> DataFrame:
    """Tables of a publication in order; the user tables where it lists none."""
    found = published.filter(F.col("pubname") == name).select("tablename")
    if tables is not None and found.isEmpty():
        found = user_tables(tables).select(F.col("table_name").alias("tablename"))
    return found.orderBy("tablename")


def tables_without_full_identity(classes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Ordinary tables whose replica identity isn't full: an inner join of classes and namespaces."""
    ordinary = classes.filter((F.col("relkind") == "r") & (F.col("relreplident") != "f"))
    joined = ordinary.join(namespaces, ordinary["relnamespace"] == namespaces["oid"]).filter(~F.col("nspname").isin(SYSTEM_SCHEMAS))
    return joined.select("nspname", "relname").orderBy("nspname", "relname")


def tracked_tables(published: DataFrame, untracked: DataFrame) -> DataFrame:
    """Published tables without the untracked ones."""
    return published.join(untracked, "tablename", "left_anti")


def table_columns(columns: DataFrame, schema: str, table: str) -> list[SourceColumn]:
    """Columns of one table in order, for a typed view."""
    picked = columns.filter((F.col("table_schema") == schema) & (F.col("table_name") == table)).orderBy("ordinal_position")
    has = set(columns.columns)
    extra = [c for c in ("numeric_precision", "numeric_scale") if c in has]
    return [SourceColumn(r["column_name"], r["udt_name"], *(r[c] for c in extra)) for r in picked.select("column_name", "udt_name", *extra).collect()]  # one table's columns


def missing_journals(tables: DataFrame, journals: DataFrame) -> DataFrame:
    """Tables that have no journal yet."""
    return tables.join(journals, ["table_schema", "table_name"], "left_anti")
