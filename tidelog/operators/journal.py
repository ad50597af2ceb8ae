"""The journal: one row per change of a committed transaction, and its sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.config import quoted
from tidelog.functions.delta import ROW, delta_json
from tidelog.functions.lsn import format_lsn
from tidelog.operators.ordering import BUCKET, sequence_number

COLUMNS = ["XID", "LSN", "Operation", "Data", "UserID", "Origin", "CommittedAt", "CapturedAt"]
DDL = (
    "JournalID BIGINT, XID BIGINT, LSN STRING, Operation STRING, Data STRING, UserID STRING, Origin STRING, "
    "CommittedAt TIMESTAMP, CapturedAt TIMESTAMP, event_seq BIGINT, tenant STRING, table_name STRING"
)


def change_rows(changes: DataFrame, captured_at=None) -> DataFrame:
    """Journal rows of enriched changes, not numbered yet.

    The LSN is that of the commit for every row of a transaction; ``event_seq``
    keeps the change's own place in the log. Changes that have their delta as
    ``Data`` already keep it, and their ``_bucket`` stays with them.
    """
    old = F.col("old_kind") if "old_kind" in changes.columns else F.lit(None).cast("string")
    return changes.select(
        "tenant", "schema_name", "table_name", F.col("xid").cast("bigint").alias("XID"), format_lsn(F.col("commit_lsn")).alias("LSN"), F.col("tag").alias("Operation"),
        (F.col("Data") if "Data" in changes.columns else delta_json(F.col("tag"), F.col("old"), F.col("new"), old)).alias("Data"), F.col("user_id").alias("UserID"), F.col("app_name").alias("Origin"),
        F.col("commit_ts").cast("timestamp").alias("CommittedAt"), (F.current_timestamp() if captured_at is None else captured_at).alias("CapturedAt"), F.col("seq").alias("event_seq"), *[c for c in ("_bucket",) if c in changes.columns],
    )


def numbered(rows: DataFrame, width: int = BUCKET) -> DataFrame:
    """``rows`` numbered by write order within each tenant's table; they are read twice and best staged."""
    return sequence_number(rows, ["tenant", "table_name"], "event_seq", "JournalID", width=width)


def journal_rows(changes: DataFrame, captured_at=None, width: int = BUCKET) -> DataFrame:
    """Numbered journal rows of enriched changes."""
    return numbered(change_rows(changes, captured_at), width)


def create_journal(spark: SparkSession, database: str, table: str) -> None:
    """The journal as a table partitioned by tenant and source table, if it isn't there yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(database)}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(database)}.{quoted(table)} ({DDL}) USING parquet PARTITIONED BY (tenant, table_name)")


def write_batch(rows: DataFrame, path: str, batch_id: int, clustered: bool = False) -> None:
    """Write a batch into a folder of its own, replacing what an earlier attempt left there.

    That makes repeated batches harmless. Rows are clustered by their partition
    so that a task writes few files, with the rows of a hot table spread by
    commit order. Large rows of few tables that are read from files
    (``clustered``) need no shuffle: a task writes a file a table.
    """
    spread = rows if clustered else rows.repartition("tenant", "table_name", F.floor(F.col("event_seq") / F.lit(BUCKET)))
    spread.sortWithinPartitions("tenant", "table_name", "event_seq").write.mode("overwrite").option("compression", "zstd").partitionBy("tenant", "table_name").parquet(f"{path}/batch_id={batch_id}")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """All batches, each change once: the first batch that has it counts.

    Batches follow one another in the log, so that as a rule no change is in two
    of them and nothing has to be shuffled: one look at the batches' spans (a
    scan of ``event_seq`` alone) tells. Only rows within spans that overlap, after
    a replay under another number, are grouped.
    """
    rows = spark.read.option("basePath", path).parquet(path)
    spans = rows.groupBy("tenant", "batch_id").agg(F.min("event_seq").alias("low"), F.max("event_seq").alias("high"))
    before = Window.partitionBy("tenant").orderBy("low", "batch_id").rowsBetween(Window.unboundedPreceding, -1)
    common = spans.withColumn("reached", F.max("high").over(before)).filter(F.col("reached") >= F.col("low"))
    common = common.select(F.col("tenant").alias("_tenant"), F.col("low").alias("_low"), F.least("high", "reached").alias("_high"))
    if common.isEmpty():
        return rows.drop("batch_id")
    within = F.col("tenant").eqNullSafe(F.col("_tenant")) & F.col("event_seq").between(F.col("_low"), F.col("_high"))
    twice = rows.join(common, within, "left_semi")
    first = twice.groupBy("tenant", "event_seq").agg(F.min("batch_id").alias("batch_id"))
    kept = twice.join(first, ["tenant", "event_seq", "batch_id"], "left_semi")
    return rows.join(common, within, "left_anti").unionByName(kept).drop("batch_id")


def reconstruct(journal: DataFrame, key: str, upto=None) -> DataFrame:
    """Last known row state of every key as a map of column to JSON text (an extension: the journal replayed).

    ``key`` is a JSON field present in every delta of the table; deleted rows
    are left out. A delta without it is an error: as the delta of an update has
    only what changed, the key is in it only where the writer adds it (see
    ``reconstruct_changes``).
    """
    rows = journal if upto is None else journal.filter(F.col("CommittedAt") <= upto)
    rows = rows.filter(F.col("Data").isNotNull())  # an update that changed nothing
    found = F.get_json_object("Data", f"$.{key}")
    known = F.coalesce(found, F.raise_error(F.concat(F.lit(f"no {key} in the delta of change "), F.col("event_seq").cast("string"))).cast("string"))
    parsed = rows.withColumns({"_key": known, "_map": F.from_json("Data", "map<string,string>")})
    fields = parsed.select("tenant", "table_name", "_key", "event_seq", "Operation", F.explode_outer("_map").alias("field", "value"))
    latest = fields.groupBy("tenant", "table_name", "_key", "field").agg(F.max_by("value", "event_seq").alias("value"))
    state = latest.groupBy("tenant", "table_name", "_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("state"))
    last = parsed.groupBy("tenant", "table_name", "_key").agg(F.max_by("Operation", "event_seq").alias("_last"))
    return state.join(last, ["tenant", "table_name", "_key"]).filter(F.col("_last") != "D").drop("_last").withColumnRenamed("_key", key)


def reconstruct_changes(changes: DataFrame, key: str, upto=None) -> DataFrame:
    """Last known row state of every key as a map of column to text, from the images of committed changes.

    For changes as ``journal_rows`` takes them, whose deltas do not name the row
    they change. ``key`` is the column that identifies a row of the table. An
    update of the key ends the row of the old key; values that were not sent are
    the old image's, or else the last known ones of the same key (where a key
    changes and the old image is the key only, they are unknown and left out).
    """
    rows = changes if upto is None else changes.filter(F.col("commit_ts") <= upto)
    none = F.array().cast(ROW)
    of = lambda image: F.get(F.filter(F.coalesce(image, none), lambda c: (c["name"] == key) & ~c["unchanged"]), 0)["text"]
    sent = F.filter(F.coalesce("new", none), lambda c: ~c["unchanged"])
    unsent = F.transform(F.filter(F.coalesce("new", none), lambda c: c["unchanged"]), lambda c: c["name"])
    full = F.col("old_kind") == "O" if "old_kind" in changes.columns else F.lit(False)
    kept = F.when(full, F.filter(F.coalesce("old", none), lambda c: ~c["unchanged"] & F.array_contains(unsent, c["name"]))).otherwise(none)
    at = ["tenant", "schema_name", "table_name"]
    seen = rows.select(*at, "seq", "tag", of(F.col("old")).alias("_old"), F.coalesce(of(F.col("new")), of(F.col("old"))).alias("_new"), F.concat(sent, kept).alias("_cells"))
    ends = (F.col("tag") == "D") | (F.col("tag").eqNullSafe("U") & F.col("_old").isNotNull() & (F.col("_old") != F.col("_new")))
    moved = F.col("tag") == "U"
    # The last moment at which a key's row ended or began; what was known before does not count.
    gone = seen.filter(ends).select(*at, F.col("_old").alias("_key"), "seq", F.lit(True).alias("_gone"), none.alias("_cells"))
    fresh = F.when((F.col("tag") == "I") | (moved & ends), False)
    there = seen.filter(F.col("tag").isin("I", "U")).select(*at, F.col("_new").alias("_key"), "seq", fresh.alias("_gone"), "_cells")
    events = gone.unionByName(there)
    edges = events.filter(F.col("_gone").isNotNull()).groupBy(*at, "_key").agg(F.max("seq").alias("_edge"), F.max_by("_gone", "seq").alias("_gone"))
    fields = events.select(*at, "_key", "seq", F.explode("_cells").alias("cell"))
    since = fields.join(edges, [*at, "_key"], "left").filter(F.col("_edge").isNull() | (F.col("seq") > F.col("_edge")) | ((F.col("seq") == F.col("_edge")) & ~F.col("_gone")))
    value = F.struct(F.col("cell")["name"].alias("field"), F.when(~F.col("cell")["is_null"], F.col("cell")["text"]).alias("value"))
    latest = since.select(*at, "_key", "seq", value.alias("v")).groupBy(*at, "_key", F.col("v")["field"].alias("field")).agg(F.max_by("v", "seq")["value"].alias("value"))
    state = latest.groupBy(*at, "_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("state"))
    return state.withColumnRenamed("_key", key)
