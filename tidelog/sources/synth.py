"""A change log made from the order tables, by the same rule for every row.

Order k gives a transaction per step: 0 inserts the order and its lines, 1 (k a
multiple of 3) updates its status to X, 2 (k a multiple of 10) deletes it. All
numbers follow from k and the step, so nothing has to be ordered to be numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.delta import ROW, cell

TENANT, SPAN = "main", 1000
#: 1995-01-01 in microseconds, and six hours.
SESSION_START, SESSION_STEP = 788_918_400_000_000, 21_600_000_000
FIRST_XID, FIRST_LSN, LSN_STEP, END = 1000, 16_777_216, 4096, 48

LOG = [
    "tenant", "seq", "tag", "xid", "begin_lsn", "commit_lsn", "end_lsn", "commit_ts", "schema_name", "table_name", "old", "new", "old_kind",
]


def money(c: str) -> Column:
    return F.col(c).cast("decimal(15,2)").cast("string")


def order_row(status: Column) -> Column:
    return F.array(
        cell("o_orderkey", 20, F.col("o_orderkey").cast("string"), True), cell("o_custkey", 20, F.col("o_custkey").cast("string")), cell("o_orderstatus", 1042, status),
        cell("o_totalprice", 1700, money("o_totalprice")), cell("o_orderpriority", 25, F.col("o_orderpriority")),
    )


def line_row() -> Column:
    return F.array(
        cell("l_orderkey", 20, F.col("l_orderkey").cast("string"), True), cell("l_linenumber", 23, F.col("l_linenumber").cast("string"), True),
        cell("l_quantity", 1700, money("l_quantity")), cell("l_extendedprice", 1700, money("l_extendedprice")), cell("l_returnflag", 1042, F.col("l_returnflag")),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by step, with the transaction's number n, xid, LSNs and time."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    which = F.array_compact(F.array(F.lit(0), F.when(k % 3 == 0, 1), F.when(k % 10 == 0, 2)))
    n = F.col("n")
    return (
        orders.withColumn("step", F.explode(which))
        .withColumn("n", (k * 3 + F.col("step")).cast("bigint"))
        .withColumns({
            "tenant": F.lit(TENANT), "xid": n + FIRST_XID, "commit_lsn": n * LSN_STEP + FIRST_LSN, "end_lsn": n * LSN_STEP + FIRST_LSN + END,
            "commit_ts": (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.col("step"))),
        })
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control, order, line and session rows of the log (columns ``LOG``)."""
    at = steps(spark, sf_dir)
    none = F.lit(None).cast(ROW)
    k, step = F.col("o_orderkey"), F.col("step")
    before = F.when(step == 1, F.col("o_orderstatus")).otherwise(F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus")))
    lsns = {"begin_lsn": F.col("commit_lsn")}

    def rows(frame: DataFrame, offset: Column, tag: Column, schema: str | None, name: str | None, old: Column, new: Column, old_kind: Column) -> DataFrame:
        control = schema is None
        keep = lambda c, tags: F.when(tag.isin(tags), F.col(c)) if control else F.lit(None).cast(frame.schema[c].dataType)
        return frame.withColumns(lsns).select(
            "tenant", (F.col("n") * SPAN + offset).alias("seq"), tag.alias("tag"), "xid", F.when(tag == "B", F.col("commit_lsn")).alias("begin_lsn"), keep("commit_lsn", ["C"]).alias("commit_lsn"),
            keep("end_lsn", ["C"]).alias("end_lsn"), keep("commit_ts", ["C"]).alias("commit_ts"), F.lit(schema).alias("schema_name"), F.lit(name).alias("table_name"), old.alias("old"), new.alias("new"), old_kind.alias("old_kind"),
        )

    null_text = F.lit(None).cast("string")
    edges = at.withColumn("edge", F.explode(F.array(F.lit("B"), F.lit("C"))))
    control = rows(edges, F.when(F.col("edge") == "B", 0).otherwise(SPAN - 1), F.col("edge"), None, None, none, none, null_text)
    op = F.when(step == 0, "I").when(step == 1, "U").otherwise("D")
    order = rows(
        at, F.lit(1), op, "public", "orders", F.when(step > 0, order_row(before)), F.when(step < 2, order_row(F.when(step == 1, "X").otherwise(F.col("o_orderstatus")))), F.when(step > 0, "O")
    )
    session_row = F.array(
        cell("SessionID", 2950, F.format_string("s%d", F.col("xid")), True), cell("UserID", 2950, F.format_string("u%d", F.col("o_custkey") % 50)), cell("AppName", 1043, F.format_string("app%d", F.col("xid") % 7))
    )
    session = rows(at.filter(F.col("xid") % 4 != 0), F.lit(2), F.lit("I"), "public", "CDCxSession", none, session_row, null_text)
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("place", F.row_number().over(in_order))
    first = at.filter(step == 0).select("tenant", "n", "xid", "commit_lsn", "end_lsn", "commit_ts", "o_orderkey")
    line = rows(first.join(lines, F.col("o_orderkey") == F.col("l_orderkey")), F.col("place") + 10, F.lit("I"), "public", "lineitem", none, line_row(), null_text)
    return control.unionByName(order).unionByName(session).unionByName(line)


def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session table from the signup events: one row each, spread over the orders' years."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.filter(F.col("event_type") == "signup").select(
        F.lit(TENANT).alias("tenant"), F.col("event_id").cast("string").alias("SessionID"), F.col("user_id").cast("string").alias("UserID"), F.concat(F.lit("app"), (F.col("event_id") % 5).cast("string")).alias("AppName"),
        F.lit(0).alias("BackendPID"), F.timestamp_micros(F.lit(SESSION_START) + F.col("event_id") * SESSION_STEP).alias("Moment"),
    )


def event_log(spark: SparkSession, sf_dir: str, tenants: int = 10) -> DataFrame:
    """The events as a log with every irregularity: signups begin, purchases commit, all others are inserts."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    tag = F.when(F.col("event_type") == "signup", "B").when(F.col("event_type") == "purchase", "C").otherwise("I")
    lsn = F.col("event_id") * 16
    row = F.array(cell("event_id", 20, F.col("event_id").cast("string"), True), cell("event_type", 25, F.col("event_type")))
    return events.select(
        F.concat(F.lit("t"), (F.col("user_id") % tenants).cast("string")).alias("tenant"), F.col("event_id").alias("seq"), tag.alias("tag"), F.col("event_id").alias("xid"), lsn.alias("begin_lsn"),
        lsn.alias("commit_lsn"), (lsn + 8).alias("end_lsn"), F.col("ts").cast("timestamp").alias("commit_ts"), F.lit("public").alias("schema_name"), F.col("event_type").alias("table_name"),
        F.lit(None).cast(ROW).alias("old"), row.alias("new"), F.lit(None).cast("string").alias("old_kind"),
    )
