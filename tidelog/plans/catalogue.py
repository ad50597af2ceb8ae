"""All queries of the engine by name, with their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import config, delta, pgtypes
from tidelog.functions.lsn import format_lsn, parse_lsn
from tidelog.operators import checkpoint, journal, metrics, routing, sessions, transactions, views
from tidelog.plans import control, journal_plan, oracle
from tidelog.sources import catalog, pgoutput, synth
from tidelog.sources.staging import ensure_folder, stage

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

ORDER_COLUMNS = [
    views.SourceColumn("o_orderkey", "int8"), views.SourceColumn("o_custkey", "int8"), views.SourceColumn("o_orderstatus", "bpchar"),
    views.SourceColumn("o_totalprice", "numeric", 15, 2), views.SourceColumn("o_orderpriority", "text"),
]


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracle.SQL.items() if name in _QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal activity by operation, read through the typed view."""
    return typed_view_agg(spark, sf_dir)


# --- positions and types ------------------------------------------------------


@query
def lsn_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.steps(spark, sf_dir).select("xid", format_lsn(F.col("commit_lsn") * 1000).alias("lsn"))


@query
def lsn_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsn_format(spark, sf_dir).select("xid", parse_lsn(F.col("lsn")).alias("lsn"))


@query
def type_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        "o_orderkey", pgtypes.format_pg_timestamp(k * 86_399_999_999 + k).alias("ts"), pgtypes.format_pg_date(k).alias("day"), pgtypes.bytea_text(F.encode("o_orderpriority", "UTF-8")).alias("bytes")
    )


@query
def json_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", delta.json_string(F.col("text")).alias("quoted"))


# --- transactions -------------------------------------------------------------


@query
def tx_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = transactions.assemble(synth.change_log(spark, sf_dir))
    keys = ["xid", "begin_seq", "commit_seq", "commit_lsn", "end_lsn", "commit_ts"]
    return changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_changes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query
def tx_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.transactions(synth.event_log(spark, sf_dir)).select("tenant", "begin_seq", "commit_seq", "xid", "end_lsn", "status")


@query
def tx_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.assemble(synth.event_log(spark, sf_dir)).select("tenant", "seq", "begin_seq", "commit_seq")


@query
def stray_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.strays(synth.event_log(spark, sf_dir)).select("tenant", "seq", "table_name")


@query
def tx_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, data = routing.split(transactions.assemble(synth.change_log(spark, sf_dir)))
    return transactions.table_groups(data).select("xid", "table", "position", "n_insert", "n_update", "n_delete", "summary")


# --- deltas -------------------------------------------------------------------


def _deltas(spark: SparkSession, sf_dir: str, tag: str) -> DataFrame:
    _, data = routing.split(synth.change_log(spark, sf_dir).filter(F.col("tag") == tag))
    return data.select("seq", delta.delta_json(F.col("tag"), F.col("old"), F.col("new"), F.col("old_kind")).alias("delta"))


@query
def delta_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir, "I")


@query
def delta_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir, "U")


@query
def delta_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir, "D")


@query
def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = synth.change_log(spark, sf_dir).filter(F.col("tag") == "U")
    return updates.select("seq", F.inline(delta.field_changes(F.col("tag"), F.col("old"), F.col("new"))))


# --- sessions and routing -----------------------------------------------------


@query
def session_instream(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = synth.change_log(spark, sf_dir)
    own, _ = routing.split(transactions.assemble(log.filter(F.col("tag").isin(transactions.CONTROL) | F.coalesce(routing.is_session_row(), F.lit(False)))))
    return routing.session_context(own).select("begin_seq", "user_id", "app_name")


@query
def session_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.latest_session(synth.session_table(spark, sf_dir))


@query
def session_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = synth.steps(spark, sf_dir).select("tenant", (F.col("n") * synth.SPAN).alias("begin_seq"), "commit_ts")
    found = sessions.asof_session(done, synth.session_table(spark, sf_dir))
    return found.select("begin_seq", "session.user_id", "session.app_name")


@query
def session_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal_plan.enriched(synth.change_log(spark, sf_dir), synth.session_table(spark, sf_dir)).select("seq", "user_id", "app_name")


@query
def untracked_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = journal_plan.enriched(synth.change_log(spark, sf_dir), untracked=["lineitem"], fallback="none")
    return done.select("seq", "table_name")


# --- journal and views --------------------------------------------------------


@query
def journal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal_plan.order_journal(spark, sf_dir)


@query
def typed_view_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = journal_plan.stored_journal(spark, sf_dir).filter(F.col("table_name") == "orders")
    view = views.typed_view(rows, ORDER_COLUMNS)
    return view.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query
def typed_view_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = journal_plan.stored_journal(spark, sf_dir).filter(F.col("table_name") == "orders")
    view = views.typed_view(rows, ORDER_COLUMNS)
    return view.groupBy(F.col("CDCxOperation").alias("op")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").cast("double").alias("total"))


@query
def op_counts_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = journal_plan.stored_journal(spark, sf_dir)
    return rows.groupBy(F.date_format("CommittedAt", "yyyy-MM-dd").alias("day"), F.col("Operation").alias("op")).agg(F.count(F.lit(1)).alias("n"))


@query
def journal_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = journal_plan.stored_journal(spark, sf_dir)
    return rows.groupBy(F.col("UserID").alias("user_id"), "table_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("XID").alias("transactions"), F.min("LSN").alias("first_lsn"))


@query
def writer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.writer_stats(journal_plan.stored_journal(spark, sf_dir))


@query
def state_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every live order as its last change left it, from all changes of the log."""
    log = synth.change_log(spark, sf_dir)
    data = transactions.assemble(log.filter(F.col("tag").isin(transactions.CONTROL) | (F.col("table_name") == "orders")))
    state = journal.reconstruct_changes(data.filter(F.col("table_name") == "orders"), "o_orderkey")
    return state.select("o_orderkey", F.col("state")["o_orderstatus"].alias("status"), F.col("state")["o_totalprice"].cast("decimal(15,2)").cast("string").alias("price"))


# --- progress and metrics -----------------------------------------------------


@query
def checkpoint_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint.confirmed(transactions.transactions(synth.event_log(spark, sf_dir)))


@query
def checkpoint_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = checkpoint_max(spark, sf_dir).select(F.col("tenant").alias("SlotName"), F.col("confirmed_lsn").alias("lsn"), F.lit("2024-02-01").cast("timestamp").alias("UpdatedAt"))
    stored = now.select("SlotName", format_lsn(F.lit(100_000).cast("bigint")).alias("ConfirmedLSN"), F.lit("2024-01-01").cast("timestamp").alias("UpdatedAt"))
    return checkpoint.advance(stored, now).select("SlotName", "ConfirmedLSN")


@query
def worker_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = synth.event_log(spark, sf_dir)
    return metrics.worker_counters(transactions.transactions(log), transactions.assemble(log), transactions.strays(log))


def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select((F.col("user_id") % 10).alias("worker"), "ts", F.floor(F.col("value") * 700).cast("bigint").alias("capture_us"), (F.col("event_id") % 977).cast("bigint").alias("write_us"))


@query
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_stats(_latency(spark, sf_dir), "worker")


@query
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(_latency(spark, sf_dir), "capture_us", "worker")


@query
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(_latency(spark, sf_dir), "capture_us", "worker")


@query
def report_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report_windows(_latency(spark, sf_dir), "ts", 3600)


@query
def fleet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    workers = events.groupBy((F.col("user_id") % 10).alias("worker")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("transactions"), F.count(F.lit(1)).alias("changes"), F.count_if(F.col("event_type") == "error").alias("errors")
    )
    return metrics.fleet_totals(workers)


@query
def stale_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    workers = events.groupBy(F.col("user_id").alias("worker")).agg(F.max("ts").alias("last_activity")).withColumn("state", F.lit("STREAMING"))
    return metrics.stale(workers, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("worker", "state", "idle_seconds")


@query
def events_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each user's event type, as an update feed."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select("event_id", "user_id", before.alias("old_type"), F.col("event_type").alias("new_type")).filter(~F.col("old_type").eqNullSafe(F.col("new_type")))


# --- control plane and catalogues ---------------------------------------------


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    t = F.concat(F.lit("T"), (k % 3).cast("string"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("ID"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("Name"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("P"), (k % 3).cast("string"))).alias("TablePrefix"),
        F.when(k % 5 == 0, "bad").otherwise((k + 5000).cast("string")).alias("DBHostPort"), F.lit("6000").alias("DBCDCHostPort"), F.concat(t, F.lit("; U ;;"), t).alias("UntrackedTables"),
        F.when(k % 2 == 0, 1).otherwise(0).alias("State"),
    )


@query
def active_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.active_tenants(_configs(spark, sf_dir)).select(F.col("ID").alias("id"), F.col("Name").alias("name"))


@query
def slot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _configs(spark, sf_dir).select(F.col("ID").alias("id"), config.slot_name(F.col("Name")).alias("slot"))


@query
def worker_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = catalog.worker_configs(_configs(spark, sf_dir))
    return done.select(F.col("ID").alias("id"), F.col("TablePrefix").alias("prefix"), F.col("DBHostPort").alias("port"), F.array_join("Untracked", ",").alias("untracked"))


@query
def tenant_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = spark.read.parquet(f"{sf_dir}/customer.parquet").filter(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").alias("id"))
    return control.reconcile(active_tenants(spark, sf_dir), running)


@query
def backoff_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = F.col("n_nationkey").cast("bigint")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(failures.alias("failures"), config.backoff(failures).alias("delay_ms"))


@query
def identity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    classes = nation.select(F.col("n_name").alias("relname"), F.col("n_regionkey").alias("relnamespace"), F.lit("r").alias("relkind"), F.when(F.col("n_nationkey") % 3 == 0, "f").otherwise("d").alias("relreplident"))
    return catalog.tables_without_full_identity(classes, region.select(F.col("r_regionkey").alias("oid"), F.col("r_name").alias("nspname")))


@query
def publication_minus_untracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    published = nation.select(F.when(F.col("n_nationkey") % 4 == 1, "other").otherwise("all").alias("pubname"), F.col("n_name").alias("tablename"))
    untracked = nation.filter(F.col("n_regionkey") == 2).select(F.col("n_name").alias("tablename"))
    return catalog.tracked_tables(catalog.publication_tables(published, "all"), untracked)


# --- frames -------------------------------------------------------------------


def _spread_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders dealt out to all tasks: few files of compressed columns become many frames."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").repartition("o_orderkey")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inserts of all orders as protocol frames, made by expressions."""
    columns = [("o_orderkey", 20, True), ("o_custkey", 20, False), ("o_orderstatus", 1042, False), ("o_orderpriority", 25, False)]
    relation = spark.createDataFrame([(-1, bytearray(pgoutput.encode_relation(7, "public", "orders", columns)))], "seq long, payload binary")
    orders = _spread_orders(spark, sf_dir)
    b, letter = pgoutput.big_endian, lambda s: F.encode(F.lit(s), "UTF-8")
    k = F.col("o_orderkey")
    lsn, time = k * 4096 + 16_777_216, k * 1_000_000
    tuple_ = F.concat(b(F.lit(len(columns)), 2), *[pgoutput.text_cell(F.col(c)) for c, _, _ in columns])
    messages = F.array(
        F.struct((k * 3 - 1 + 1).alias("seq"), F.concat(letter("B"), b(lsn, 8), b(time, 8), b(k + 1000, 4)).alias("payload")),
        F.struct((k * 3 + 1).alias("seq"), F.concat(letter("I"), b(F.lit(7), 4), letter("N"), tuple_).alias("payload")),
        F.struct((k * 3 + 2).alias("seq"), F.concat(letter("C"), b(F.lit(0), 1), b(lsn, 8), b(lsn + 48, 8), b(time, 8)).alias("payload")),
    )
    return relation.unionByName(orders.select(F.inline(messages))).withColumn("tenant", F.lit(synth.TENANT))


@query
def pgoutput_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pgoutput.decode(_frames(spark, sf_dir)).filter(F.col("error").isNull()).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query
def pgoutput_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = pgoutput.change_events(stage(pgoutput.decode(_frames(spark, sf_dir))))
    shown = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    texts = log.select("tenant", "seq", "tag", "xid", "begin_lsn", "commit_lsn", "end_lsn", "commit_ts", *[routing.cell_text(F.col("new"), c).alias(c) for c in shown])
    return transactions.assemble(texts).select(F.col("begin_seq").alias("seq"), *shown)


@query
def demux_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and bodies of data envelopes and keepalives."""
    k, b = F.col("o_orderkey"), pgoutput.big_endian
    letter = lambda s: F.encode(F.lit(s), "UTF-8")
    data = F.concat(letter("w"), b(k, 8), b(k + 10, 8), b(k * 1000, 8), F.encode("o_orderpriority", "UTF-8"))
    alive = F.concat(letter("k"), b(k + 10, 8), b(k * 1000, 8), b(k % 2, 1))
    frames = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(synth.TENANT).alias("tenant"), k.alias("seq"), F.when(k % 5 == 0, alive).otherwise(data).alias("payload"))
    return pgoutput.demux(frames).select("seq", "kind", "data_start", "wal_end", "reply", F.decode("payload", "UTF-8").alias("body"))


@query
def binary_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows sent with binary cells: their texts by type."""
    columns = [("k", 20, True), ("c", 23, False), ("day", 1082, False), ("ts", 1114, False), ("ok", 16, False), ("p", 25, False)]
    relation = spark.createDataFrame([(-1, bytearray(pgoutput.encode_relation(9, "public", "b", columns)))], "seq long, payload binary")
    k, b = F.col("o_orderkey"), pgoutput.big_endian
    letter = lambda s: F.encode(F.lit(s), "UTF-8")
    cell = lambda data: F.concat(letter("b"), b(F.length(data), 4), data)
    cells = F.concat(cell(b(k, 8)), cell(b(F.col("o_custkey"), 4)), cell(b(k, 4)), cell(b(k * 1_000_000, 8)), cell(b(k % 2, 1)), cell(F.encode("o_orderpriority", "UTF-8")))
    rows = _spread_orders(spark, sf_dir).select(k.alias("seq"), F.concat(letter("I"), b(F.lit(9), 4), letter("N"), b(F.lit(len(columns)), 2), cells).alias("payload"))
    log, _ = pgoutput.change_events(stage(pgoutput.decode(relation.unionByName(rows).withColumn("tenant", F.lit(synth.TENANT)))))
    return log.select("seq", *[routing.cell_text(F.col("new"), c).alias(c) for c, _, _ in columns])


@query
def pgoutput_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of change message, ignored and broken frames and an unknown relation, by the order's key."""
    columns = [("o_orderkey", 20, True), ("o_custkey", 20, False), ("o_orderstatus", 1042, False), ("o_orderpriority", 25, False)]
    relations = [(-2, bytearray(pgoutput.encode_relation(7, "public", "orders", columns))), (-1, bytearray(pgoutput.encode_relation(8, "public", "notes", [("note", 25, True)])))]
    k, b, letter = F.col("o_orderkey"), pgoutput.big_endian, lambda s: F.encode(F.lit(s), "UTF-8")
    cells = lambda *of: F.concat(b(F.lit(len(of)), 2), *of)
    key, absent, unsent = pgoutput.text_cell(k), letter("n"), letter("u")
    full = cells(*[pgoutput.text_cell(F.col(c)) for c, _, _ in columns])
    closed = cells(key, pgoutput.text_cell(F.col("o_custkey")), pgoutput.text_cell(F.lit("X")), absent)
    head = lambda tag, oid=7: F.concat(letter(tag), b(F.lit(oid), 4))
    kinds = [
        F.concat(head("I"), letter("N"), full), F.concat(head("U"), letter("K"), cells(key, absent, absent, absent), letter("N"), cells(key, unsent, pgoutput.text_cell(F.lit("Y")), unsent)),
        F.concat(head("U"), letter("O"), full, letter("N"), closed), F.concat(head("D"), letter("K"), cells(key, absent, absent, absent)),
        F.concat(letter("T"), b(F.lit(2), 4), b(F.lit(0), 1), b(F.lit(7), 4), b(F.lit(8), 4)), F.concat(letter("M"), b(k, 8)), head("I"), F.concat(head("I", 99), letter("N"), full),
    ]
    orders = _spread_orders(spark, sf_dir)
    frames = orders.select(k.alias("seq"), F.get(F.array(*kinds), (k % 8).cast("int")).alias("payload"))
    frames = spark.createDataFrame(relations, "seq long, payload binary").unionByName(frames).withColumn("tenant", F.lit(synth.TENANT))
    log, errors = pgoutput.change_events(stage(pgoutput.decode(frames)))
    count = lambda test: F.size(F.filter(F.coalesce("new", F.array().cast(delta.ROW)), test)).cast("bigint")
    found = log.select(
        "seq", "tag", "table_name", "old_kind", routing.cell_text(F.col("old"), "o_orderkey").alias("old_key"), routing.cell_text(F.col("new"), "o_orderstatus").alias("status"),
        count(lambda c: c["unchanged"]).alias("unchanged"), count(lambda c: c["is_null"]).alias("nulls"), F.lit(None).cast("string").alias("error"),
    )
    return found.unionByName(errors.select("seq", "tag", "error"), allowMissingColumns=True)


@query
def binary_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary cells of the types that numbers, identifiers, times and documents have."""
    k, b = F.col("o_orderkey"), pgoutput.big_endian
    one_of = lambda *values: F.unhex(F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int")))
    numeric = F.concat(b(F.lit(3), 2), b(F.lit(1), 2), b(F.when(k % 2 == 1, 0x4000).otherwise(0), 2), b(F.lit(2), 2), b(F.floor(k / 10_000), 2), b(k % 10_000, 2), b(k % 100 * 100, 2))
    micros = (k % 86_400) * 1_000_000 + F.when(k % 3 == 0, 0).otherwise(5)
    made = [
        ("f4", 700, one_of("3FC00000", "BE800000", "7FC00000", "FF800000")), ("f8", 701, one_of("3FF8000000000000", "BFD0000000000000", "7FF8000000000000", "7FF0000000000000")),
        ("num", 1700, numeric), ("id", 2950, F.unhex(F.md5(F.encode(k.cast("string"), "UTF-8")))), ("t", 1083, b(micros, 8)), ("doc", 3802, F.concat(b(F.lit(1), 1), F.encode(F.format_string('{"k":%d}', k), "UTF-8"))),
        ("js", 114, F.encode(F.format_string("[%d]", k), "UTF-8")), ("i2", 21, b(k % 32_768, 2)), ("o", 26, b(k + 3_000_000_000, 4)), ("raw", 17, b(k, 4)), ("at", 1184, b(k * 1_000_000, 8)),
    ]
    letter = lambda s: F.encode(F.lit(s), "UTF-8")
    cells = F.concat(*[F.concat(letter("b"), b(F.length(data), 4), data) for _, _, data in made])
    rows = _spread_orders(spark, sf_dir).select(k.alias("seq"), F.concat(letter("I"), b(F.lit(9), 4), letter("N"), b(F.lit(len(made)), 2), cells).alias("payload"))
    relation = spark.createDataFrame([(-1, bytearray(pgoutput.encode_relation(9, "public", "b", [(n, oid, n == "num") for n, oid, _ in made])))], "seq long, payload binary")
    log, _ = pgoutput.change_events(stage(pgoutput.decode(relation.unionByName(rows).withColumn("tenant", F.lit(synth.TENANT)))))
    return log.select("seq", *[routing.cell_text(F.col("new"), c).alias(c) for c, _, _ in made])


@query
def delta_key_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates whose old image has the key only: the key is compared, all else counts as changed."""
    updates = synth.change_log(spark, sf_dir).filter(F.col("tag") == "U")
    return updates.select("seq", delta.delta_json(F.col("tag"), F.col("old"), F.col("new"), F.lit("K")).alias("delta"))


@query
def tx_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as rows with their changes in order."""
    done = transactions.nested(transactions.assemble(synth.change_log(spark, sf_dir).drop("old", "new", "old_kind")))
    return done.select("xid", F.array_join(F.transform("changes", lambda c: F.concat(c["tag"], F.lit(":"), c["table_name"])), ",").alias("changes"))


@query
def missing_journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    tables = nation.select(F.when(F.col("n_regionkey") == 4, "pg_catalog").otherwise("public").alias("table_schema"), F.col("n_name").alias("table_name"), F.when(F.col("n_nationkey") % 6 == 5, "VIEW").otherwise("BASE TABLE").alias("table_type"))
    known = nation.filter(F.col("n_nationkey") % 3 == 0).select(F.lit("public").alias("table_schema"), F.col("n_name").alias("table_name"))
    return catalog.missing_journals(catalog.user_tables(tables), known)


@query
def changed_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants whose settings have changed since their worker was started."""
    now = catalog.worker_configs(_configs(spark, sf_dir)).withColumnRenamed("ID", "id")
    before = now.withColumn("DBHostPort", F.when(F.col("id") % 7 == 0, F.lit(1)).otherwise(F.col("DBHostPort")))
    return control.changed_configs(before, now, ["DBHostPort", "TablePrefix"])


@query
def slot_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments as tenant names, in spellings that sanitise alike."""
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("Name")).distinct()
    return catalog.slot_collisions(names.withColumn("SlotName", config.slot_name(F.col("Name")))).select("SlotName", "tenants")


@query
def transaction_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, data = routing.split(transactions.assemble(stage(synth.event_log(spark, sf_dir))))
    return metrics.transaction_bytes(data).select("tenant", "begin_seq", "bytes")


@query
def stream_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order frames through the streaming pipeline, read back from its journal."""
    from tidelog.streaming import runner

    frames = _frames(spark, sf_dir)
    folder = f"{ensure_folder(spark)}/stream-{uuid.uuid4().hex}"
    frames.write.option("compression", "zstd").parquet(f"{folder}/in")
    stream = spark.readStream.schema(frames.schema).parquet(f"{folder}/in")
    done = runner.start(pgoutput.decode(stream), f"{folder}/out", f"{folder}/state", options=runner.StreamOptions(frames=True, fallback="none"))
    done.awaitTermination()
    return runner.read(spark, f"{folder}/out").select("JournalID", "XID", "LSN", "Operation", "Data", "table_name")
