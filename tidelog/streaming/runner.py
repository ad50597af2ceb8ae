"""One streaming query per tenant source: assemble, enrich, write, confirm.

A micro-batch is written to a folder of its own number and then confirmed, so
that one that is run again after a failure replaces what it had written:
every change is in the journal once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators import checkpoint, journal, routing, sessions
from tidelog.operators.ordering import sequence_number
from tidelog.streaming import assembler


@dataclass
class StreamOptions:
    prefix: str = "CDCx"
    untracked: list[str] = field(default_factory=list)
    fallback: str = "asof"
    slot_prefix: str = "tidelog_slot_"
    frames: bool = False  # the input is decoded frames instead of log rows
    lsn_file: str = ""  # of a query over one tenant: where its position is kept as text
    partitions: int | None = None  # of the query's shuffles, fixed with its first batch; None: as the session's
    trigger: dict = field(default_factory=lambda: {"availableNow": True})


#: Tables of a micro-batch up to which each task writes a file for every one of them, without a shuffle.
FEW_TABLES = 16


def batch_rows(done: assembler.Assembled, session_rows: DataFrame | None, options: StreamOptions) -> DataFrame:
    """Journal rows of a micro-batch, not numbered yet."""
    own, data = routing.split(done.changes, options.prefix)
    context = routing.context_of(own)
    if own.isEmpty():
        context = context.limit(0)  # known to be empty, so that nothing is moved for its sake
    commits = done.transactions.filter(F.col("status") == "COMMITTED")
    return journal.change_rows(sessions.enrich(routing.tracked(data, options.untracked), context, session_rows, options.fallback, commits))


def start(log: DataFrame, path: str, state_dir: str, session_rows: DataFrame | None = None, options: StreamOptions | None = None) -> StreamingQuery:
    """Start the query that journals ``log``, a stream of log rows (or decoded frames), under ``path``."""
    options = options or StreamOptions()
    session, key, adaptive = log.sparkSession, "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"
    work, adapts = assembler.Assembler(f"{state_dir}/tidelog", options.frames), session.conf.get(adaptive)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spark.conf.set(adaptive, adapts)  # the query's own session may begin without
        done = work.assemble(batch, number)
        rows = batch_rows(done, session_rows, options)
        few = done.changes.select("tenant", "table_name").distinct().limit(FEW_TABLES + 1).count() <= FEW_TABLES
        journal.write_batch(rows, f"{path}/journal", number, clustered=few)
        ends = done.transactions.filter(F.col("status") == "COMMITTED").groupBy("tenant").agg(F.max("end_lsn").alias("lsn"))
        slots = ends.select(F.concat(F.lit(options.slot_prefix), "tenant").alias("SlotName"), "lsn", F.current_timestamp().alias("UpdatedAt"))
        checkpoint.save(spark, f"{path}/checkpoint", slots, number)
        if options.lsn_file and (lsn := ends.agg(F.max("lsn").alias("lsn")).first()["lsn"]) is not None:
            checkpoint.write_lsn(spark, options.lsn_file, lsn)
        done.counts.write.mode("overwrite").parquet(f"{path}/metrics/batch_id={number}")
        work.close(spark)

    writer = log.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", state_dir)
    before = session.conf.get(key)
    if options.partitions:
        session.conf.set(key, str(options.partitions))  # the query takes the setting along
    try:
        return writer.trigger(**options.trigger).start()
    finally:
        session.conf.set(key, before)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The streamed journal, numbered by table in log order."""
    return sequence_number(journal.read_journal(spark, f"{path}/journal"), ["tenant", "table_name"], "event_seq", "JournalID")


def counters(spark: SparkSession, path: str) -> DataFrame:
    """Counts of each tenant over all batches: transactions by outcome, changes, strays, frames that can't be decoded, changes of unknown relations."""
    rows = spark.read.option("basePath", f"{path}/metrics").parquet(f"{path}/metrics")
    return rows.groupBy("tenant", "status").agg(F.sum("n").alias("n"))
