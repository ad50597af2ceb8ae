"""Transaction assembly over a stream, by the batch operators within each micro-batch.

A micro-batch is staged and assembled as a log is (``operators.transactions``),
so that a tenant's rows are the work of many tasks. What outlasts a batch is
kept in files under the query's own folder: the relations in force, the begin
of each tenant's open transaction, and in a folder a batch the changes that
belong to it. A transaction of any length may span any number of batches; its
changes are written once, are read again with its commit, and pass no driver.

Files are told by the number of their batch. One that is run again reads what
the batches before it left and replaces what it had written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import config, pgtypes
from tidelog.functions.delta import delta_json
from tidelog.operators import checkpoint, relations, routing, transactions
from tidelog.sources import pgoutput

KNOWN = f"tenant string, rel_oid long, relation {relations.RELATION}"
OPENED = "tenant string, seq long, xid long, begin_lsn long, first long"
#: Of a change its delta, and the cells that tell who made it where it is a session row; its images are not kept.
HELD = "tenant string, seq long, tag string, schema_name string, table_name string, Data string, UserID string, AppName string"
HELD_FIELDS = [c.split()[0] for c in HELD.split(", ")]
TX = ["begin_seq", "xid", "commit_lsn", "commit_ts"]


@dataclass
class Assembled:
    """What a micro-batch settles, read from its files."""

    transactions: DataFrame  # each that ended in it, and each commit without a begin, with its status
    changes: DataFrame  # of committed transactions, with ``TX``
    counts: DataFrame  # (tenant, status, n)


class Assembler:
    """Assembles the micro-batches of one query; ``folder`` holds what outlasts them."""

    def __init__(self, folder: str, frames: bool):
        self.folder, self.frames = folder, frames

    def assemble(self, batch: DataFrame, number: int) -> Assembled:
        spark = batch.sparkSession
        rows = self._work(batch, "rows")
        control, changes, errors = self._events(rows, number) if self.frames else self._log(rows)
        opened = self._read(spark, "opened", number, OPENED)
        first = opened.agg(F.min("first")).first()[0]
        # Places that the batch reaches; what was open before it begins just before them, wherever that was.
        reach = rows.groupBy("tenant").agg(F.min("seq").alias("_low"), F.max("seq").alias("_high"))
        same = F.col("tenant").eqNullSafe(F.col("_tenant"))
        if first is not None:
            near = reach.withColumnRenamed("tenant", "_tenant")
            opened = self._work(opened.join(near, same, "left").withColumn("place", F.coalesce(F.col("_low") - 1, "seq")).drop("_tenant", "_low", "_high"), "opened")
            begins = opened.select("tenant", F.col("place").alias("seq"), F.lit("B").alias("tag"), "xid", "begin_lsn")
            control = control.unionByName(begins, allowMissingColumns=True)
        found = self._work(transactions.transactions(control, until=True), "transactions")
        still = found.filter(F.col("status") == "OPEN")
        ended = found.filter(F.col("status") != "OPEN")
        span = ["tenant", *TX, "status"]
        spans = ended.filter(F.col("begin_seq").isNotNull()).select(*span, F.col("until_seq").alias("commit_seq"))
        there = still.join(reach.withColumnRenamed("tenant", "_tenant"), same).select(*span, (F.col("_high") + 1).alias("commit_seq"))
        placed = self._work(transactions.within(changes, spans.unionByName(there), strays=True).drop("commit_seq", "_bucket"), "changes")
        committed = placed.filter(F.col("status") == "COMMITTED").select(*HELD_FIELDS, *TX)
        if first is not None:
            since = opened.select(F.col("tenant").alias("_tenant"), F.col("place").alias("_place"), F.col("first").alias("_first"))
            done = ended.filter(F.col("status") == "COMMITTED").select("tenant", *TX)
            closed = done.join(since, same & (F.col("begin_seq") == F.col("_place"))).select("_tenant", "_first", *TX)  # one a tenant at most
            earlier = self._held(spark, first, number).join(F.broadcast(closed), same & (F.col("version") >= F.col("_first")))
            committed = committed.unionByName(earlier.select(*HELD_FIELDS, *TX))
        self._keep(number, still, opened if first is not None else None, placed)
        self._forget(spark, number if first is None else first)
        tally = lambda frame, status: frame.groupBy("tenant", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
        counts = tally(ended, F.col("status")).unionByName(tally(committed, F.lit("CHANGE"))).unionByName(tally(placed.filter(F.col("status").isNull()), F.lit("STRAY")))
        if errors is not None:
            counts = counts.unionByName(tally(errors, F.when(F.col("error") == "unknown relation", "UNKNOWN_RELATION").otherwise("PARSE_ERROR")))
        return Assembled(ended, committed, counts)

    def close(self, spark: SparkSession) -> None:
        """Delete what only the batch itself needed."""
        checkpoint.delete(spark, f"{self.folder}/work")

    def _log(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, None]:
        log = rows.withColumn("commit_ts", F.col("commit_ts").cast("timestamp"))
        return self._control(log), self._light(log), None

    def _events(self, rows: DataFrame, number: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(control rows, changes, errors) of decoded frames; the relations in force at their end are kept."""
        before = self._read(rows.sparkSession, "relations", number, KNOWN)
        if not rows.filter(F.col("tag") == "R").isEmpty():
            relations.current_relations(rows.filter(F.col("error").isNull()), before).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/relations/version={number}")
            checkpoint.prune(rows.sparkSession, f"{self.folder}/relations")
        log, errors = pgoutput.change_events(rows, relations_before=before)
        sound = rows.filter(F.col("error").isNull()).withColumn("commit_ts", F.when(F.col("tag") == "C", pgtypes.pg_timestamp(F.col("commit_us"))))
        return self._control(sound), self._light(log), errors

    @staticmethod
    def _control(log: DataFrame) -> DataFrame:
        return log.filter(F.col("tag").isin(transactions.CONTROL)).select("tenant", "seq", "tag", "xid", "begin_lsn", "commit_lsn", "end_lsn", "commit_ts")

    @staticmethod
    def _light(log: DataFrame) -> DataFrame:
        """Changes with ``HELD`` alone, so that images are neither moved nor kept."""
        row = F.when(F.col("tag") == "D", F.col("old")).otherwise(F.col("new"))
        named = F.col("table_name").endswith(config.session_table(""))  # whatever prefix is in force when it is committed
        who = {c: F.when(named, routing.cell_text(row, c)) for c in ("UserID", "AppName")}
        return log.withColumns(who | {"Data": delta_json(F.col("tag"), F.col("old"), F.col("new"), F.col("old_kind"))}).select(*HELD_FIELDS)

    def _keep(self, number: int, still: DataFrame, opened: DataFrame | None, placed: DataFrame) -> None:
        """Write the begins of the transactions that are open now, and their changes of this batch."""
        begins = still.select("tenant", F.col("begin_seq").alias("seq"), "xid", "begin_lsn", F.lit(number).cast("long").alias("first"))
        if opened is not None:
            was = opened.select(F.col("tenant").alias("_tenant"), F.col("place").alias("_place"), F.col("seq").alias("_seq"), F.col("first").alias("_first"))
            joined = begins.join(was, F.col("tenant").eqNullSafe(F.col("_tenant")) & (F.col("seq") == F.col("_place")), "left")
            begins = joined.select("tenant", F.coalesce("_seq", "seq").alias("seq"), "xid", "begin_lsn", F.coalesce("_first", "first").alias("first"))
        begins.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/opened/version={number}")
        checkpoint.prune(placed.sparkSession, f"{self.folder}/opened")
        placed.filter(F.col("status") == "OPEN").select(*HELD_FIELDS).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/held/version={number}")

    def _held(self, spark: SparkSession, first: int, number: int) -> DataFrame:
        """Changes that the batches from ``first`` on held back, with the number of theirs (``version``)."""
        paths = [f"{self.folder}/held/version={v}" for v in checkpoint.versions(spark, f"{self.folder}/held") if first <= v < number]
        return spark.read.schema(f"{HELD}, version long").option("basePath", f"{self.folder}/held").parquet(*paths)

    def _work(self, frame: DataFrame, name: str) -> DataFrame:
        """``frame`` computed once, read from files that hold until ``close``."""
        path = f"{self.folder}/work/{name}"
        frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return frame.sparkSession.read.schema(frame.schema).parquet(path)

    def _read(self, spark: SparkSession, name: str, number: int, schema: str) -> DataFrame:
        """What the latest batch before this one left; empty if none did."""
        found = [v for v in checkpoint.versions(spark, f"{self.folder}/{name}") if v < number]
        return spark.read.schema(schema).parquet(f"{self.folder}/{name}/version={found[-1]}") if found else spark.createDataFrame([], schema)

    def _forget(self, spark: SparkSession, first: int) -> None:
        """Delete changes held back before batch ``first``, the earliest that this batch, run again, would read."""
        for old in checkpoint.versions(spark, f"{self.folder}/held"):
            if old < first:
                checkpoint.delete(spark, f"{self.folder}/held/version={old}")
