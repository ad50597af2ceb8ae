"""The whole batch plan: from a change log to the journal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.delta import delta_json
from tidelog.operators import journal, routing, sessions, transactions
from tidelog.operators.ordering import number_across, number_in_bucket
from tidelog.sources import synth
from tidelog.sources.staging import ensure_folder, stage

#: Journals written by this process, by application and tables.
_STORED: dict[tuple[str, str], str] = {}


def enriched(log: DataFrame, session_rows: DataFrame | None = None, *, prefix: str = "CDCx", untracked: list[str] | DataFrame = (), fallback: str = "asof", deltas: bool = False) -> DataFrame:
    """Changes of committed transactions, without session rows and untracked tables, with who made them.

    The log is parted before anything is shuffled: session rows on one side,
    tracked changes on the other, control rows on both. Transactions are found
    on control rows, get their users, and are staged; the changes go through one
    ordered pass that brings each of them its transaction. With ``deltas`` a
    change's images are replaced by its delta (``Data``) before that pass, and
    ``_bucket`` stays.
    """
    control = F.col("tag").isin(transactions.CONTROL)
    session = F.coalesce(routing.is_session_row(prefix), F.lit(False))
    known = stage(transactions.transactions(log.filter(control)).filter(F.col("status") == "COMMITTED"))
    own = routing.session_context(transactions.assemble(log.filter(session), known=known))
    by_whom = stage(sessions.enrich_transactions(known.drop("status"), own, session_rows, fallback))
    data = log.filter(F.col("tag").isin(transactions.CHANGES) & ~session)
    if isinstance(untracked, DataFrame):
        data = routing.tracked(data, untracked).select(data.columns)
    elif untracked:
        data = data.filter(~F.col("table_name").isin(list(untracked)))
    if deltas:
        return transactions.within(data.withColumn("Data", delta_json(F.col("tag"), F.col("old"), F.col("new"), F.col("old_kind"))).drop("old", "new", "old_kind"), by_whom)
    return transactions.within(data, by_whom).drop("_bucket")


def journal_of(log: DataFrame, session_rows: DataFrame | None = None, captured_at=None, **options) -> DataFrame:
    """Journal rows of a log, numbered within the buckets they are ordered in and staged before they are numbered across them."""
    keys = ["tenant", "table_name"]
    rows = journal.change_rows(enriched(log, session_rows, deltas=True, **options), captured_at)
    return number_across(stage(number_in_bucket(rows, keys, "event_seq")), keys, "JournalID", broadcast=True)


def order_journal(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """The journal of the synthetic order log; captured when committed, so that results repeat."""
    return journal_of(synth.change_log(spark, sf_dir), synth.session_table(spark, sf_dir), captured_at=F.col("commit_ts").cast("timestamp"), **options)


def stored_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal of the synthetic order log as views read it: written once, partitioned by tenant and table, and scanned with pruning."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _STORED:
        path = f"{ensure_folder(spark)}/journal-{uuid.uuid4().hex}"
        journal.write_batch(order_journal(spark, sf_dir), path, 0, clustered=True)
        _STORED[at] = path
    return journal.read_journal(spark, _STORED[at])
