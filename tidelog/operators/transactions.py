"""Transaction assembly over control and change rows.

Input rows have tenant, seq (arrival order), tag (B, C or a change's I/U/D/T)
and, on control rows, xid, begin_lsn, commit_lsn, end_lsn and commit_ts. A
begin row opens a transaction and aborts one that is open; a commit row closes
it; changes outside of one are strays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.ordering import BUCKET, bucket, forward_fill

CHANGES, CONTROL = ["I", "U", "D", "T"], ["B", "C"]


def _last_control(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` plus ``_control``: (tag, seq) of the last control row before each."""
    mark = F.when(F.col("tag").isin(CONTROL), F.struct("tag", "seq"))
    return forward_fill(rows, ["tenant"], "seq", mark, "_control", inclusive=False, width=width)


def transactions(log: DataFrame, width: int = BUCKET, until: bool = False) -> DataFrame:
    """One row per begin, and per commit without one, with its status.

    COMMITTED, ABORTED (a later begin came first), OPEN (nothing came after) or
    COMMIT_WITHOUT_BEGIN. Only control rows are ordered: each is set beside its
    neighbours within a bucket, and the first and last of the buckets beside
    those of other buckets. With ``until``, ``until_seq`` says where the control
    row is that ends a transaction, be it a commit or another begin.
    """
    ends = ["commit_lsn", "end_lsn", "commit_ts"]
    control = log.filter(F.col("tag").isin(CONTROL)).select("tenant", "seq", "tag", "xid", "begin_lsn", *ends, bucket(F.col("seq"), width).alias("_bucket"))
    inner, outer = Window.partitionBy("tenant", "_bucket").orderBy("seq"), Window.partitionBy("tenant").orderBy("seq")
    before, after = F.struct("tag", "seq"), F.struct("tag", "seq", *ends)
    placed = control.withColumns({"_before": F.lag(before).over(inner), "_after": F.lead(after).over(inner)})
    edge = F.col("_before").isNull() | F.col("_after").isNull()
    edges = placed.filter(edge).withColumns({"_before": F.coalesce("_before", F.lag(before).over(outer)), "_after": F.coalesce("_after", F.lead(after).over(outer))})
    begin, closed = F.col("tag") == "B", F.col("_after.tag").eqNullSafe("C")
    status = F.when(~begin, "COMMIT_WITHOUT_BEGIN").when(closed, "COMMITTED").when(F.col("_after").isNull(), "OPEN").otherwise("ABORTED")
    end = lambda c: F.when(~begin, F.col(c)).when(closed, F.col(f"_after.{c}")).alias(c)
    kept = placed.filter(~edge).unionByName(edges).filter(begin | ~F.col("_before.tag").eqNullSafe("B"))
    return kept.select(
        "tenant", F.when(begin, F.col("seq")).alias("begin_seq"), F.when(~begin, F.col("seq")).when(closed, F.col("_after.seq")).alias("commit_seq"),
        F.when(begin, F.col("xid")).alias("xid"), F.when(begin, F.col("begin_lsn")).alias("begin_lsn"), *[end(c) for c in ends], status.alias("status"),
        *([F.when(begin, F.col("_after.seq")).alias("until_seq")] if until else []),
    )


def attach(log: DataFrame, width: int = BUCKET) -> DataFrame:
    """Change rows plus ``begin_seq`` of their transaction, null for strays."""
    placed = _last_control(log, width).filter(F.col("tag").isin(CHANGES))
    return placed.withColumn("begin_seq", F.when(F.col("_control.tag") == "B", F.col("_control.seq"))).drop("_control")


def strays(log: DataFrame, width: int = BUCKET) -> DataFrame:
    """Changes outside of any transaction, which are dropped."""
    return attach(log, width).filter(F.col("begin_seq").isNull()).drop("begin_seq")


def assemble(log: DataFrame, max_tx_bytes: int | None = None, width: int = BUCKET, known: DataFrame | None = None) -> DataFrame:
    """Changes of committed transactions with the transaction's columns.

    ``known`` are the log's ``transactions``, where they have been made already.

    ``max_tx_bytes``, off by default, drops the changes that come once a
    transaction's images hold that many bytes of text already.
    """
    committed = (transactions(log, width) if known is None else known).filter(F.col("status") == "COMMITTED").drop("status")
    changes = within(log, committed, width).drop("_bucket")
    if max_tx_bytes is not None:
        text = lambda row: F.aggregate(F.coalesce(F.col(row), F.array()), F.lit(0), lambda n, c: n + F.coalesce(F.octet_length(c["text"]), F.lit(0)))
        before = Window.partitionBy("tenant", "begin_seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        changes = changes.withColumn("_bytes", F.coalesce(F.sum(text("old") + text("new")).over(before), F.lit(0))).filter(F.col("_bytes") <= max_tx_bytes).drop("_bytes")
    return changes


def within(log: DataFrame, committed: DataFrame, width: int = BUCKET, strays: bool = False) -> DataFrame:
    """Changes of the log within the ``committed`` transactions, with all of these' columns, and ``_bucket``.

    A transaction puts a mark into every bucket that it reaches, so that one
    pass within buckets finds each change's transaction: rows are shuffled once
    and nothing is joined. Transactions of a tenant do not overlap, so a
    bucket's edge is crossed by one of them at most. With ``strays`` all other
    changes are kept too, with nulls for a transaction.
    """
    known = [c for c in committed.columns if c != "tenant"]
    changes = log.filter(F.col("tag").isin(CHANGES)).drop("xid", "begin_lsn", "commit_lsn", "end_lsn", "commit_ts").withColumns({"_bucket": bucket(F.col("seq"), width), "_order": F.col("seq")})
    reached = F.sequence(bucket(F.col("begin_seq"), width), bucket(F.col("commit_seq"), width))
    marks = committed.select("tenant", F.struct(*known).alias("_tx"), F.explode(reached).alias("_bucket")).withColumn("_order", F.greatest(F.col("_tx.begin_seq"), F.col("_bucket") * F.lit(width) - 1))
    both = changes.unionByName(marks, allowMissingColumns=True)
    in_bucket = Window.partitionBy("tenant", "_bucket").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    placed, inside = both.withColumn("_tx", F.last("_tx", True).over(in_bucket)), F.col("seq") < F.col("_tx.commit_seq")
    found = placed.filter(F.col("seq").isNotNull()).withColumn("_tx", F.when(inside, F.col("_tx"))) if strays else placed.filter(inside)
    return found.select(*[c for c in changes.columns if c not in ("_bucket", "_order")], *[F.col(f"_tx.{c}").alias(c) for c in known], "_bucket")


def nested(changes: DataFrame) -> DataFrame:
    """One row per committed transaction with its changes as an array in order."""
    item = F.struct(*[F.col(c) for c in ("seq", "tag", "schema_name", "table_name", "old", "new", "old_kind") if c in changes.columns])
    keys = ["tenant", "begin_seq", "commit_seq", "xid", "begin_lsn", "commit_lsn", "end_lsn", "commit_ts"]
    return changes.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("changes"))


def table_groups(changes: DataFrame, unqualified: bool = False) -> DataFrame:
    """The tables of each transaction in order of first appearance, with counts of each operation and their summary.

    ``unqualified`` merges tables of one name in several schemas.
    """
    name = F.col("table_name") if unqualified else F.concat_ws(".", "schema_name", "table_name")
    counts = [F.count_if(F.col("tag") == t).alias(a) for t, a in (("I", "n_insert"), ("U", "n_update"), ("D", "n_delete"), ("T", "n_truncate"))]
    grouped = changes.withColumn("table", name).groupBy("tenant", "begin_seq", "xid", "table").agg(F.min("seq").alias("first_seq"), *counts)
    part = lambda n, letter: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(letter)))
    parts = F.concat_ws("/", part("n_insert", "I"), part("n_update", "U"), part("n_delete", "D"), F.when(F.col("n_truncate") > 0, "T"))
    order = Window.partitionBy("tenant", "begin_seq").orderBy("first_seq")
    return grouped.withColumns({"position": F.row_number().over(order), "summary": F.concat(F.col("table"), F.lit("("), parts, F.lit(")"))})
