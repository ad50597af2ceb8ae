"""Latency, activity and health measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds (exclusive) of the latency buckets in microseconds, and what a bucket reports.
BOUNDS = [100, 500, 1000, 5000, 10000, 50000, 100000]
MIDPOINTS = [50, 300, 750, 3000, 7500, 30000, 75000, 200000]
STALE_SECONDS = 300


def latency_stats(samples: DataFrame, *keys: str) -> DataFrame:
    """Count, and min, max and integer average of capture, write and end-to-end times (capture_us, write_us)."""
    timed = samples.withColumn("e2e_us", F.col("capture_us") + F.col("write_us"))
    aggs = [F.count(F.lit(1)).alias("samples")]
    for m in ("capture", "write", "e2e"):
        c = F.col(f"{m}_us")
        aggs += [F.min(c).alias(f"{m}_min"), F.max(c).alias(f"{m}_max"), F.floor(F.sum(c) / F.count(c)).cast("bigint").alias(f"{m}_avg")]
    return timed.groupBy(*keys).agg(*aggs)


def bucket_of(us: Column) -> Column:
    """Index of a time's bucket."""
    found = F.lit(len(BOUNDS))
    for i in range(len(BOUNDS) - 1, -1, -1):
        found = F.when(us < BOUNDS[i], i).otherwise(found)
    return found.cast("int")


def histogram(samples: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, bucket, n) of the buckets that have samples."""
    return samples.groupBy(*keys, bucket_of(F.col(column)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def percentiles(samples: DataFrame, column: str, *keys: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles by bucket: the midpoint of the first one whose cumulated count reaches floor(n * share).

    All counts of a group fit in one row, so the samples are shuffled as partial
    counts only. A target of 0 gives the first bucket's midpoint.
    """
    counts = [F.count_if(bucket_of(F.col(column)) == i).alias(f"b{i}") for i in range(len(MIDPOINTS))]
    grouped = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), *counts)
    out = []
    for share in shares:
        target = F.floor(F.col("samples") * F.lit(share))
        found = F.lit(MIDPOINTS[-1])
        for i in range(len(MIDPOINTS) - 1, -1, -1):
            found = F.when(sum((F.col(f"b{k}") for k in range(1, i + 1)), F.col("b0")) >= target, MIDPOINTS[i]).otherwise(found)
        out.append(F.when(F.col("samples") == 0, 0).otherwise(found).cast("bigint").alias(f"p{round(share * 100)}"))
    return grouped.select(*keys, "samples", *out)


def report_windows(samples: DataFrame, ts: str, seconds: int = 60) -> DataFrame:
    """Latency statistics by tumbling window."""
    windowed = samples.withColumn("window_start", F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")["start"])
    return latency_stats(windowed, "window_start")


def stale(workers: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Streaming workers without activity for longer than ``seconds``, with the gap."""
    gap = F.unix_timestamp(now) - F.unix_timestamp(F.col("last_activity").cast("timestamp"))
    return workers.withColumn("idle_seconds", gap).filter((F.col("state") == "STREAMING") & (F.col("idle_seconds") > seconds))


def gaps(events: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """Rows that come more than ``seconds`` after the one before in their group."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts))
    return events.withColumn("gap_seconds", F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(before.cast("timestamp"))).filter(F.col("gap_seconds") > seconds)


def fleet_totals(workers: DataFrame) -> DataFrame:
    """Totals over all workers."""
    return workers.agg(F.count(F.lit(1)).alias("workers"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("transactions", "changes", "errors")])


def worker_counters(transactions: DataFrame, changes: DataFrame, errors: DataFrame) -> DataFrame:
    """Transactions by outcome, changes and errors of each tenant."""
    by_status = transactions.groupBy("tenant").agg(
        F.count_if(F.col("status") == "COMMITTED").alias("transactions"), F.count_if(F.col("status") == "ABORTED").alias("aborted"), F.count_if(F.col("status") == "OPEN").alias("open")
    )
    n_changes = changes.groupBy("tenant").agg(F.count(F.lit(1)).alias("changes"))
    n_errors = errors.groupBy("tenant").agg(F.count(F.lit(1)).alias("errors"))
    joined = by_status.join(n_changes, "tenant", "left").join(n_errors, "tenant", "left")
    return joined.fillna(0, ["changes", "errors"])


def writer_stats(journal: DataFrame) -> DataFrame:
    """Rows, bytes of payload and distinct batches of each table."""
    size = F.sum(F.coalesce(F.octet_length("Data"), F.lit(0)))
    return journal.groupBy("tenant", "table_name").agg(F.count(F.lit(1)).alias("rows"), size.cast("bigint").alias("bytes"), F.count_distinct("LSN").alias("batches"))


def transaction_bytes(changes: DataFrame) -> DataFrame:
    """Estimated bytes of each transaction's images."""
    text = lambda c: F.aggregate(F.coalesce(F.col(c), F.array()), F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(F.octet_length(x["text"]), F.lit(0)) + F.octet_length(x["name"]))
    return changes.groupBy("tenant", "begin_seq").agg(F.sum(text("old") + text("new")).alias("bytes"))
