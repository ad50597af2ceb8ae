"""Reading of the corpus tables and small helpers shared by the operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Keys that can each have more than one in so many of all rows.
HOT_SHARE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of ``sf_dir`` by Spark's own reader (any store Spark can reach)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a folder of our own only where none is set and all runs on one machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(folder or f"/tmp/checkpoints/{uuid.uuid4().hex}")


def release(session: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now, not at the driver's next collection of garbage."""
    gc.collect()
    session._jvm.System.gc()


def cut(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared checkpoint folder and continue from there.

    What was shuffled to make it is of no more use then, and released.
    """
    session = frame.sparkSession
    ensure_checkpoint_dir(session)
    done = frame.checkpoint(eager=True)
    del frame
    release(session)
    return done


def cut_with(frame: DataFrame, **totals: Column) -> tuple[DataFrame, dict]:
    """A cut ``frame`` and aggregates of its rows, from the one job that writes it."""
    seen = Observation()
    done = cut(frame.observe(seen, *[c.alias(n) for n, c in totals.items()]))
    return done, seen.get


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``groups``, which has one row a ``key`` with the number of its rows in ``size``.

    A key of more than one in ``HOT_SHARE`` of all ``total`` rows stays out of
    the shuffle: there are at most ``HOT_SHARE`` such keys, so that their groups
    can be broadcast whatever the size of the input. No other key is large.
    """
    limit = total // HOT_SHARE + 1
    hot, rest = F.broadcast(groups.filter(F.col(size) > limit)), groups.filter(F.col(size) <= limit)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest.hint("merge"), key))


def packed(frame: DataFrame, n: int, per_task: int = 50_000) -> DataFrame:
    """A cut ``frame`` of ``n`` rows in no more partitions than these are worth, so that small tables make few shuffle files."""
    return frame.coalesce(n // per_task + 1)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Working names that no column of the input has (case-insensitively)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
