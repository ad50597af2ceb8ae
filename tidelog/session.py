"""Session construction with the settings the engine is designed for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold on a laptop and on a cluster alike; sizes of partitions
#: are left to adaptive execution.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "tidelog", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def local_session(cpus: int | str | None = None) -> SparkSession:
    """A ``local[n]`` session for tests and the benchmark."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return build_session(
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
