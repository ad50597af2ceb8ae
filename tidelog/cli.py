"""Command line: defaults, then the environment, then flags."""

from __future__ import annotations

import argparse
import logging
import logging.handlers
import os
import signal
import sys

from tidelog import __version__
from tidelog.functions.config import LOG_LEVELS, parse_log_level, redacted

#: Shuffle partitions of a tenant's query: its batches have at most ``maxFrames`` rows.
TENANT_PARTITIONS = 4
EXIT_OK, EXIT_CONFIG, EXIT_CONNECT, EXIT_FATAL = 0, 1, 2, 99
LOG_BYTES, LOG_FILES = 100 << 20, 10
#: (flag, environment variable, default, kind)
OPTIONS = [
    ("journal", "TIDELOG_JOURNAL", "journal", str), ("state", "TIDELOG_STATE", "state", str), ("tenants", "TIDELOG_TENANTS", "", str), ("max-workers", "TIDELOG_MAX_WORKERS", 64, int),
    ("sessions", "TIDELOG_SESSIONS", "", str), ("session-fallback", "TIDELOG_SESSION_FALLBACK", "asof", str), ("client", "TIDELOG_CLIENT", "tidelog.streaming.source:FileClient", str),
    ("published", "TIDELOG_PUBLISHED", "", str), ("poll-seconds", "TIDELOG_POLL_SECONDS", 30, int), ("health-seconds", "TIDELOG_HEALTH_SECONDS", 10, int), ("base-delay-ms", "TIDELOG_BASE_DELAY_MS", 500, int),
    ("max-delay-ms", "TIDELOG_MAX_DELAY_MS", 60_000, int), ("max-retries", "TIDELOG_MAX_RETRIES", -1, int), ("prefix", "TIDELOG_PREFIX", "CDCx", str),
    ("log-level", "TIDELOG_LOG_LEVEL", "info", str), ("log-file", "TIDELOG_LOG_FILE", "", str), ("password", "TIDELOG_PASSWORD", "", str),
]


def settings(argv: list[str], env: dict[str, str]) -> argparse.Namespace:
    """Parsed settings; a number that isn't one is an error in a flag and the default in the environment."""
    parser = argparse.ArgumentParser(prog="tidelog", description="Journals the change streams of many tenants.")
    parser.add_argument("--version", action="version", version=__version__)
    for flag, variable, default, kind in OPTIONS:
        value = env.get(variable, default)
        if kind is int:
            try:
                value = int(value)
            except ValueError:
                value = default
        parser.add_argument(f"--{flag}", type=kind, default=value, help=f"default: {default} (or ${variable})")
    return parser.parse_args(argv)


def setup_logging(level: str, path: str = "") -> logging.Logger:
    """Messages to stderr always, and to a rotated file if one is named."""
    logger = logging.getLogger("tidelog")
    logger.setLevel({"trace": logging.DEBUG, "fatal": logging.CRITICAL, "warn": logging.WARNING}.get(parse_log_level(level), getattr(logging, parse_log_level(level).upper(), logging.INFO)))
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
    if path:
        handlers.append(logging.handlers.RotatingFileHandler(path, maxBytes=LOG_BYTES, backupCount=LOG_FILES))
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    logger.handlers = handlers
    return logger


def main(argv: list[str] | None = None, env: dict[str, str] | None = None) -> int:
    try:
        given = settings(sys.argv[1:] if argv is None else argv, dict(os.environ) if env is None else env)
    except SystemExit as end:
        return EXIT_OK if end.code in (0, None) else EXIT_CONFIG
    logger = setup_logging(given.log_level, given.log_file)
    logger.info("settings %s", redacted({k: str(v) for k, v in vars(given).items()}))
    if not given.tenants:
        logger.error("no tenant configuration (--tenants)")
        return EXIT_CONFIG
    try:
        return serve(given)
    except Exception:
        logger.exception("fatal")
        return EXIT_FATAL


def serve(given: argparse.Namespace) -> int:
    """Run a query per active tenant until told to stop."""
    from tidelog.operators import checkpoint
    from tidelog.session import build_session
    from tidelog.sources import catalog, pgoutput
    from tidelog.streaming import bootstrap, runner, source
    from tidelog.streaming.supervisor import Reconnection, Supervisor

    spark = build_session("tidelog")
    source.register(spark)

    def desired() -> dict[str, dict]:
        rows = catalog.worker_configs(catalog.active_tenants(spark.read.parquet(given.tenants)), given.prefix)
        return {r["Name"]: r.asDict() for r in rows.collect()}  # the tenants' list

    def make(config: dict):
        slot, home = config["SlotName"], f"{given.journal}/{config['SlotName']}"
        connection = {
            "client": given.client, "path": config["DBHost"], "port": str(config["DBHostPort"]), "database": config["DBName"] or "", "user": config["DBUser"] or "",
            "password": given.password or config["DBPassword"] or "", "tenant": config["Name"], "slot": slot, "envelopes": "true",
        }

        def begin():
            bootstrap.prepare(source.client_of(connection), config["TablePrefix"], slot, bootstrap.published(spark, given.published, config["Name"]))
            resume = checkpoint.resume_lsn(checkpoint.load(spark, f"{home}/checkpoint"), slot, checkpoint.read_lsn(spark, f"{home}/{slot}.lsn"))
            frames = spark.readStream.format("tidelog_frames").options(**connection, resume=str(resume)).load()
            sessions = spark.read.parquet(given.sessions) if given.sessions else None
            options = runner.StreamOptions(
                prefix=config["TablePrefix"], untracked=list(config["Untracked"]), fallback=given.session_fallback if given.sessions else "none", frames=True,
                lsn_file=f"{home}/{slot}.lsn", partitions=TENANT_PARTITIONS, trigger={"processingTime": "1 second"},
            )
            return runner.start(pgoutput.decode(frames), home, f"{given.state}/{slot}", sessions, options)

        return begin

    def policy() -> Reconnection:
        return Reconnection(most=given.max_retries, base_ms=given.base_delay_ms, most_ms=given.max_delay_ms)

    supervisor = Supervisor(make, given.max_workers, policy)

    def report(snapshots: list[dict]) -> None:
        checkpoint.gather(spark, [f"{given.journal}/{w.settings['SlotName']}/checkpoint" for w in supervisor.workers.values()], f"{given.journal}/fleet_checkpoint")

    for number in (signal.SIGINT, signal.SIGTERM, signal.SIGHUP):
        signal.signal(number, lambda *_: supervisor.shutdown())
    supervisor.run(desired, poll_s=given.poll_seconds, health_s=given.health_seconds, report=report)
    return EXIT_OK


if __name__ == "__main__":
    sys.exit(main())
