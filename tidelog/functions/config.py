"""Expressions and helpers over tenant configuration values."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default table prefix and port, the log levels and the worker states.
DEFAULT_PREFIX, DEFAULT_PORT, SLOT_PREFIX = "CDCx", 5432, "tidelog_slot_"
LOG_LEVELS = {"trace": 0, "debug": 1, "info": 2, "warn": 3, "error": 4, "fatal": 5}
WORKER_STATES = ["IDLE", "CONNECTING", "STREAMING", "PAUSED", "RECONNECTING", "STOPPING", "STOPPED", "FAILED"]


def slot_name(tenant: Column, prefix: str = SLOT_PREFIX) -> Column:
    """Prefix and the tenant's name, ASCII letters lowered, every other byte than a letter or digit as ``_``.

    Bytes, not characters: the name is read as Latin-1 so that a character of
    several bytes gives as many underscores.
    """
    by_byte = F.decode(F.encode(tenant, "UTF-8"), "ISO-8859-1")
    lowered = F.translate(by_byte, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(prefix), F.regexp_replace(lowered, "[^a-z0-9]", "_"))


def untracked_tables(text: Column) -> Column:
    """The set of names in a ``;`` list: trimmed of spaces, no empty ones, each once."""
    names = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def prefix_or_default(prefix: Column, default: str = DEFAULT_PREFIX) -> Column:
    return F.coalesce(F.nullif(prefix, F.lit("")), F.lit(default))


def int_or_default(text: Column, default: int = DEFAULT_PORT) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))


def parse_log_level(name: str) -> str:
    """Level name in all lower or all upper case; anything else is ``info``."""
    low = name.lower()
    return low if low in LOG_LEVELS and name in (low, name.upper()) else "info"


def worker_state(number: int) -> str:
    return WORKER_STATES[number] if 0 <= number < len(WORKER_STATES) else "UNKNOWN"


def backoff(failures: Column, base_ms: int = 500, factor: float = 2.0, most_ms: int = 60_000) -> Column:
    """Delay in ms before jitter."""
    return F.least(F.lit(base_ms) * F.pow(F.lit(factor), failures), F.lit(float(most_ms))).cast("bigint")


def backoff_ms(failures: int, base_ms: int = 500, factor: float = 2.0, most_ms: int = 60_000, jitter: float = 0.25, rng: random.Random | None = None) -> int:
    """Delay in ms: capped, then spread by the jitter, 1 at least."""
    plain = min(base_ms * factor ** min(failures, 64), most_ms)
    return max(1, int(plain * (rng or random).uniform(1 - jitter, 1 + jitter)))


def quoted(identifier: str) -> str:
    """A quoted SQL identifier."""
    return "`" + identifier.replace("`", "``") + "`"


def journal_name(schema: str, table: str) -> str:
    return f"{quoted(schema)}.{quoted(schema + table)}"


def view_name(schema: str, table: str) -> str:
    return f"{quoted(schema)}.{quoted(table)}"


def session_table(prefix: str) -> str:
    return f"{prefix}Session"


def redacted(settings: dict[str, str]) -> dict[str, str]:
    """Settings with every secret masked, for logs."""
    return {k: "***" if any(s in k.lower() for s in ("password", "secret", "token")) else v for k, v in settings.items()}
