"""Statements for the source database's administration, and for the tables the engine expects there.

They are text: a live client runs them over its own connection. Every
identifier and literal is quoted here.
"""

from __future__ import annotations

from tidelog.functions.config import DEFAULT_PREFIX, session_table


def ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def create_publication(name: str, tables: list[tuple[str, str]] | None = None) -> str:
    """For all tables, or for a list of (schema, table) where the source doesn't allow that."""
    if tables is None:
        return f"CREATE PUBLICATION {ident(name)} FOR ALL TABLES"
    return f"CREATE PUBLICATION {ident(name)} FOR TABLE {', '.join(f'{ident(s)}.{ident(t)}' for s, t in tables)}"


def full_identity(tables: list[tuple[str, str]]) -> list[str]:
    """One statement a table, so that one that fails leaves the others."""
    return [f"ALTER TABLE {ident(s)}.{ident(t)} REPLICA IDENTITY FULL" for s, t in tables]


def create_slot(slot: str, plugin: str = "pgoutput") -> str:
    return f"CREATE_REPLICATION_SLOT {ident(slot)} LOGICAL {ident(plugin)}"


def drop_slot(slot: str) -> str:
    return f"SELECT pg_drop_replication_slot({literal(slot)})"


def start_replication(slot: str, position: str, publication: str, version: int = 1, binary: bool = False) -> str:
    options = [f"proto_version {literal(str(version))}", f"publication_names {literal(ident(publication))}", *(["binary 'true'"] if binary else [])]
    return f"START_REPLICATION SLOT {ident(slot)} LOGICAL {position} ({', '.join(options)})"


def create_session_table(prefix: str = DEFAULT_PREFIX) -> str:
    return (
        f"CREATE TABLE IF NOT EXISTS public.{ident(session_table(prefix))} (\"SessionID\" uuid PRIMARY KEY, \"UserID\" uuid, \"AppName\" varchar(50), "
        "\"BackendPID\" integer NOT NULL, \"Moment\" timestamptz NOT NULL DEFAULT now())"
    )
