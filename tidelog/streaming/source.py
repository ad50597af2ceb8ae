"""A streaming source of replication frames.

The protocol's client is pluggable: the reader needs an object with the methods
of ``Client``. ``FileClient`` replays frames from a file of JSON lines and is
what tests use; a live client wraps a database driver, which is not part of
this package.
"""

from __future__ import annotations

import base64
import importlib
import json
import os
import time
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from tidelog.sources.pgoutput import standby_status

SCHEMA = "tenant string, seq long, payload binary"


class PreflightError(RuntimeError):
    """The source can't be replicated from."""


#: Seconds from the Unix epoch to the protocol's, 2000-01-01.
PROTOCOL_EPOCH = 946_684_800


class Client(Protocol):
    """What the reader needs of a connection; ``execute`` and ``position_of`` are optional."""

    def wal_level(self) -> str: ...
    def identify(self) -> dict: ...  # systemid, timeline, xlogpos, dbname
    def ensure_slot(self, slot: str) -> int: ...  # consistent point
    def read(self, start: int, most: int) -> list[tuple[int, bytes]]: ...  # (position, frame) after start
    def confirm(self, position: int) -> None: ...
    def reply(self, message: bytes) -> None: ...  # a status message, where a keepalive asks for one
    # def execute(self, statement: str) -> None: ...  # administration, see ``bootstrap``
    # def position_of(self, lsn: int) -> int: ...  # where to read on after a confirmed LSN


class FileClient:
    """Frames from JSON lines of {"seq": n, "payload": base64}; confirmations go to a file beside it."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def wal_level(self) -> str:
        return "logical"

    def identify(self) -> dict:
        return {"systemid": "file", "timeline": 1, "xlogpos": "0/00000000", "dbname": os.path.basename(self.path)}

    def ensure_slot(self, slot: str) -> int:
        return -1

    def read(self, start: int, most: int) -> list[tuple[int, bytes]]:
        found: list[tuple[int, bytes]] = []
        with open(self.path) as lines:
            for line in lines:
                row = json.loads(line)
                if row["seq"] > start:
                    found.append((row["seq"], base64.b64decode(row["payload"])))
                    if len(found) == most:
                        break
        return found

    def confirm(self, position: int) -> None:
        with open(f"{self.path}.confirmed", "w") as out:
            out.write(str(position))

    def reply(self, message: bytes) -> None:
        with open(f"{self.path}.replies", "ab") as out:
            out.write(message)

    def execute(self, statement: str) -> None:
        with open(f"{self.path}.statements", "a") as out:
            out.write(json.dumps(statement) + "\n")


def client_of(options: dict) -> Client:
    module, _, name = options.get("client", "tidelog.streaming.source:FileClient").partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


class FrameReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.client = client_of(options)
        self.tenant, self.slot = options.get("tenant", "main"), options.get("slot", "tidelog_slot_main")
        self.most = int(options.get("maxframes", "10000"))
        self.first, self.resume = options.get("start"), int(options.get("resume", "0"))
        self.envelopes = options.get("envelopes", "false").lower() == "true"
        self.ack_s = float(options.get("ackseconds", "10"))
        self.confirmed: int | None = None
        self.acked = time.monotonic()

    def initialOffset(self) -> dict:  # noqa: N802
        if self.client.wal_level() != "logical":
            raise PreflightError("the source's write-ahead log isn't logical")
        point = self.client.ensure_slot(self.slot)
        if self.first is not None:
            return {"position": int(self.first)}
        if self.resume and hasattr(self.client, "position_of"):
            return {"position": self.client.position_of(self.resume)}
        return {"position": point}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self.client.read(start["position"], self.most)
        end = rows[-1][0] if rows else start["position"]
        found = list(self._frames(rows, answer=True))
        if self.confirmed is not None and time.monotonic() - self.acked >= self.ack_s:
            self._confirm(self.confirmed)  # an idle stream is acknowledged too
        return iter(found), {"position": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The rows of an earlier batch, however many are read at once now."""
        at = start["position"]
        while at < end["position"] and (rows := self.client.read(at, self.most)):
            yield from self._frames([r for r in rows if r[0] <= end["position"]])
            at = rows[-1][0]

    def commit(self, end: dict) -> None:
        self._confirm(end["position"])

    def _confirm(self, position: int) -> None:
        self.client.confirm(position)
        self.confirmed, self.acked = position, time.monotonic()

    def _frames(self, rows: list[tuple[int, bytes]], answer: bool = False) -> Iterator[tuple]:
        """Rows of the source; of envelopes their data, while a keepalive is answered where it asks and is no row.

        What is shorter than its envelope's head is handed on without its data,
        to be counted as an error.
        """
        for seq, payload in rows:
            if not self.envelopes or payload[:1] not in (b"w", b"k"):
                yield self.tenant, seq, payload
            elif payload[:1] == b"w":
                yield self.tenant, seq, payload[25:]
            elif answer and payload[17:18] == b"\1":
                micros = round((time.time() - PROTOCOL_EPOCH) * 1_000_000)
                self.client.reply(standby_status(max(self.confirmed or 0, 0), micros))


class FrameSource(DataSource):
    """``spark.readStream.format("tidelog_frames")`` with options path or client, tenant, slot, start or resume (an LSN), maxFrames, envelopes, ackSeconds."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_frames"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return FrameReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)


def frame_batch(spark: SparkSession, path: str, tenant: str = "main"):
    """The frames of a JSON-lines file as a batch DataFrame."""
    from pyspark.sql import functions as F

    rows = spark.read.schema("seq long, payload string").json(path)
    return rows.select(F.lit(tenant).alias("tenant"), "seq", F.unbase64("payload").alias("payload"))
