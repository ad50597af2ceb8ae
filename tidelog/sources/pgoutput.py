"""Frames of the logical replication protocol: envelopes, messages and tuples.

Decoding is total: a frame that cannot be read gives a row with ``error`` set,
never an exception. Tuples come out as raw cells; names and types are joined to
them afterwards (``operators.relations``), as the relation in force depends on
the order of the log and not on the frame.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidelog.functions import pgbatch, pgtypes
from tidelog.operators import relations
from tidelog.sources import batches

RAW = "array<struct<kind:string,text:string,bin:binary>>"
DECODED = (
    "tenant string, seq long, tag string, error string, xid long, begin_lsn long, commit_lsn long, end_lsn long, commit_us long, "
    f"rel_oid long, relation {relations.RELATION}, truncated array<long>, old_kind string, old_raw {RAW}, new_raw {RAW}"
)
IGNORED = {"Y", "O", "M"}


class Reader:
    """Big-endian reads from a frame; a read past its end raises ``EOFError``."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack(">" + kind, self.take(struct.calcsize(">" + kind)))[0]

    def text(self) -> str:
        """Up to a zero byte, or to the end of the frame."""
        end = self.data.find(b"\0", self.at)
        end = len(self.data) if end < 0 else end
        found = self.data[self.at : end].decode("utf-8", "replace")
        self.at = min(end + 1, len(self.data))
        return found


def read_tuple(r: Reader, empty_as_null: bool = False) -> list[dict]:
    """Cells of a tuple: n null, u unchanged, t text, b binary. Bad lengths and unknown kinds are null."""
    cells = []
    for _ in range(r.number("H")):
        try:
            kind = chr(r.number("B"))
        except EOFError:
            cells.append({"kind": "n", "text": None, "bin": None})
            continue
        cell = {"kind": "n", "text": None, "bin": None}
        if kind == "u":
            cell["kind"] = "u"
        elif kind in "tb":
            try:
                size = r.number("i")
                data = r.take(size)
            except EOFError:
                data, r.at = None, len(r.data)
            if data is not None and (data or (kind == "t" and not empty_as_null)):
                cell = {"kind": kind, "text": data.decode("utf-8", "replace") if kind == "t" else None, "bin": data if kind == "b" else None}
        cells.append(cell)
    return cells


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def decode_message(data: bytes | None) -> dict:
    """Fields of one message; ``error`` says what is wrong with it."""
    if not data:
        return {"error": "empty frame"}
    tag = chr(data[0])
    out: dict = {"tag": tag}
    r = Reader(data, 1)
    try:
        if tag == "B":
            out |= {"begin_lsn": _signed(r.number("Q")), "commit_us": r.number("q"), "xid": r.number("I")}
        elif tag == "C":
            r.number("B")
            out |= {"commit_lsn": _signed(r.number("Q")), "end_lsn": _signed(r.number("Q")), "commit_us": r.number("q")}
        elif tag == "R":
            out["rel_oid"] = r.number("I")
            schema, table, identity = r.text(), r.text(), chr(r.number("B"))
            columns = [{"flags": r.number("B"), "name": r.text(), "type_oid": r.number("I"), "typmod": r.number("i")} for _ in range(r.number("H"))]
            out["relation"] = {"schema_name": schema, "table_name": table, "identity": identity, "columns": [{k: c[k] for k in ("name", "type_oid", "typmod", "flags")} for c in columns]}
        elif tag in "IUD":
            out["rel_oid"] = r.number("I")
            while r.at < len(data):
                part = chr(r.number("B"))
                if part in "KO" and tag in "UD":
                    out |= {"old_kind": part, "old_raw": read_tuple(r)}
                elif part == "N" and tag in "IU":
                    out["new_raw"] = read_tuple(r)
                else:
                    break
            if tag == "D" and "old_raw" not in out or tag in "IU" and "new_raw" not in out:
                out["error"] = "tuple missing"
        elif tag == "T":
            n = r.number("I")
            r.number("B")
            out["truncated"] = [r.number("I") for _ in range(n)]
        elif tag not in IGNORED:
            out["error"] = f"unknown message {tag!r}"
    except EOFError:
        out["error"] = "short frame"
    return out


def decode(frames: DataFrame) -> DataFrame:
    """``frames`` (tenant, seq, payload) to one row per message; ignored kinds are left out, errors are kept.

    Arrow batches go through ``batches.decode``; only frames of uncommon forms (relations, truncates, broken ones) are read one by one.
    """
    schema = to_arrow_schema(StructType.fromDDL(DECODED))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made, others = batches.decode(part, schema)
            yield from made
            if len(others):
                rows = part.take(pa.array(others)).to_pylist()
                yield pa.RecordBatch.from_pylist([{"tenant": r["tenant"], "seq": r["seq"]} | decode_message(r["payload"]) for r in rows], schema=schema)

    found = frames.select("tenant", F.col("seq").cast("bigint").alias("seq"), F.col("payload").cast("binary").alias("payload")).mapInArrow(run, DECODED)
    return found.filter(F.col("tag").isNull() | ~F.col("tag").isin(*IGNORED) | F.col("error").isNotNull())


def demux(envelopes: DataFrame) -> DataFrame:
    """Envelopes (tenant, seq, payload) to data frames, keepalives and malformed ones (``kind`` w, k or ?), by expressions only."""
    p = F.col("payload")
    tag = F.decode(F.substring(p, 1, 1), "ISO-8859-1")
    long_at = lambda at: F.conv(F.hex(F.substring(p, at, 8)), 16, -10).cast("bigint")
    kind = F.when((tag == "w") & (F.length(p) > 25), "w").when((tag == "k") & (F.length(p) >= 18), "k").when(tag.isin("w", "k"), "?").otherwise("raw")
    return envelopes.withColumn("kind", kind).select(
        "tenant", "seq", "kind", F.when(F.col("kind") == "w", long_at(2)).alias("data_start"), F.when(F.col("kind") == "w", long_at(10)).when(F.col("kind") == "k", long_at(2)).alias("wal_end"),
        F.when(F.col("kind") == "k", F.substring(p, 18, 1) == F.lit(bytes([1]))).alias("reply"),
        F.when(F.col("kind") == "w", F.substring(p, 26, 1 << 30)).when(F.col("kind") == "raw", p).alias("payload"),
    )


def standby_status(lsn: int, micros: int, reply: bool = False) -> bytes:
    """The 34-byte acknowledgement: written, flushed and applied up to ``lsn``."""
    return struct.pack(">cQQQqB", b"r", lsn, lsn, lsn, micros, int(reply))


def binary_as_text(cells: Column, oids: Column) -> Column:
    """Cells whose binary values are decoded by their types (Arrow batches)."""

    @F.arrow_udf(RAW)
    def convert(rows: pa.Array, types: pa.Array) -> pa.Array:
        return pgbatch.cell_texts(rows, types)

    return convert(cells, oids)


def change_events(decoded: DataFrame, binary: bool = True, relations_before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(log, errors): decoded messages with names and types from their relations, in the log's form.

    A truncate gives a row for each of its relations. Changes of an unknown
    relation and unreadable frames are errors and leave the log. Binary cells go
    through Python, and only rows that have one. ``relations_before`` (tenant,
    rel_oid, relation) are those in force before the messages.
    """
    sound = decoded.filter(F.col("error").isNull())
    oids = F.when(F.col("tag") == "T", F.col("truncated")).otherwise(F.array("rel_oid"))
    control = F.col("tag").isin("B", "C")
    opened = sound.filter(~control).select(*[c for c in decoded.columns if c != "rel_oid"], F.explode(oids).alias("rel_oid")).select(*decoded.columns)
    named = relations.with_relation(opened, relations_before)
    unknown = F.col("tag").isin("I", "U", "D", "T") & F.col("rel").isNull()
    known = named.filter(~unknown & (F.col("tag") != "R"))
    if binary:
        oids = F.transform(F.col("rel.columns"), lambda c: c["type_oid"])
        has = lambda c: F.coalesce(F.exists(c, lambda x: x["kind"] == "b"), F.lit(False))
        is_binary = has("old_raw") | has("new_raw")
        converted = known.filter(is_binary).withColumns({"old_raw": binary_as_text(F.col("old_raw"), oids), "new_raw": binary_as_text(F.col("new_raw"), oids)})
        known = known.filter(~is_binary).unionByName(converted)
    known = known.unionByName(sound.filter(control).withColumn("rel", F.lit(None).cast(relations.RELATION)))
    log = known.select(
        "tenant", "seq", "tag", "xid", "begin_lsn", "commit_lsn", "end_lsn", F.when(F.col("tag") == "C", pgtypes.pg_timestamp(F.col("commit_us"))).alias("commit_ts"),
        F.col("rel.schema_name").alias("schema_name"), F.col("rel.table_name").alias("table_name"), relations.named_cells(F.col("old_raw"), F.col("rel")).alias("old"),
        relations.named_cells(F.col("new_raw"), F.col("rel")).alias("new"), "old_kind",
    )
    errors = decoded.filter(F.col("error").isNotNull()).select("tenant", "seq", "tag", "error").unionByName(named.filter(unknown).select("tenant", "seq", "tag", F.lit("unknown relation").alias("error")))
    return log, errors


# --- encoding, for tests and for replaying tables as frames -------------------


def encode_relation(oid: int, schema: str, table: str, columns: list[tuple[str, int, bool]], identity: str = "d") -> bytes:
    head = b"R" + struct.pack(">I", oid) + schema.encode() + b"\0" + table.encode() + b"\0" + identity.encode() + struct.pack(">H", len(columns))
    return head + b"".join(struct.pack(">B", int(key)) + name.encode() + b"\0" + struct.pack(">Ii", type_oid, -1) for name, type_oid, key in columns)


def encode_tuple(values: list) -> bytes:
    """None is null, Ellipsis unchanged, bytes binary, anything else text."""
    out = struct.pack(">H", len(values))
    for v in values:
        if v is None or v is ...:
            out += b"n" if v is None else b"u"
        else:
            data = v if isinstance(v, bytes) else str(v).encode()
            out += (b"b" if isinstance(v, bytes) else b"t") + struct.pack(">i", len(data)) + data
    return out


def encode_begin(lsn: int, micros: int, xid: int) -> bytes:
    return b"B" + struct.pack(">QqI", lsn, micros, xid)


def encode_commit(lsn: int, end: int, micros: int) -> bytes:
    return b"C" + struct.pack(">BQQq", 0, lsn, end, micros)


def encode_change(tag: str, oid: int, old: list | None = None, new: list | None = None, old_kind: str = "O") -> bytes:
    out = tag.encode() + struct.pack(">I", oid)
    if old is not None:
        out += old_kind.encode() + encode_tuple(old)
    return out + (b"N" + encode_tuple(new) if new is not None else b"")


def big_endian(value: Column, width: int) -> Column:
    """An integer column as big-endian bytes, by expressions."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * width, "0"))


def text_cell(value: Column) -> Column:
    """A text cell of a tuple, by expressions."""
    data = F.encode(value.cast("string"), "UTF-8")
    return F.when(value.isNull(), F.encode(F.lit("n"), "UTF-8")).otherwise(F.concat(F.encode(F.lit("t"), "UTF-8"), big_endian(F.length(data), 4), data))
