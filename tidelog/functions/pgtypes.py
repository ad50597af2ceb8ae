"""Source column types: names, Spark types, JSON classes and binary decoding.

Everything that is a lookup by type OID comes from ``TYPES``; everything that
runs per row on text is a Catalyst expression. Binary values, which arrive only
where the stream was asked for them, are decoded in Python by a registry that
users may extend (``register``).
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PgType:
    oid: int
    name: str
    json: str  # bool, bare, raw or quoted
    spark: str  # type in a typed view
    udt: str | None = None  # catalogue name with a cast in the view


# Type OIDs and names as in the public catalogue of the source database.
TYPES = [
    PgType(16, "bool", "bool", "boolean", "bool"),
    PgType(17, "bytea", "quoted", "string"),
    PgType(18, "char", "quoted", "string"),
    PgType(19, "name", "quoted", "string"),
    PgType(20, "int8", "bare", "bigint", "int8"),
    PgType(21, "int2", "bare", "smallint", "int2"),
    PgType(23, "int4", "bare", "int", "int4"),
    PgType(25, "text", "quoted", "string"),
    PgType(26, "oid", "bare", "bigint"),
    PgType(114, "json", "raw", "string", "json"),
    PgType(142, "xml", "quoted", "string"),
    PgType(650, "cidr", "quoted", "string", "cidr"),
    PgType(700, "float4", "bare", "float", "float4"),
    PgType(701, "float8", "bare", "double", "float8"),
    PgType(790, "money", "quoted", "decimal(19,2)", "money"),
    PgType(829, "macaddr", "quoted", "string"),
    PgType(869, "inet", "quoted", "string", "inet"),
    PgType(1007, "int4[]", "quoted", "string"),
    PgType(1009, "text[]", "quoted", "string"),
    PgType(1042, "bpchar", "quoted", "string"),
    PgType(1043, "varchar", "quoted", "string"),
    PgType(1082, "date", "quoted", "date", "date"),
    PgType(1083, "time", "quoted", "string", "time"),
    PgType(1114, "timestamp", "quoted", "timestamp_ntz", "timestamp"),
    PgType(1184, "timestamptz", "quoted", "timestamp", "timestamptz"),
    PgType(1186, "interval", "quoted", "string"),
    PgType(1266, "timetz", "quoted", "string", "timetz"),
    PgType(1560, "bit", "quoted", "string"),
    PgType(1562, "varbit", "quoted", "string"),
    PgType(1700, "numeric", "bare", "decimal(38,18)", "numeric"),
    PgType(2950, "uuid", "quoted", "string", "uuid"),
    PgType(2951, "uuid[]", "quoted", "string"),
    PgType(3802, "jsonb", "raw", "string", "jsonb"),
]
BY_OID = {t.oid: t for t in TYPES}
BY_UDT = {t.udt: t for t in TYPES if t.udt}
#: Types whose formatted value stands without quotes.
UNQUOTED = [20, 21, 23, 26, 114, 700, 701, 790, 1700, 2950, 3802]
TRUE_TEXTS = ["t", "true", "1"]


def oids(json: str) -> list[int]:
    return [t.oid for t in TYPES if t.json == json]


def type_name(oid: Column) -> Column:
    """Name of a type OID; ``?`` for an unknown one."""
    names = F.create_map(*[F.lit(x) for t in TYPES for x in (t.oid, t.name)])
    return F.coalesce(F.element_at(names, oid.cast("int")), F.lit("?"))


def format_value(oid: Column, text: Column, is_null: Column) -> Column:
    """A value for a log line."""
    return (
        F.when(is_null | text.isNull(), "NULL")
        .when(oid == 16, F.when(text.isin(TRUE_TEXTS), "true").otherwise("false"))
        .when(oid == 17, "<binary>")
        .when(oid.isin(UNQUOTED), text)
        .otherwise(F.concat(F.lit("'"), text, F.lit("'")))
    )


def operation_name(op: Column) -> Column:
    names = {"I": "INSERT", "U": "UPDATE", "D": "DELETE", "T": "TRUNCATE"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), op), F.lit("UNKNOWN"))


def view_type(udt: str, precision: int | None = None, scale: int | None = None) -> str:
    """Spark type of a view's column for a catalogue type name; string where it has no cast."""
    if udt == "numeric" and precision:
        return f"decimal({min(precision, 38)},{scale or 0})"
    found = BY_UDT.get(udt)
    return found.spark if found else "string"


# --- binary values ----------------------------------------------------------

Decoder = Callable[[bytes], str | None]
_DECODERS: dict[int, Decoder] = {}
EPOCH = datetime(2000, 1, 1)
_NUMERIC_SPECIAL = {0xC000: "NaN", 0xD000: "Infinity", 0xF000: "-Infinity"}


def register(*type_oids: int) -> Callable[[Decoder], Decoder]:
    """Use the decorated function for these types; the last registration wins."""

    def use(decoder: Decoder) -> Decoder:
        for oid in type_oids:
            _DECODERS[oid] = decoder
        return decoder

    return use


def decoder(oid: int) -> Decoder:
    return _DECODERS.get(oid, _text)


def decode_binary(oid: int, data: bytes | None) -> str | None:
    """Text of a binary value; null if it is empty or too short for its type."""
    if not data:
        return None
    try:
        return decoder(oid)(data)
    except (struct.error, ValueError, OverflowError):
        return None


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


@register(16)
def _bool(data: bytes) -> str:
    return "t" if data[0] else "f"


def _number(kind: str) -> Decoder:
    return lambda data: str(struct.unpack_from(kind, data)[0])


register(21)(_number(">h"))
register(23)(_number(">i"))
register(20)(_number(">q"))
register(26)(_number(">I"))


def _money(data: bytes) -> str:
    cents = struct.unpack_from(">q", data)[0]
    return f"{'-' if cents < 0 else ''}${abs(cents) // 100:,}.{abs(cents) % 100:02d}"


register(790)(_money)


def _float(kind: str, digits: str) -> Decoder:
    def decode(data: bytes) -> str:
        value = struct.unpack_from(kind, data)[0]
        if value != value:
            return "NaN"
        if value in (float("inf"), float("-inf")):
            return "Infinity" if value > 0 else "-Infinity"
        text = format(value, digits) if digits else repr(value)
        return text.removesuffix(".0")

    return decode


register(700)(_float(">f", ".9g"))
register(701)(_float(">d", ""))


@register(1700)
def _numeric(data: bytes) -> str:
    """Base-10000 digits with a weight, a sign and a display scale."""
    count, weight, sign, scale = struct.unpack_from(">HhHH", data)
    if sign in _NUMERIC_SPECIAL:
        return _NUMERIC_SPECIAL[sign]
    groups = struct.unpack_from(f">{count}H", data, 8)
    value = 0
    for group in groups:
        value = value * 10000 + group
    shift = 4 * (weight - count + 1) + scale  # power of ten from the digits to units of the scale
    units = value * 10**shift if shift >= 0 else value // 10**-shift
    text = str(units).rjust(scale + 1, "0")
    text = f"{text[:-scale]}.{text[-scale:]}" if scale else text
    return f"-{text}" if sign == 0x4000 and units else text


@register(17)
def _bytea(data: bytes) -> str:
    return "\\x" + data.hex()


@register(2950)
def _uuid(data: bytes) -> str | None:
    if len(data) != 16:
        return None
    h = data.hex()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


#: The calendar repeats itself every 400 years.
ERA_DAYS, ERA_YEARS = 146_097, 400


def _day_text(days: int) -> tuple[str, str]:
    """A day (counted from 2000) as text of any year, and the suffix of years before the first."""
    era, day = divmod(days, ERA_DAYS)
    found = EPOCH + timedelta(days=day)
    year = found.year + era * ERA_YEARS
    return f"{year if year > 0 else 1 - year:04d}-{found:%m-%d}", "" if year > 0 else " BC"


def _timestamp(suffix: str) -> Decoder:
    def decode(data: bytes) -> str:
        micros = struct.unpack_from(">q", data)[0]
        if micros in (2**63 - 1, -(2**63)):
            return "infinity" if micros > 0 else "-infinity"
        days, rest = divmod(micros, 86_400_000_000)
        day, era = _day_text(days)
        return f"{day} {(EPOCH + timedelta(microseconds=rest)).time().isoformat()}{suffix}{era}"

    return decode


register(1114)(_timestamp(""))
register(1184)(_timestamp("+00"))


@register(1082)
def _date(data: bytes) -> str:
    days = struct.unpack_from(">i", data)[0]
    if days in (2**31 - 1, -(2**31)):
        return "infinity" if days > 0 else "-infinity"
    return "".join(_day_text(days))


@register(1083)
def _time(data: bytes) -> str:
    seconds, micros = divmod(struct.unpack_from(">q", data)[0], 1_000_000)
    text = f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
    return f"{text}.{micros:06d}" if micros else text


@register(3802)
def _jsonb(data: bytes) -> str:
    return _text(data[1:])


# --- the same conversions as expressions, for typed binary columns -----------


def pg_timestamp(micros: Column) -> Column:
    """Microseconds since 2000 as a timestamp."""
    return F.timestamp_micros(micros + F.lit(946_684_800_000_000))


def format_pg_timestamp(micros: Column) -> Column:
    """Text of microseconds since 2000, the fraction only where there is one."""
    at = pg_timestamp(micros)
    part = F.pmod(micros, F.lit(1_000_000))
    fraction = F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0")))
    return F.concat(_year_text(F.year(at)), F.date_format(at, "-MM-dd HH:mm:ss"), fraction, F.lit("+00"), _era_text(F.year(at)))


def _year_text(year: Column) -> Column:
    """Four digits, or as many as the year has, without a sign (casts and patterns write one beyond year 9999)."""
    digits = F.when(year > 0, year).otherwise(1 - year).cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0"))


def _era_text(year: Column) -> Column:
    return F.when(year > 0, "").otherwise(" BC")


def format_pg_date(days: Column) -> Column:
    """Text of days since 2000."""
    at = pg_date(days)
    return F.concat(_year_text(F.year(at)), F.date_format(at, "-MM-dd"), _era_text(F.year(at)))


def pg_date(days: Column) -> Column:
    return F.date_add(F.lit(date(2000, 1, 1)), days.cast("int"))


def bytea_text(data: Column) -> Column:
    return F.concat(F.lit("\\x"), F.lower(F.hex(data)))


def uuid_text(data: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(data)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
