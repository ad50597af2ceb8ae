"""Golden vectors of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions import config, delta, pgtypes
from tidelog.functions.lsn import format_lsn, parse_lsn


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("value", "text"), [(0, "0/00000000"), (7075840, "0/006BF800"), (4294967296, "1/00000000"), (-1, "FFFFFFFF/FFFFFFFF")])
def test_lsn(spark, value, text):
    assert one(spark, format_lsn(F.lit(value).cast("bigint"))) == text
    assert one(spark, parse_lsn(F.lit(text))) == value


@pytest.mark.parametrize(("text", "value"), [("0/1A3F00", 1720064), ("0/1a3f00", 1720064), ("16", 0), ("1/0", 1 << 32), ("0/G1", 1), ("0/1G", 16), ("", 0), ("/", 0)])
def test_lsn_parse(spark, text, value):
    assert one(spark, parse_lsn(F.lit(text))) == value


@pytest.mark.parametrize(
    ("data", "text"),
    [
        ("0002000000000002000c0d48", "12.34"), ("0002000040000002000c0d48", "-12.34"), ("0001000100000000000c", "120000"), ("0001ffff0000000404d2", "0.1234"), ("0001fffe0000000804d2", "0.00001234"),
        ("0000000000000002", "0.00"), ("0003000100000003000109291a7c", "12345.678"), ("00000000c0000000", "NaN"), ("0000", None), ("", None),
    ],
)
def test_numeric(data, text):
    assert pgtypes.decode_binary(1700, bytes.fromhex(data)) == text


@pytest.mark.parametrize(
    ("oid", "data", "text"),
    [
        (1082, (8766).to_bytes(4, "big"), "2024-01-01"), (1082, b"\x7f\xff\xff\xff", "infinity"), (1082, b"\x80\x00\x00\x00", "-infinity"), (1114, (757382400000000).to_bytes(8, "big"), "2024-01-01 00:00:00"),
        (1184, (5).to_bytes(8, "big"), "2000-01-01 00:00:00.000005+00"), (16, b"\x01", "t"), (16, b"\x00", "f"), (21, b"\xff\xfe", "-2"), (23, b"\x00\x00\x00\x07", "7"), (17, b"\x01\xab", "\\x01ab"),
        (2950, bytes(range(16)), "00010203-0405-0607-0809-0a0b0c0d0e0f"), (2950, b"\x01", None), (1083, (3661000001).to_bytes(8, "big"), "01:01:01.000001"), (3802, b"\x01{}", "{}"), (790, (123456).to_bytes(8, "big"), "$1,234.56"),
        (26, b"\xff\xff\xff\xff", "4294967295"), (20, b"\x00", None), (99999, b"abc", "abc"), (701, b"\x3f\xb9\x99\x99\x99\x99\x99\x9a", "0.1"), (700, b"\x7f\xc0\x00\x00", "NaN"),
    ],
)
def test_binary(oid, data, text):
    assert pgtypes.decode_binary(oid, data) == text


def test_register():
    pgtypes.register(424242)(lambda data: "mine")
    assert pgtypes.decode_binary(424242, b"x") == "mine"


@pytest.mark.parametrize(("oid", "text", "null", "shown"), [(17, "x", False, "<binary>"), (16, "t", False, "true"), (25, "x", False, "'x'"), (25, None, True, "NULL"), (23, "5", False, "5")])
def test_format_value(spark, oid, text, null, shown):
    assert one(spark, pgtypes.format_value(F.lit(oid), F.lit(text).cast("string"), F.lit(null))) == shown


def test_type_and_operation_names(spark):
    assert [one(spark, pgtypes.type_name(F.lit(o))) for o in (16, 1700, 9999)] == ["bool", "numeric", "?"]
    assert [one(spark, pgtypes.operation_name(F.lit(o))) for o in "IUDTX"] == ["INSERT", "UPDATE", "DELETE", "TRUNCATE", "UNKNOWN"]


def test_config_values(spark):
    assert one(spark, config.untracked_tables(F.lit("A; B ;;C;A"))) == ["A", "B", "C"]
    assert one(spark, config.untracked_tables(F.lit(None).cast("string"))) == []
    assert one(spark, config.slot_name(F.lit("Tenant Alpha"))) == "tidelog_slot_tenant_alpha"
    assert one(spark, config.slot_name(F.lit("é"))) == "tidelog_slot___"
    assert [one(spark, config.backoff(F.lit(n))) for n in (0, 1, 6, 7)] == [500, 1000, 32000, 60000]
    assert [one(spark, config.int_or_default(F.lit(x))) for x in ("5", "", "x")] == [5, 5432, 5432]
    assert [config.parse_log_level(x) for x in ("WARN", "warn", "Warn", "nope")] == ["warn", "warn", "info", "info"]
    assert config.worker_state(2) == "STREAMING" and config.worker_state(99) == "UNKNOWN"
    assert config.journal_name("a`b", "t") == "`a``b`.`a``bt`"


CELLS = delta.ROW


def image(spark, cells):
    """A literal row image of (name, oid, text, unchanged, key)."""
    if cells is None:
        return F.lit(None).cast(CELLS)
    return F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(o).cast("bigint").alias("type_oid"), F.lit(t is None and not u).alias("is_null"), F.lit(t).cast("string").alias("text"), F.lit(u).alias("unchanged"), F.lit(k).alias("is_key"))
            for n, o, t, u, k in cells
        ]
    ).cast(CELLS)


def c(n, t, o=25, u=False, k=False):
    return (n, o, t, u, k)


@pytest.mark.parametrize(
    ("op", "old", "new", "kind", "expected"),
    [
        ("I", None, [c("a", "1", 23), c("b", "x"), c("c", "t", 16), c("d", None)], None, '{"a":1,"b":"x","c":true,"d":null}'),
        ("D", [c("a", "1", 23), c("b", "x")], None, "O", '{"a":1,"b":"x"}'),
        ("U", [c("a", "1", 23), c("b", "x")], [c("a", "1", 23), c("b", "y")], "O", '{"b":"y"}'),
        ("U", [c("a", "1", 23), c("b", "x")], [c("a", "1", 23), c("b", None)], "O", '{"b":null}'),
        ("U", [c("a", "1", 23)], [c("a", "1", 23)], "O", None),
        ("U", None, [c("a", "1", 23), c("b", "x")], None, '{"a":1,"b":"x"}'),
        ("T", None, None, None, None),
        ("U", [c("a", "1", 23), c("b", "x")], [c("a", "1", 23), c("b", None, u=True)], "O", None),
        ("U", [c("a", "1", 23, k=True), c("b", None)], [c("a", "1", 23, k=True), c("b", None)], "K", '{"b":null}'),
        ("I", None, [c("p", "C:\\temp\n\"q\"\x01"), c("n", "NaN", 701), c("j", '{"k": 1}', 3802), c('we"ird', "1", 20), c("e", "")], None, '{"p":"C:\\\\temp\\n\\"q\\"\\u0001","n":"NaN","j":{"k": 1},"we\\"ird":1,"e":""}'),
        ("I", None, [], None, None),
    ],
)
def test_delta(spark, op, old, new, kind, expected):
    assert one(spark, delta.delta_json(F.lit(op), image(spark, old), image(spark, new), F.lit(kind).cast("string"))) == expected


def test_field_changes(spark):
    found = one(spark, delta.field_changes(F.lit("U"), image(spark, [c("a", "1", 23), c("b", "x")]), image(spark, [c("a", "1", 23), c("b", "y"), c("z", "n")])))
    assert [(r["marker"], r["name"], r["old_value"], r["new_value"]) for r in found] == [("=", "a", "1", "1"), ("*", "b", "'x'", "'y'"), ("~", "z", None, "'n'")]


def test_sql_functions(spark):
    from tidelog.functions import sql

    sql.register(spark)
    row = spark.sql("SELECT lsn_format(7075840L) a, lsn_parse('0/1A3F00') b, lsn_parse('16') c, CAST(pg_date(8766) AS STRING) d, CAST(pg_timestamp(5L) AS STRING) e, journal_field('{\"a\":1}', 'a') f, now_utc() g").first()
    assert tuple(row)[:6] == ("0/006BF800", 1720064, 0, "2024-01-01", "2000-01-01 00:00:00.000005", "1") and row["g"].endswith("+00")


def test_admin_statements():
    from tidelog.sources import admin

    assert admin.create_publication('p"q') == 'CREATE PUBLICATION "p""q" FOR ALL TABLES'
    assert admin.create_publication("p", [("s", "t")]).endswith('FOR TABLE "s"."t"')
    assert admin.drop_slot("o'x") == "SELECT pg_drop_replication_slot('o''x')"
    assert "proto_version '1'" in admin.start_replication("s", "0/0", "pub") and admin.full_identity([("a", "b")]) == ['ALTER TABLE "a"."b" REPLICA IDENTITY FULL']
    assert '"CDCxSession"' in admin.create_session_table() and "LOGICAL" in admin.create_slot("s")


DAYS = [(8766, "2024-01-01"), (2_921_939, "9999-12-31"), (2_921_940, "10000-01-01"), (9_000_000, "26641-03-01"), (-730_119, "0001-01-01"), (-730_120, "0001-12-31 BC"), (-746_117, "0044-03-15 BC")]


@pytest.mark.parametrize(("days", "text"), DAYS)
def test_days_of_any_year(spark, days, text):
    assert pgtypes.decode_binary(1082, days.to_bytes(4, "big", signed=True)) == text
    assert one(spark, pgtypes.format_pg_date(F.lit(days))) == text
    day, _, era = text.partition(" ")
    at, shown = days * 86_400_000_000 + 5, f"{day} 00:00:00.000005+00{' ' * bool(era)}{era}"
    assert pgtypes.decode_binary(1184, at.to_bytes(8, "big", signed=True)) == shown
    assert one(spark, pgtypes.format_pg_timestamp(F.lit(at))) == shown
