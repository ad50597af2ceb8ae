"""The scalar functions as SQL functions of a session: expressions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "lsn_format": "(lsn BIGINT) RETURNS STRING RETURN format_string('%X/%08X', shiftrightunsigned(lsn, 32), lsn & 4294967295L)",
    "lsn_parse": "(text STRING) RETURNS BIGINT RETURN CASE WHEN contains(text, '/') THEN shiftleft(CAST(conv(right(concat('0', regexp_replace(substring_index(text, '/', 1), '[^0-9A-Fa-f]', '0')), 8), 16, 10) AS BIGINT), 32) "
    "| CAST(conv(right(concat('0', regexp_replace(regexp_replace(text, '^[^/]*/', ''), '[^0-9A-Fa-f]', '0')), 16), 16, -10) AS BIGINT) WHEN text IS NOT NULL THEN 0L END",
    "pg_timestamp": "(micros BIGINT) RETURNS TIMESTAMP RETURN timestamp_micros(micros + 946684800000000L)",
    "pg_date": "(days INT) RETURNS DATE RETURN date_add(DATE'2000-01-01', days)",
    "journal_field": "(data STRING, name STRING) RETURNS STRING RETURN element_at(from_json(data, 'map<string,string>'), name)",
    "now_utc": "() RETURNS STRING RETURN concat(date_format(to_utc_timestamp(current_timestamp(), current_timezone()), 'yyyy-MM-dd HH:mm:ss.SSSSSS'), '+00')",
}


def register(spark: SparkSession) -> None:
    """Create the functions for this session."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
