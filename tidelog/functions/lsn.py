"""Log sequence numbers: text form and back (both JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = 0xFFFFFFFF


def format_lsn(lsn: Column) -> Column:
    """``high/low`` in upper-case hex, the low half padded to 8 digits."""
    return F.format_string("%X/%08X", F.shiftrightunsigned(lsn, 32), lsn.bitwiseAND(F.lit(LOW)))


def parse_lsn(text: Column) -> Column:
    """The 64-bit value; 0 without a slash. A character that is no hex digit counts as the digit 0."""
    clean = lambda part: F.concat(F.lit("0"), F.regexp_replace(part, "[^0-9A-Fa-f]", "0"))
    high = F.conv(F.right(clean(F.substring_index(text, "/", 1)), F.lit(8)), 16, 10).cast("bigint")
    low = F.conv(F.right(clean(F.regexp_replace(text, "^[^/]*/", "")), F.lit(16)), 16, -10).cast("bigint")
    return F.when(F.contains(text, F.lit("/")), F.shiftleft(high, 32).bitwiseOR(low)).otherwise(F.when(text.isNotNull(), F.lit(0).cast("bigint")))
