"""Row deltas: which columns of a change are recorded, and their JSON text.

A row image is an array of ``CELL`` structs. All functions are Catalyst
expressions over such arrays; none needs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions import pgtypes

CELL = "struct<name:string,type_oid:bigint,is_null:boolean,text:string,unchanged:boolean,is_key:boolean>"
ROW = f"array<{CELL}>"
NUMBER = r"^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"


def cell(name: str, oid: int, value: Column, is_key: bool = False) -> Column:
    """A cell from a column of text."""
    return F.struct(
        F.lit(name).alias("name"), F.lit(oid).cast("bigint").alias("type_oid"), value.isNull().alias("is_null"), value.cast("string").alias("text"),
        F.lit(False).alias("unchanged"), F.lit(is_key).alias("is_key"),
    )


def json_string(text: Column) -> Column:
    """A JSON string; the serialiser is used only where something must be escaped."""
    escaped = F.to_json(F.struct(text.alias("v")))
    return F.when(text.rlike(r'[\x00-\x1f"\\]'), F.substring(escaped, 6, F.length(escaped) - 6)).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def json_value(c: Column) -> Column:
    """JSON of a cell by the class of its type; numbers that JSON has no form for are quoted."""
    oid, text = c["type_oid"], c["text"]
    return (
        F.when(c["is_null"] | text.isNull(), "null")
        .when(oid.isin(pgtypes.oids("bool")), F.when(text.isin(pgtypes.TRUE_TEXTS), "true").otherwise("false"))
        .when(oid.isin(pgtypes.oids("bare")) & text.rlike(NUMBER), text)
        .when(oid.isin(pgtypes.oids("raw")) & (text != ""), text)
        .otherwise(json_string(text))
    )


def columns_json(row: Column) -> Column:
    """A JSON object of all cells in order; null for no cells."""
    parts = F.transform(row, lambda c: F.concat(json_string(c["name"]), F.lit(":"), json_value(c)))
    return F.when(F.size(row) > 0, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def _same(old: Column, new: Column) -> Column:
    return (old["name"] == new["name"]) & (old["is_null"] == new["is_null"]) & (new["is_null"] | old["text"].eqNullSafe(new["text"]))


def changed(old: Column, new: Column, old_kind: Column) -> Column:
    """Cells of an update that differ from the old image.

    Cells whose value was not sent (``unchanged``) are left out. With a key-only
    old image only key cells are compared, as it says nothing about the others.
    """
    compared = F.filter(F.coalesce(old, F.array().cast(ROW)), lambda o: ~o["unchanged"])
    keys_only = old_kind.eqNullSafe("K")
    return F.filter(new, lambda c: ~c["unchanged"] & ~F.exists(compared, lambda o: _same(o, c) & (~keys_only | c["is_key"])))


def delta_json(op: Column, old: Column, new: Column, old_kind: Column) -> Column:
    """All new cells of an insert, all old ones of a delete, the changed ones of an update; else null."""
    return F.when(op == "I", columns_json(new)).when(op == "D", columns_json(old)).when(op == "U", columns_json(changed(old, new, old_kind)))


def field_changes(op: Column, old: Column, new: Column) -> Column:
    """(marker, name, type_name, old_value, new_value) of every cell: + - * ~ or =."""
    shown = lambda c: pgtypes.format_value(c["type_oid"], c["text"], c["is_null"])
    item = lambda marker, c, before, after: F.struct(
        marker.alias("marker"), c["name"].alias("name"), pgtypes.type_name(c["type_oid"]).alias("type_name"), before.alias("old_value"), after.alias("new_value")
    )
    none = F.lit(None).cast("string")

    def update(c: Column) -> Column:
        before = F.get(F.filter(F.coalesce(old, F.array().cast(ROW)), lambda o: o["name"] == c["name"]), 0)
        marker = F.when(c["unchanged"], "=").when(before.isNull(), "~").when(_same(before, c), "=").otherwise("*")
        return item(marker, c, F.when(before.isNotNull(), shown(before)), F.when(c["unchanged"], F.lit(None)).otherwise(shown(c)))

    return (
        F.when(op == "I", F.transform(new, lambda c: item(F.lit("+"), c, none, shown(c))))
        .when(op == "D", F.transform(old, lambda c: item(F.lit("-"), c, shown(c), none)))
        .when(op == "U", F.transform(new, update))
    )
