"""Text from JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbitra.functions.arrays import let

_OBJECT = "map<string,variant>"


def as_variant(c: Column | str) -> Column:
    """Parse a JSON string column; invalid JSON gives null."""
    return F.try_parse_json(F.col(c) if isinstance(c, str) else c)


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def is_null(v: Column) -> Column:
    return F.schema_of_variant(v) == "VOID"


def _entries(v: Column) -> Column:
    """array<struct<key, kind, raw, json>> sorted by key."""
    return F.array_sort(
        F.transform(
            F.map_entries(v.cast(_OBJECT)),
            lambda e: F.struct(
                e["key"].alias("key"),
                F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID")).alias("kind"),
                F.when(is_string(e["value"]), e["value"].cast("string")).alias("raw"),
                F.to_json(e["value"]).alias("json"),
            ),
        )
    )


def extract_text(v: Column) -> Column:
    """Variant -> text: a string as is, an object's string values by sorted
    key, anything else as JSON text."""
    strings = F.transform(F.filter(_entries(v), lambda e: e["kind"] == "STRING"), lambda e: e["raw"])
    return (
        F.when(is_string(v), v.cast("string"))
        .when(is_object(v), F.array_join(strings, " "))
        .when(is_null(v), F.lit("null"))
        .otherwise(F.to_json(v))
    )


def render_state(v: Column) -> Column:
    """Variant object -> sorted ``key: value`` lines; nulls are left out and a
    non-object gives an empty text."""
    lines = F.transform(
        F.filter(_entries(v), lambda e: e["kind"] != "VOID"),
        lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["raw"], e["json"])),
    )
    return F.when(is_object(v), F.array_join(lines, "\n")).otherwise(F.lit(""))
