"""JSON text in and out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNAPSHOT = (
    "status string, snapshot_at decimal(18,6), started_at decimal(18,6), "
    "hb_last_at decimal(18,6), hb_ok boolean, last_pull_at decimal(18,6), "
    "last_flush_at decimal(18,6), threads map<string, boolean>"
)
FEED_STATS = "tenant_active bigint, global_active bigint"


def encode(value: Column) -> Column:
    """JSON text with every field, missing ones as ``null``."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def decode(text: Column, schema: str) -> Column:
    """The struct, or NULL for text that is not JSON of that schema."""
    parsed = F.from_json(
        text, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}
    )
    names = [part.split()[0] for part in _fields(schema)]
    fields = F.struct(*[parsed[name].alias(name) for name in names])
    return F.when(text.isNotNull() & parsed["_corrupt"].isNull(), fields)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL text (commas inside brackets do not split)."""
    fields, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += ch in "<("
        depth -= ch in ">)"
        if ch == "," and depth == 0:
            fields.append(schema[start:i].strip())
            start = i + 1
    return [*fields, schema[start:].strip()]
