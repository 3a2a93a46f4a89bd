"""Blocklist feed pages: one JSON object per page, landed in page order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names of the feed.
_ITEM = "array<struct<ip: string, op: string, source: string>>"
DELTA_PAGE = (
    "page_no bigint, status_code int, cursor bigint, next_cursor bigint, global_cursor bigint, "
    f"items {_ITEM}, stats struct<tenant_active: bigint, global_active: bigint>"
)
#: A page as a fleet logs it: each item with the host that got it, when, and whether it carried it out.
LOGGED_PAGE = DELTA_PAGE.replace(
    "source: string>", "source: string, hostname: string, at_s: bigint, enforced: boolean>"
)
FULL_PAGE = (
    "page_no bigint, status_code int, next_page bigint, "
    "items array<struct<ip: string, source: string>>"
)


def read_delta_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DELTA_PAGE).json(path)


def land_pages(pages: DataFrame, path: str) -> None:
    """Write pages (``page_no`` and a JSON ``body`` without it) as they land: one object per line."""
    number = F.concat(F.lit('{"page_no":'), F.col("page_no").cast("string"), F.lit(","))
    pages.select(F.concat(number, F.expr("substr(body, 2)")).alias("value")).write.text(path)


def read_full_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FULL_PAGE).json(path)


def stream_delta_pages(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, schema: str = DELTA_PAGE
) -> DataFrame:
    """Pages as they land, one JSON object per line; ``read_feed`` puts them in order."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def parse_pages(text: DataFrame, column: str, schema: str) -> DataFrame:
    """The same from a text column, other columns kept; bad JSON gives NULL fields."""
    parsed = F.from_json(F.col(column), schema).alias("_page")
    kept = [c for c in text.columns if c != column]
    return text.select(*kept, parsed).select(*kept, "_page.*")


def page_items(pages: DataFrame) -> DataFrame:
    """One row per item, in page order ``(page_no, pos)``; empty pages give none."""
    item = next(f for f in pages.schema.fields if f.name == "items").dataType.elementType
    assert isinstance(item, T.StructType)
    keep = [c for c in pages.columns if c in ("hostname", "page_no", "status_code")]
    return pages.select(*keep, F.posexplode("items").alias("pos", "_item")).select(
        *keep, F.col("pos").cast("bigint").alias("pos"), *[f"_item.{f.name}" for f in item.fields]
    )


def page_headers(pages: DataFrame) -> DataFrame:
    """The small table of page headers, without the items."""
    stats = (
        [
            F.col("stats").isNotNull().alias("has_stats"),
            F.col("stats.tenant_active").alias("tenant_active"),
            F.col("stats.global_active").alias("global_active"),
        ]
        if "stats" in pages.columns
        else []
    )
    return pages.select(*[c for c in pages.columns if c not in ("items", "stats")], *stats)
