"""The queue of parsed bans: numbering, cutting, expiry, depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from banfleet import __version__
from banfleet import constants as C
from banfleet.functions.banlog import iso_time
from banfleet.functions.report import idempotency_key
from banfleet.operators.running import CHUNK, key_total, running, running_count, running_sum, top_n


def number_rows(bans: DataFrame, order: str = "seq", *, width: int = CHUNK) -> DataFrame:
    """Queue ids 1, 2, ... per host in line order. The same ban twice is two rows."""
    return running(bans, ["hostname"], order, {"id": running_count()}, width=width)


def decodable(queue: DataFrame) -> DataFrame:
    return queue.where(iso_time("banned_at").isNotNull())


def quarantine(queue: DataFrame) -> DataFrame:
    """Rows whose time text cannot be read: kept aside instead of holding the head."""
    return queue.where(iso_time("banned_at").isNull())


def cut_batches(
    queue: DataFrame, order: str = "id", size: int = C.BATCH_SIZE, *, width: int = CHUNK
) -> DataFrame:
    """Add ``batch_no`` (from 0): every ``size`` pending rows per host, oldest first."""
    placed = running(queue, ["hostname"], order, {"_place": running_count()}, width=width)
    return placed.withColumn(
        "batch_no", F.floor((F.col("_place") - 1) / F.lit(size)).cast("bigint")
    ).drop("_place")


def assemble_reports(
    batched: DataFrame, *, agent_version: str = __version__, order: str = "id"
) -> DataFrame:
    """One row per (host, batch): key and JSON body. A group never exceeds a batch."""
    rows = F.array_sort(
        F.collect_list(F.struct(F.col(order).alias("id"), "jail", "ip", "banned_at"))
    )
    grouped = batched.groupBy("hostname", "batch_no").agg(rows.alias("_rows"))
    ids = F.transform("_rows", lambda r: r["id"])
    bans = F.transform(
        "_rows",
        lambda r: F.struct(
            r["jail"].alias("jail"), r["ip"].alias("ip"), r["banned_at"].alias("banned_at")
        ),
    )
    return grouped.select(
        "hostname",
        "batch_no",
        F.size("_rows").cast("bigint").alias("n_bans"),
        ids[0].alias("first_id"),
        F.element_at(ids, -1).alias("last_id"),
        idempotency_key(ids).alias("idempotency_key"),
        F.to_json(
            F.struct(F.lit(agent_version).alias("agent_version"), "hostname", bans.alias("bans"))
        ).alias("payload"),
    )


def depth_and_age(queue: DataFrame, hosts: DataFrame, as_of: int) -> DataFrame:
    """Pending rows and age of the oldest per host; 0 and 0 for an empty queue."""
    stats = queue.groupBy("hostname").agg(
        F.count("*").alias("pending"), F.min("enqueued_at").alias("_oldest")
    )
    zero = F.lit(0).cast("bigint")
    age = F.when(
        F.col("_oldest").isNotNull(), F.greatest(zero, F.lit(as_of) - F.col("_oldest"))
    )
    return hosts.join(stats, "hostname", "left").select(
        "hostname",
        F.coalesce("pending", zero).alias("pending"),
        F.coalesce(age, zero).alias("oldest_seconds"),
    )


def drop_expired(queue: DataFrame, as_of: int, ttl: int = C.QUEUE_TTL_SECONDS) -> DataFrame:
    """Rows strictly older than the limit go."""
    return queue.where(F.col("enqueued_at") >= F.lit(as_of - ttl))


def row_bytes() -> F.Column:
    """Size of a queue row: its texts and two eight-byte numbers."""
    return (
        F.octet_length("jail") + F.octet_length("ip") + F.octet_length("banned_at") + F.lit(16)
    ).cast("bigint")


def drop_over_quota(
    queue: DataFrame,
    quota: int = C.QUEUE_QUOTA_BYTES,
    *,
    step: int = C.QUOTA_DROP_CHUNK,
    width: int = CHUNK,
) -> DataFrame:
    """Drop the oldest rows, ``step`` at a time, until a host is within its quota.

    Bytes from a step's first row to the newest row decide about the whole step.
    """
    placed = running(
        queue.withColumn("_bytes", row_bytes()),
        ["hostname"],
        "id",
        {
            "_place": running_count(),
            "_older": running_sum(F.col("_bytes"), before=True),
            "_total": key_total(F.col("_bytes")),
        },
        width=width,
    ).withColumn("_step", F.floor((F.col("_place") - 1) / F.lit(step)))
    at_step_start = F.min("_older").over(Window.partitionBy("hostname", "_step"))
    return (
        placed.withColumn("_older", at_step_start)
        .where(F.col("_total") - F.col("_older") <= F.lit(quota))
        .select(*queue.columns)
    )


def head(queue: DataFrame, n: int = C.BATCH_SIZE) -> DataFrame:
    """The next rows to send, per host."""
    return top_n(queue, ["hostname"], [F.col("id")], n)


def delete_rows(queue: DataFrame, sent: DataFrame) -> DataFrame:
    """Queue without the rows named by ``(hostname, id)``; nothing named, nothing gone."""
    return queue.join(sent.select("hostname", "id"), ["hostname", "id"], "left_anti")
