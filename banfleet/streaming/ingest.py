"""Continuous ingest of log segments into the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from banfleet.functions.banlog import iso_text, local_to_utc, parse_bans
from banfleet.operators.lookup import with_values
from banfleet.sources.segments import as_lines, number_lines

QUEUE = "hostname string, id bigint, jail string, ip string, banned_at string, enqueued_at bigint"
_LAST = "hostname string, last bigint"


def queue_rows(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """Bans with their time in UTC. The clock of a host without a zone is taken as UTC."""
    zoned = with_values(parse_bans(lines), zones.select("hostname", "tz"), ["hostname"], "line_no", how="left")
    utc = local_to_utc("local_ts", F.coalesce("tz", F.lit("UTC")))
    return zoned.withColumn("banned_at", iso_text(utc)).drop("tz")


def ingest(
    segments: DataFrame,
    out: str,
    checkpoint: str,
    zones: DataFrame,
    *,
    received_at: Column | None = None,
    poll: str | None = None,
    on_count=None,
) -> StreamingQuery:
    """Append new bans to the queue at ``out``.

    ``zones`` (hostname, tz) gives the hosts' clocks. Queue ids of a host run on from one micro-batch
    to the next, in line order: each batch keeps the last id per host beside its rows and starts
    from those of the batch before. Every micro-batch writes the folders of its own number, replacing what an
    interrupted run may have left there: after a restart each segment is in the
    queue once, under the same ids. ``received_at`` is the time of entry in epoch seconds, the clock if not given.
    ``poll`` like ``"2 seconds"`` keeps the stream running; without it the
    stream ends when all segments are read. ``on_count(batch_id, new_bans)`` is
    told how many bans a micro-batch brought.
    """
    spark = segments.sparkSession
    entered = F.unix_timestamp() if received_at is None else received_at

    def write(batch: DataFrame, batch_id: int) -> None:
        bans = number_lines(queue_rows(as_lines(batch), zones), "n")
        if batch_id:
            before = spark.read.schema(_LAST).parquet(f"{out}/last/batch_id={batch_id - 1}")
        else:
            before = spark.createDataFrame([], _LAST)
        rows = with_values(bans, before, ["hostname"], "n", how="left").select(
            "hostname",
            (F.col("n") + F.coalesce("last", F.lit(0))).cast("bigint").alias("id"),
            "jail",
            "ip",
            "banned_at",
            entered.cast("bigint").alias("enqueued_at"),
        )
        if on_count:
            seen = Observation()
            rows = rows.observe(seen, F.count(F.lit(1)).alias("new_bans"))
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
        if on_count:
            on_count(batch_id, seen.get["new_bans"])
        written = spark.read.schema(QUEUE).parquet(f"{out}/rows/batch_id={batch_id}")
        last = written.select("hostname", F.col("id").alias("last")).unionByName(before)
        last.groupBy("hostname").agg(F.max("last").alias("last")).write.mode("overwrite").parquet(
            f"{out}/last/batch_id={batch_id}"
        )

    writer = segments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)
    return writer.start()


def read_queue(spark, out: str) -> DataFrame:
    """The queue as the outbox operators take it, and the number of the batch."""
    return spark.read.schema(f"{QUEUE}, batch_id bigint").parquet(f"{out}/rows")
