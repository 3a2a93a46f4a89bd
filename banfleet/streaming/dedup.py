"""Receiver side: drop repeated reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from banfleet.constants import IDEMPOTENCY_WINDOW_SECONDS
from banfleet.operators.repeats import first_within

KEYS = ("hostname", "idempotency_key")


def dedup_stream(
    reports: DataFrame,
    out: str,
    checkpoint: str,
    *,
    keys: Sequence[str] = KEYS,
    order: str = "seq",
    clock: str = "received_at",
    seconds: int = IDEMPOTENCY_WINDOW_SECONDS,
    poll: str | None = None,
) -> StreamingQuery:
    """Reports that are not repeats, exactly as :func:`first_within` finds them.

    Each micro-batch is judged together with the last kept report per key of the
    window before it. Only those are carried on, so the carried table is as large
    as the keys of one window. ``clock`` is the receiver's, in whole seconds, and
    ``order`` rises with it. Folders carry batch numbers and are replaced on a
    rerun.
    """
    spark, keys = reports.sparkSession, list(keys)
    columns = [*keys, order, clock]

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select(*columns)
        if batch_id:
            carried = spark.read.schema(fresh.schema).parquet(f"{out}/window/batch_id={batch_id - 1}")
            # both parts are read several times, but neither is rewritten here
            kept = first_within(
                fresh.unionByName(carried), keys, order=order, clock=clock, seconds=seconds
            ).join(carried.select(*keys, order), [*keys, order], "left_anti")
        else:
            carried = None
            kept = first_within(fresh, keys, order=order, clock=clock, seconds=seconds)
        kept.write.mode("overwrite").parquet(f"{out}/kept/batch_id={batch_id}")
        last = spark.read.schema(fresh.schema).parquet(f"{out}/kept/batch_id={batch_id}")
        if carried is not None:
            last = last.unionByName(carried)
        newest = F.max(F.struct(clock, order)).alias("_last")
        horizon = last.agg(F.max(clock)).scalar() - F.lit(seconds)
        (
            last.groupBy(*keys)
            .agg(newest)
            .select(*keys, f"_last.{order}", f"_last.{clock}")
            .where(F.col(clock) > horizon)
            .write.mode("overwrite")
            .parquet(f"{out}/window/batch_id={batch_id}")
        )

    writer = reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)
    return writer.start()


def kept_reports(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/kept").drop("batch_id")
