"""Circuit breaker over a stream of attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from banfleet.operators.breaker import Rules, final_states, replay


def breaker_stream(
    attempts: DataFrame,
    out: str,
    checkpoint: str,
    rules: Rules = Rules(),
    *,
    keys: Sequence[str] = ("hostname",),
    poll: str | None = None,
    **columns: str,
) -> StreamingQuery:
    """Replay each micro-batch from the states the one before left.

    The replay cuts busy hosts into chunks like the batch operator, which a
    keyed state per host could not do. Attempts of a host must arrive in order
    across micro-batches. Decisions go to ``out/decisions`` and states to
    ``out/states``, in folders named by batch number that a rerun replaces.
    """
    spark = attempts.sparkSession
    keys = list(keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        known = states(spark, out, batch_id - 1, keys) if batch_id else None
        target = f"{out}/decisions/batch_id={batch_id}"
        replay(batch, rules, keys=keys, start=known, **columns).write.mode("overwrite").parquet(
            target
        )
        last = final_states(spark.read.parquet(target), rules, keys=keys, **columns)
        if known is not None:
            # hosts without attempts keep their state; no clock runs backwards
            clocks = last.unionByName(known).groupBy(*keys).agg(F.max("clock").alias("clock"))
            quiet = known.join(last.select(*keys), keys, "left_anti")
            last = last.unionByName(quiet).drop("clock").join(clocks, keys)
        last.write.mode("overwrite").parquet(f"{out}/states/batch_id={batch_id}")

    writer = attempts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)
    return writer.start()


def states(spark: SparkSession, out: str, batch_id: int, keys: Sequence[str]) -> DataFrame:
    """States after a micro-batch, one row per key."""
    names = ", ".join(f"{k} string" for k in keys)
    schema = f"{names}, kind bigint, count bigint, until bigint, clock bigint"
    return spark.read.schema(schema).parquet(f"{out}/states/batch_id={batch_id}").select(
        *keys, *[F.col(c) for c in ("kind", "count", "until", "clock")]
    )


def decisions(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/decisions").drop("batch_id")
