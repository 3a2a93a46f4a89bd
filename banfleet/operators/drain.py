"""Last flushes before an agent stops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banfleet.functions.report import deletes_batch


def final_drain(batches: DataFrame, most: int) -> DataFrame:
    """Batches that still get out: in order, at most ``most``, up to the first failure.

    ``batches`` has ``hostname, batch_no`` (from 0) and ``outcome``. The cap comes
    first, so what is compared per host is bounded.
    """
    tried = batches.where(F.col("batch_no") < most)
    failed = tried.where(~deletes_batch(F.col("outcome"))).groupBy("hostname").agg(
        F.min("batch_no").alias("_failed")
    )
    return (
        tried.join(failed, "hostname", "left")
        .where(F.coalesce(F.col("batch_no") < F.col("_failed"), F.lit(True)))
        .drop("_failed")
    )
