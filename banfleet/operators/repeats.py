"""Repeats within a window of time, without holding a key's rows together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from banfleet import constants as C
from banfleet.session import written


def successors(moments: DataFrame, keys: Sequence[str], clock: str, seconds: int) -> DataFrame:
    """Each moment of a key and its next one at least ``seconds`` later; those without one are left out.

    Time is cut into buckets of ``seconds``. What is that much later lies in the next bucket, at the
    same offset or further on, or else is the first moment of the first bucket after that. A
    window sees one bucket of a key, at most ``seconds`` moments and as many that ask; another sees
    one row per bucket.
    """
    keys = list(keys)
    bucket = F.floor(F.col(clock) / seconds).cast("bigint")
    rows = moments.select(*keys, clock, bucket.alias("_bucket")).withColumn("_off", F.col(clock) - F.col("_bucket") * seconds)
    far_on = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rangeBetween(Window.unboundedPreceding, -2)
    per_bucket = rows.groupBy(*keys, "_bucket").agg(F.min(clock).alias("_low"))
    later = per_bucket.select(*keys, "_bucket", F.min("_low").over(far_on).alias("_far"))
    asking = rows.join(later, [*keys, "_bucket"]).select(
        *keys, (F.col("_bucket") + 1).alias("_bucket"), "_off", F.lit(None).cast("bigint").alias("_there"), clock, "_far"
    )
    there = rows.select(*keys, "_bucket", "_off", F.col(clock).alias("_there"), F.lit(None).cast("bigint").alias(clock), F.lit(None).cast("bigint").alias("_far"))
    onward = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("_off")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = asking.unionByName(there).withColumn("_near", F.min("_there").over(onward)).where(F.col(clock).isNotNull())
    return found.select(*keys, clock, F.coalesce("_near", "_far").alias("_next")).where("_next IS NOT NULL")


def first_within(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    order: str = "seq",
    clock: str = "received_at",
    seconds: int = C.IDEMPOTENCY_WINDOW_SECONDS,
) -> DataFrame:
    """Rows that are not repeats: the first per key, then the first at least ``seconds`` after the
    last one kept, and so on. Of the same second the least ``order`` counts.

    Rows are reduced to one per key and second before any shuffle. Keys seen only within one window need no more
    than their first. Of the others every moment knows its successor, and the chain from the first
    one is found by pointer doubling: a round that knows the moments 2^k steps on finds twice as many
    kept ones, so rounds go with the logarithm of the number of windows. Null keys are no keys.
    """
    keys = list(keys)
    moments = rows.groupBy(*keys, clock).agg(F.min(order).alias(order))
    spans = rows.groupBy(*keys).agg(F.min(clock).alias("_first"), F.max(clock).alias("_last"))
    long = spans.where(F.col("_last") - F.col("_first") >= seconds)
    seen = Observation()
    several = written(moments.join(long.select(*keys), keys, "left_semi").observe(seen, F.count(F.lit(1)).alias("n")), "moments")
    kept = spans.select(*keys, F.col("_first").alias(clock))
    if seen.get["n"]:
        kept = kept.unionByName(_chain(several, keys, clock, seconds))
    return moments.join(kept, [*keys, clock]).select(*keys, order, clock)


def _chain(moments: DataFrame, keys: list[str], clock: str, seconds: int) -> DataFrame:
    """All moments on the chains from each key's first, that one aside."""
    jump = written(successors(moments, keys, clock, seconds), "jump")
    reached = moments.groupBy(*keys).agg(F.min(clock).alias(clock))
    chain = []
    while True:
        seen = Observation()
        found = reached.join(jump, [*keys, clock]).select(*keys, F.col("_next").alias(clock))
        found = written(found.observe(seen, F.count(F.lit(1)).alias("n")), "chain")
        if not seen.get["n"]:
            break
        chain.append(found)
        reached = reached.unionByName(found)
        further = jump.select(*keys, F.col(clock).alias("_next"), F.col("_next").alias("_after"))
        jump = written(jump.join(further, [*keys, "_next"]).select(*keys, clock, F.col("_after").alias("_next")), "jump")
    out = moments.select(*keys, clock).limit(0)
    for part in chain:
        out = out.unionByName(part)
    return out
