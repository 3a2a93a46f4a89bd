"""Report batches and delivery outcomes, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from banfleet import constants as C


def idempotency_key(ids: Column) -> Column:
    """Key of a batch: SHA-256 over its ids in ascending order, comma separated.

    The first 32 hex digits in 8-4-4-4-12 groups. Ids are sorted as numbers.
    Ids restart on every host, so the key is unique only together with the host.
    """
    text = F.array_join(F.transform(F.array_sort(ids), lambda i: i.cast("string")), ",")
    return F.regexp_replace(
        F.substring(F.sha2(text, 256), 1, 32),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$",
        "$1-$2-$3-$4-$5",
    )


def disposition(status: Column, error: Column) -> Column:
    """What happens to a batch after an attempt.

    ``ack`` and ``drop`` delete it; ``block`` keeps it and stops sending;
    ``hold`` and ``retry`` keep it for later. No status means no response.
    """
    return (
        F.when(status.isNull(), "retry")
        .when(status.between(200, 299), "ack")
        .when(status == 401, "block")
        .when((status == 403) & (error == "tenant_suspended"), "block")
        .when((status == 403) & (error == "plan_quota_exceeded"), "hold")
        .when(status == 429, "hold")
        .when(status.between(400, 499), "drop")
        .otherwise("retry")
    )


def deletes_batch(outcome: Column) -> Column:
    return outcome.isin("ack", "drop")


def breaker_outcome(outcome: Column) -> Column:
    """True / False for a recorded success / failure, NULL where nothing is recorded."""
    return F.when(outcome == "ack", True).when(outcome.isin("retry", "hold"), False)


def last_error_set(status: Column, error: Column, exception: Column) -> Column:
    """The text an attempt leaves in ``last_error``; only where one is set or cleared."""
    outcome = disposition(status, error)
    return (
        F.when(status.isNull(), F.coalesce(exception, F.lit("network")))
        .when(status == 401, "invalid_api_key")
        .when(outcome == "retry", F.concat(F.lit("http_"), status.cast("string")))
    )


def backoff(
    failures: Column, minimum: int = C.BACKOFF_MIN, maximum: int = C.BACKOFF_MAX
) -> Column:
    """Seconds to wait after ``failures`` failures in a row, before jitter."""
    doubled = F.lit(minimum) * F.pow(F.lit(2), F.least(failures, F.lit(C.BACKOFF_MAX_EXPONENT)))
    return F.least(F.lit(maximum), doubled.cast("bigint")).cast("bigint")


def jittered(seconds: Column, seed: int | None = None) -> Column:
    low, high = C.BACKOFF_JITTER
    return seconds * (F.lit(low) + F.rand(seed) * F.lit(high - low))


def retry_after(value: Column, maximum: int = C.BACKOFF_MAX) -> Column:
    """Seconds to wait after a 429: the header if it is a whole number, else a default."""
    given = F.trim(value).try_cast("bigint")
    fallback = F.lit(max(maximum, C.RETRY_AFTER_FLOOR)).cast("bigint")
    # greatest() skips NULLs, so the missing case must be split off first
    return F.when(given.isNull(), fallback).otherwise(
        F.greatest(F.lit(0).cast("bigint"), given)
    )


def quota_hold(maximum: int = C.BACKOFF_MAX) -> int:
    return min(maximum * C.QUOTA_HOLD_FACTOR, C.QUOTA_HOLD_CAP)


def wait_seconds(
    outcome: Column, status: Column, failures: Column, retry_header: Column
) -> Column:
    """Pause after an attempt that keeps its batch, before jitter; NULL otherwise."""
    return (
        F.when(status == 429, retry_after(retry_header))
        .when(outcome == "hold", F.lit(quota_hold()).cast("bigint"))
        .when(outcome == "retry", backoff(failures))
    )
