"""Delivery attempts: latest state, sticky flags, failure streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banfleet.functions import report as r
from banfleet.operators.lookup import with_values
from banfleet.operators.running import CHUNK, running, running_since


def with_outcome(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("outcome", r.disposition(F.col("status_code"), F.col("error")))


def blocks_auth() -> Column:
    return F.coalesce(F.col("status_code") == 401, F.lit(False))


def blocks_tenant() -> Column:
    return F.coalesce(
        (F.col("status_code") == 403) & (F.col("error") == "tenant_suspended"), F.lit(False)
    )


def latest(attempts: DataFrame) -> DataFrame:
    """Last status, last success and last error text per host.

    An attempt without a response leaves the status as it was, a refused batch
    leaves the error text as it was, a success clears it.
    """
    rows = with_outcome(attempts)
    status, error = F.col("status_code"), F.col("error")
    text = r.last_error_set(status, error, F.lit("network"))
    changes = text.isNotNull() | (F.col("outcome") == "ack")
    return rows.groupBy("hostname").agg(
        F.max(F.when(status.isNotNull(), F.struct("seq", "status_code")))["status_code"].alias(
            "last_status"
        ),
        F.max(F.when(F.col("outcome") == "ack", F.col("at_s"))).alias("last_ok_at"),
        F.max(F.when(changes, F.struct("seq", text.alias("text"))))["text"].alias("last_error"),
    )


def flags(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("hostname").agg(
        F.bool_or(blocks_auth()).alias("auth_blocked"),
        F.bool_or(blocks_tenant()).alias("tenant_suspended"),
    )


def after_block(attempts: DataFrame) -> DataFrame:
    """Attempts after a host's first blocking answer: they would not be sent.

    A flag once set stays, so the first blocking answer per host decides; no
    window over the attempts is needed.
    """
    first = (
        attempts.where(blocks_auth() | blocks_tenant())
        .groupBy("hostname")
        .agg(F.min("seq").alias("blocked_by"))
    )
    return with_values(attempts, first, ["hostname"], "seq").where(F.col("seq") > F.col("blocked_by"))


def failure_streaks(attempts: DataFrame, *, width: int = CHUNK) -> DataFrame:
    """Recorded failures in a row up to and including each attempt.

    A sum that every success clears. Attempts that record nothing neither count nor reset.
    """
    rows = with_outcome(attempts)
    ok = r.breaker_outcome(F.col("outcome"))
    failed = running_since((~ok).cast("bigint"), ok)
    return running(rows, ["hostname"], "seq", {"failures": failed}, width=width)
