"""Queries: delivery attempts and the circuit breaker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banfleet import constants as C
from banfleet.functions import report as r
from banfleet.operators import breaker as b
from banfleet.operators import delivery as d
from banfleet.operators.repeats import first_within
from banfleet.plans import views as v
from banfleet.plans.reports import _DISPOSITION
from banfleet.plans.views import sql

RULES = b.Rules(failures_to_open=3, cooldown=3600, cap=14400)
DELIVERY_RULES = b.Rules(failures_to_open=3, cooldown=600, cap=7200)


def delivery_disposition(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.with_outcome(v.delivery_attempts(spark, sf))
    return rows.select(
        "hostname", "seq", "outcome", r.deletes_batch(F.col("outcome")).alias("deletes_batch")
    )


def delivery_latest(spark: SparkSession, sf: str) -> DataFrame:
    return d.latest(v.delivery_attempts(spark, sf))


def delivery_flags(spark: SparkSession, sf: str) -> DataFrame:
    return d.flags(v.delivery_attempts(spark, sf))


def blocked_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return d.after_block(v.delivery_attempts(spark, sf)).select("hostname", "seq", "blocked_by")


def failure_streaks(spark: SparkSession, sf: str) -> DataFrame:
    return d.failure_streaks(v.delivery_attempts(spark, sf)).select(
        "hostname", "seq", "outcome", "failures"
    )


def backoff_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Pause after each attempt that keeps its batch, and its bounds with jitter.

    Only a retry is jittered; a held batch waits exactly as long as it says.
    """
    rows = d.failure_streaks(v.delivery_attempts(spark, sf))
    wait = r.wait_seconds(
        F.col("outcome"), F.col("status_code"), F.col("failures"), F.col("retry_after")
    )
    low, high = C.BACKOFF_JITTER
    jittered = F.col("outcome") == "retry"
    return rows.where(F.col("outcome").isin("retry", "hold")).select(
        "hostname",
        "seq",
        wait.alias("wait_seconds"),
        F.when(jittered, wait * F.lit(low)).otherwise(wait.cast("double")).alias("shortest"),
        F.when(jittered, wait * F.lit(high)).otherwise(wait.cast("double")).alias("longest"),
    )


def retry_after(spark: SparkSession, sf: str) -> DataFrame:
    return v.delivery_attempts(spark, sf).where("status_code = 429").select(
        "hostname", "seq", r.retry_after(F.col("retry_after")).alias("wait_seconds")
    )


def breaker_replay(spark: SparkSession, sf: str) -> DataFrame:
    return b.replay(v.breaker_attempts(spark, sf), RULES).select(
        "hostname", "seq", "allowed", "state", "failures", "cooldown", "open_until"
    )


def breaker_on_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """The breaker fed with delivery outcomes, some of which record nothing."""
    attempts = d.with_outcome(v.delivery_attempts(spark, sf)).select(
        "hostname", "seq", "at_s", r.breaker_outcome(F.col("outcome")).alias("ok")
    )
    return b.replay(attempts, DELIVERY_RULES).select(
        "hostname", "seq", "allowed", "state", "failures", "cooldown", "open_until"
    )


def as_received(events: DataFrame) -> DataFrame:
    """Reports as the receiver sees them: the same key comes again and again."""
    return events.selectExpr(
        "hostname", "sha2(CAST(k AS STRING), 256) AS idempotency_key",
        "event_id AS seq", "at_s AS received_at"
    )


def report_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Reports that are not repeats of one received less than 24 hours before."""
    return first_within(as_received(v.ev(spark, sf)), ["hostname", "idempotency_key"])


QUERIES = {
    "delivery_disposition": delivery_disposition,
    "delivery_latest": delivery_latest,
    "delivery_flags": delivery_flags,
    "blocked_attempts": blocked_attempts,
    "failure_streaks": failure_streaks,
    "backoff_bounds": backoff_bounds,
    "retry_after": retry_after,
    "breaker_replay": breaker_replay,
    "breaker_on_delivery": breaker_on_delivery,
    "report_dedup": report_dedup,
}

_OUTCOMES = f"SELECT *, {_DISPOSITION} AS outcome FROM delivery_attempts"
_STREAKS = """SELECT *, count(*) FILTER (WHERE outcome IN ('retry', 'hold')) OVER (
    PARTITION BY hostname, island ORDER BY seq ROWS UNBOUNDED PRECEDING) AS failures
  FROM (SELECT *, count(*) FILTER (WHERE outcome = 'ack') OVER (PARTITION BY hostname
    ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM outcomes)"""
_RETRY = """CASE WHEN TRY_CAST(trim(retry_after) AS BIGINT) IS NULL THEN 60
    ELSE greatest(0, TRY_CAST(trim(retry_after) AS BIGINT)) END"""


def breaker_sql(rules: b.Rules, source: str) -> str:
    """Recursive twin: one step per attempt, all hosts side by side."""
    n, cool, cap = rules.failures_to_open, rules.cooldown, rules.cap
    return f"""step AS (
      SELECT hostname, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS seq, false AS allowed,
        'closed' AS state, CAST(0 AS BIGINT) AS failures, CAST({cool} AS BIGINT) AS cooldown,
        CAST(0 AS BIGINT) AS open_until FROM (SELECT DISTINCT hostname FROM {source})
      UNION ALL
      SELECT hostname, rn, seq, pass AS allowed,
        CASE WHEN NOT pass THEN 'open' WHEN ok IS NULL THEN during
          WHEN ok THEN 'closed' WHEN during = 'half_open' THEN 'open'
          WHEN failures + 1 >= {n} THEN 'open' ELSE 'closed' END,
        CASE WHEN NOT pass OR ok IS NULL THEN failures WHEN ok THEN 0
          WHEN during = 'half_open' THEN failures ELSE failures + 1 END,
        CASE WHEN NOT pass OR ok IS NULL THEN cooldown WHEN ok THEN {cool}
          WHEN during = 'half_open' THEN least(cooldown * 2, {cap}) ELSE cooldown END,
        CASE WHEN NOT pass OR ok IS NULL OR ok THEN open_until
          WHEN during = 'half_open' THEN at_s + least(cooldown * 2, {cap})
          WHEN failures + 1 >= {n} THEN at_s + cooldown ELSE open_until END
      FROM (SELECT s.hostname, a.rn, a.seq, a.at_s, a.ok, s.failures, s.cooldown, s.open_until,
          NOT (s.state = 'open' AND a.at_s < s.open_until) AS pass,
          CASE WHEN s.state = 'open' AND a.at_s >= s.open_until THEN 'half_open'
            ELSE s.state END AS during
        FROM step s JOIN {source} a ON a.hostname = s.hostname AND a.rn = s.rn + 1)
    )
    SELECT hostname, seq, allowed, state, failures, cooldown,
      CASE WHEN state = 'open' THEN open_until END AS open_until FROM step WHERE rn > 0"""


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES = {
    "delivery_disposition": sql(
        """SELECT hostname, seq, outcome, outcome IN ('ack', 'drop') AS deletes_batch
           FROM outcomes""",
        "delivery_attempts",
        extra={"outcomes": _OUTCOMES},
    ),
    "delivery_latest": sql(
        """SELECT hostname,
            arg_max(status_code, seq) FILTER (WHERE status_code IS NOT NULL) AS last_status,
            max(at_s) FILTER (WHERE outcome = 'ack') AS last_ok_at,
            nullif(arg_max(CASE WHEN outcome = 'ack' THEN '' WHEN status_code IS NULL
                THEN 'network' WHEN status_code = 401 THEN 'invalid_api_key'
                ELSE 'http_' || status_code END, seq) FILTER (WHERE outcome IN ('ack', 'retry')
              OR status_code = 401), '') AS last_error
          FROM outcomes GROUP BY hostname""",
        "delivery_attempts",
        extra={"outcomes": _OUTCOMES},
    ),
    "delivery_flags": sql(
        """SELECT hostname, bool_or(coalesce(status_code = 401, false)) AS auth_blocked,
            bool_or(coalesce(status_code = 403 AND error = 'tenant_suspended', false))
              AS tenant_suspended FROM delivery_attempts GROUP BY hostname""",
        "delivery_attempts",
    ),
    "blocked_attempts": sql(
        """SELECT hostname, seq, blocked_by FROM (SELECT *, min(CASE WHEN outcome = 'block'
            THEN seq END) OVER (PARTITION BY hostname ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS blocked_by FROM outcomes)
          WHERE blocked_by IS NOT NULL""",
        "delivery_attempts",
        extra={"outcomes": _OUTCOMES},
    ),
    "failure_streaks": sql(
        "SELECT hostname, seq, outcome, failures FROM streaks",
        "delivery_attempts",
        extra={"outcomes": _OUTCOMES, "streaks": _STREAKS},
    ),
    "backoff_bounds": sql(
        f"""SELECT hostname, seq, wait_seconds,
            CASE WHEN outcome = 'retry' THEN wait_seconds * 0.5::DOUBLE
              ELSE wait_seconds::DOUBLE END AS shortest,
            CASE WHEN outcome = 'retry' THEN wait_seconds * 1.5::DOUBLE
              ELSE wait_seconds::DOUBLE END AS longest
          FROM (SELECT *, CAST(CASE WHEN status_code = 429 THEN {_RETRY}
              WHEN outcome = 'hold' THEN least({C.BACKOFF_MAX} * 5, 900)
              ELSE least({C.BACKOFF_MAX}, pow(2, least(failures, 6))) END AS BIGINT)
              AS wait_seconds FROM streaks WHERE outcome IN ('retry', 'hold'))""",
        "delivery_attempts",
        extra={"outcomes": _OUTCOMES, "streaks": _STREAKS},
    ),
    "retry_after": sql(
        f"""SELECT hostname, seq, CAST({_RETRY} AS BIGINT) AS wait_seconds
          FROM delivery_attempts WHERE status_code = 429""",
        "delivery_attempts",
    ),
    "breaker_replay": _recursive(
        sql("", "breaker_attempts").rstrip() + ",\n" + breaker_sql(RULES, "breaker_attempts")
    ),
    "breaker_on_delivery": _recursive(
        sql(
            "",
            "delivery_attempts",
            extra={
                "outcomes": _OUTCOMES,
                "recorded": """SELECT hostname, seq, at_s, row_number() OVER (PARTITION BY hostname
                  ORDER BY seq) AS rn, CASE WHEN outcome = 'ack' THEN true
                  WHEN outcome IN ('retry', 'hold') THEN false END AS ok FROM outcomes""",
            },
        ).rstrip()
        + ",\n"
        + breaker_sql(DELIVERY_RULES, "recorded")
    ),
    "report_dedup": _recursive(
        sql(
            "",
            "ev",
            extra={
                "r": """SELECT hostname, sha256(CAST(k AS VARCHAR)) AS idempotency_key,
                  event_id AS seq, at_s AS received_at FROM ev"""
            },
        ).rstrip()
        + f""",
    kept AS (
      SELECT hostname, idempotency_key, min(received_at) AS received_at FROM r GROUP BY 1, 2
      UNION ALL
      SELECT r.hostname, r.idempotency_key, min(r.received_at) FROM kept
        JOIN r ON r.hostname = kept.hostname AND r.idempotency_key = kept.idempotency_key
          AND r.received_at >= kept.received_at + {C.IDEMPOTENCY_WINDOW_SECONDS}
        GROUP BY 1, 2
    )
    SELECT hostname, idempotency_key, min(seq) AS seq, received_at FROM kept
      JOIN r USING (hostname, idempotency_key, received_at) GROUP BY 1, 2, 4"""
    ),
}
