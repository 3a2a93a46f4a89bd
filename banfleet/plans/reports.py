"""Queries: ban lines, queue and report batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banfleet import __version__
from banfleet import constants as C
from banfleet.functions import banlog
from banfleet.functions.report import deletes_batch, disposition, idempotency_key
from banfleet.operators import outbox as q
from banfleet.operators.lookup import with_values
from banfleet.plans import views as v
from banfleet.plans.views import AS_OF_S, sql
from banfleet.session import written

QUOTA = 20_000


def parse_bans(spark: SparkSession, sf: str) -> DataFrame:
    return banlog.parse_bans(v.ban_log_lines(spark, sf)).select(
        "hostname", "seq", "jail", "ip", F.col("local_ts").cast("string").alias("local_time")
    )


def rejected_lines(spark: SparkSession, sf: str) -> DataFrame:
    return banlog.rejected_lines(v.ban_log_lines(spark, sf)).select("hostname", "seq", "line")


def bans_utc(spark: SparkSession, sf: str) -> DataFrame:
    """Bans with their UTC time; the zone table joins by host (one row per host)."""
    bans = banlog.parse_bans(v.ban_log_lines(spark, sf))
    return with_values(bans, v.host_zones(spark, sf), ["hostname"], "seq").withColumn(
        "utc_ts", banlog.local_to_utc("local_ts", "tz")
    )


def bans_utc_text(spark: SparkSession, sf: str) -> DataFrame:
    return bans_utc(spark, sf).select(
        "hostname", "seq", "tz", F.col("utc_ts").cast("string").alias("utc_time")
    )


def ban_iso_text(spark: SparkSession, sf: str) -> DataFrame:
    """Report form of every ban, and its time read back from that form."""
    rows = banlog.parse_bans(v.ban_log_lines(spark, sf)).select(
        "hostname", "seq", banlog.report_row("jail", "ip", "local_ts").alias("r")
    )
    return rows.select(
        "hostname",
        "seq",
        "r.jail",
        "r.ip",
        "r.banned_at",
        banlog.iso_time("r.banned_at").cast("string").alias("read_back"),
    )


def _damaged_queue(spark: SparkSession, sf: str) -> DataFrame:
    return v.queued_bans(spark, sf).withColumn(
        "banned_at",
        F.when(F.col("seq") % 31 == 0, F.concat(F.lit("x"), "banned_at"))
        .when(F.col("seq") % 37 == 0, F.regexp_replace("banned_at", "T", " "))
        .otherwise(F.col("banned_at")),
    )


def queue_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Queue rows with unreadable times (some are damaged on purpose)."""
    return q.quarantine(_damaged_queue(spark, sf)).select("hostname", "seq", "banned_at")


def report_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines to report bodies: parse, zone, number, cut, assemble."""
    bans = bans_utc(spark, sf).select(
        "hostname", "seq", "jail", "ip", banlog.iso_text("utc_ts").alias("banned_at")
    )
    # stored before it is numbered, which reads it twice: bans are few, lines many
    numbered = q.number_rows(written(bans, "queue"))
    # all rows are pending, so the queue id alone gives the batch
    batched = numbered.withColumn(
        "batch_no", F.floor((F.col("id") - 1) / F.lit(C.BATCH_SIZE)).cast("bigint")
    )
    return q.assemble_reports(batched)


def idempotency_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the batches cut from the rows still pending after delivery."""
    pending = outbox_after_ack(spark, sf)
    batches = q.cut_batches(pending)
    return (
        batches.groupBy("hostname", "batch_no")
        .agg(F.collect_list("id").alias("ids"))
        .select(
            "hostname",
            "batch_no",
            F.size("ids").cast("bigint").alias("n_bans"),
            idempotency_key(F.col("ids")).alias("idempotency_key"),
        )
    )


def outbox_depth_age(spark: SparkSession, sf: str) -> DataFrame:
    return q.depth_and_age(v.queued_bans(spark, sf), v.hosts(spark, sf), AS_OF_S)


def outbox_ttl(spark: SparkSession, sf: str) -> DataFrame:
    return q.drop_expired(v.queued_bans(spark, sf), AS_OF_S).select(
        "hostname", "seq", "jail", "ip", "enqueued_at"
    )


def outbox_quota(spark: SparkSession, sf: str) -> DataFrame:
    return q.drop_over_quota(v.outbox(spark, sf), QUOTA).select("hostname", "id", "ip")


def outbox_head(spark: SparkSession, sf: str) -> DataFrame:
    return q.head(v.outbox(spark, sf)).select("hostname", "id", "jail", "ip", "banned_at")


def _batch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """One attempt per batch: the attempt whose sequence number is the batch's."""
    attempts = v.delivery_attempts(spark, sf)
    return attempts.select(
        "hostname",
        F.col("seq").alias("batch_no"),
        disposition(F.col("status_code"), F.col("error")).alias("outcome"),
    )


def outbox_after_ack(spark: SparkSession, sf: str) -> DataFrame:
    """Queue after one attempt per batch: accepted and refused batches are gone."""
    batched = v.outbox(spark, sf).withColumn(
        "batch_no", F.floor((F.col("id") - 1) / F.lit(C.BATCH_SIZE)).cast("bigint")
    )
    gone = _batch_outcomes(spark, sf).where(deletes_batch(F.col("outcome")))
    # both sides by (host, batch): the acknowledged ids never have to be listed
    kept = batched.join(gone.select("hostname", "batch_no"), ["hostname", "batch_no"], "left_anti")
    return kept.select("hostname", "id", "jail", "ip", "banned_at", "enqueued_at")


def outbox_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Queue without the ids that were sent (those of one jail)."""
    queue = v.outbox(spark, sf)
    sent = v.outbox(spark, sf).where(F.col("jail") == "sshd")
    return q.delete_rows(queue, sent).select("hostname", "id", "jail", "ip")


def ban_counts_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    """New bans per host and log segment (a segment is 1000 line numbers)."""
    return (
        v.queued_bans(spark, sf)
        .withColumn("segment", F.floor(F.col("seq") / 1000).cast("bigint"))
        .groupBy("hostname", "segment")
        .agg(F.count("*").alias("new_bans"))
    )


QUERIES = {
    "parse_bans": parse_bans,
    "rejected_lines": rejected_lines,
    "ban_iso_text": ban_iso_text,
    "queue_quarantine": queue_quarantine,
    "bans_utc": bans_utc_text,
    "report_batches": report_batches,
    "idempotency_keys": idempotency_keys,
    "outbox_depth_age": outbox_depth_age,
    "outbox_ttl": outbox_ttl,
    "outbox_quota": outbox_quota,
    "outbox_head": outbox_head,
    "outbox_after_ack": outbox_after_ack,
    "outbox_delete": outbox_delete,
    "ban_counts_by_segment": ban_counts_by_segment,
}

_ISO = "'%Y-%m-%dT%H:%M:%SZ'"
_DISPOSITION = """CASE WHEN status_code IS NULL THEN 'retry'
    WHEN status_code BETWEEN 200 AND 299 THEN 'ack' WHEN status_code = 401 THEN 'block'
    WHEN status_code = 403 AND error = 'tenant_suspended' THEN 'block'
    WHEN status_code = 403 AND error = 'plan_quota_exceeded' THEN 'hold'
    WHEN status_code = 429 THEN 'hold' WHEN status_code BETWEEN 400 AND 499 THEN 'drop'
    ELSE 'retry' END"""


def _key(ids: str) -> str:
    h = f"sha256(string_agg(CAST({ids} AS VARCHAR), ',' ORDER BY {ids}))"
    return " || '-' || ".join(
        f"substr({h}, {start}, {n})" for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    )


_AFTER_ACK = f"""SELECT o.hostname, o.id, o.jail, o.ip, o.banned_at, o.enqueued_at FROM outbox o
  WHERE NOT EXISTS (SELECT 1 FROM delivery_attempts d WHERE d.hostname = o.hostname
    AND d.seq = (o.id - 1) // {C.BATCH_SIZE} AND {_DISPOSITION} IN ('ack', 'drop'))"""

ORACLES = {
    "parse_bans": sql(
        "SELECT hostname, seq, jail, ip, CAST(local_ts AS VARCHAR) AS local_time FROM bans", "bans"
    ),
    "rejected_lines": sql(
        """SELECT hostname, seq, line FROM ban_log_lines l WHERE NOT EXISTS
           (SELECT 1 FROM bans b WHERE b.seq = l.seq AND b.hostname = l.hostname)""",
        "bans",
    ),
    "ban_iso_text": sql(
        f"""SELECT hostname, seq, jail, ip, strftime(local_ts, {_ISO}) AS banned_at,
            CAST(local_ts AS VARCHAR) AS read_back FROM bans""",
        "bans",
    ),
    "queue_quarantine": sql(
        f"""SELECT hostname, seq, CASE WHEN seq % 31 = 0 THEN 'x' || strftime(utc_ts, {_ISO})
            ELSE replace(strftime(utc_ts, {_ISO}), 'T', ' ') END AS banned_at
          FROM bans_utc WHERE seq % 31 = 0 OR seq % 37 = 0""",
        "bans_utc",
    ),
    "bans_utc": sql(
        """SELECT hostname, seq, tz, CAST(utc_ts AS VARCHAR) AS utc_time
           FROM bans_utc JOIN host_zones USING (hostname)""",
        "bans_utc",
    ),
    "report_batches": sql(
        f"""SELECT hostname, batch_no, count(*) AS n_bans, min(id) AS first_id,
            max(id) AS last_id, {_key('id')} AS idempotency_key,
            '{{"agent_version":"{__version__}","hostname":"' || hostname || '","bans":[' ||
            string_agg('{{"jail":"' || jail || '","ip":"' || ip || '","banned_at":"' ||
              strftime(utc_ts, {_ISO}) || '"}}', ',' ORDER BY id) || ']}}' AS payload
          FROM (SELECT *, (id - 1) // {C.BATCH_SIZE} AS batch_no FROM (SELECT *,
            row_number() OVER (PARTITION BY hostname ORDER BY seq) AS id FROM bans_utc))
          GROUP BY hostname, batch_no""",
        "bans_utc",
    ),
    "idempotency_keys": sql(
        f"""SELECT hostname, batch_no, count(*) AS n_bans, {_key('id')} AS idempotency_key
          FROM (SELECT *, (row_number() OVER (PARTITION BY hostname ORDER BY id) - 1)
            // {C.BATCH_SIZE} AS batch_no FROM ({_AFTER_ACK})) GROUP BY hostname, batch_no""",
        "outbox",
        "delivery_attempts",
    ),
    "outbox_depth_age": sql(
        f"""SELECT h.hostname, count(b.seq) AS pending,
            coalesce(greatest(0, {AS_OF_S} - min(b.at_s)), 0) AS oldest_seconds
          FROM (SELECT DISTINCT hostname FROM ev) h LEFT JOIN bans b USING (hostname)
          GROUP BY h.hostname""",
        "bans",
    ),
    "outbox_ttl": sql(
        f"""SELECT hostname, seq, jail, ip, at_s AS enqueued_at FROM bans
          WHERE at_s >= {AS_OF_S - C.QUEUE_TTL_SECONDS}""",
        "bans",
    ),
    "outbox_quota": sql(
        f"""SELECT hostname, id, ip FROM (SELECT *, max(rest) OVER (PARTITION BY hostname,
              (id - 1) // {C.QUOTA_DROP_CHUNK}) AS from_step FROM (SELECT hostname, id, ip,
            sum(strlen(jail) + strlen(ip) + strlen(banned_at) + 16) OVER (PARTITION BY hostname
              ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS rest FROM outbox))
          WHERE from_step <= {QUOTA}""",
        "outbox",
    ),
    "outbox_head": sql(
        f"SELECT hostname, id, jail, ip, banned_at FROM outbox WHERE id <= {C.BATCH_SIZE}",
        "outbox",
    ),
    "outbox_after_ack": sql(_AFTER_ACK, "outbox", "delivery_attempts"),
    "outbox_delete": sql(
        "SELECT hostname, id, jail, ip FROM outbox WHERE jail <> 'sshd'", "outbox"
    ),
    "ban_counts_by_segment": sql(
        """SELECT hostname, seq // 1000 AS segment, count(*) AS new_bans FROM bans
           GROUP BY 1, 2""",
        "bans",
    ),
}
