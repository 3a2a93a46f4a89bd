"""Queries that run their input through streams, and through text files.

Each runs over the whole given table: the stream reads it as a file source, and
text input is first written to the shared folder.
"""

from __future__ import annotations

import datetime
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banfleet import constants as C
from banfleet.operators.drain import final_drain
from banfleet.operators.outbox import assemble_reports
from banfleet.plans import feeds
from banfleet.plans import reports as r
from banfleet.plans import views as v
from banfleet.plans.deliveries import ORACLES as DELIVERY_ORACLES
from banfleet.plans.deliveries import RULES, as_received
from banfleet.plans.feeds import state_sql
from banfleet.plans.views import sql
from banfleet.session import scratch_folder, written
from banfleet.sources import pages as p
from banfleet.sources import segments
from banfleet.streaming.breaker import breaker_stream, decisions
from banfleet.streaming.dedup import dedup_stream, kept_reports
from banfleet.streaming.feed import page_log, read_feed
from banfleet.streaming.flush import flush_stream, flushed_rows, queue_stream, waiting_rows
from banfleet.streaming.ingest import ingest, read_queue
from banfleet.streaming.liveness import liveness_stream
from banfleet.streaming.merge import applied_state

LIVENESS_HEARTBEAT = 900
#: Shares of the log, one rotated after the other, that the ingest queries read: a micro-batch each.
ROTATIONS = 3
#: Files that a micro-batch of the feed reads.
FILES_PER_TRIGGER = 5
#: A window of six hours, or six bans; at most eight leave together.
FLUSH = {"seconds": 6 * 3600, "early_at": 6, "batch": 8}
#: Files that the feed's pages land in.
LANDED_FILES = 12


def _stream(spark: SparkSession, sf: str, name: str = "events") -> DataFrame:
    """A given table as a stream of its files, be it one file or a folder of them."""
    schema = v.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}[.]parquet")


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _to_table(stream: DataFrame, folder: str) -> str:
    """Run a stream to its end into a parquet table; exactly once by its own log."""
    out = f"{folder}/out"
    _finish(
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(out)
    )
    return out


def _segments(spark: SparkSession, sf: str) -> str:
    path = f"{scratch_folder(spark, 'segments')}/log"
    segments.write_segments(v.ban_log_lines(spark, sf), path)
    return path


def text_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines as text files, read back, parsed and numbered in line order."""
    lines = segments.read_lines(spark, _segments(spark, sf))
    return segments.bans_of_segments(lines).select(
        "hostname", "id", "jail", "ip", F.col("local_ts").cast("string").alias("local_time")
    )


def split_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines glued together with rarer line breaks come apart again."""
    path = f"{scratch_folder(spark, 'segments')}/log"
    glued = v.ban_log_lines(spark, sf).withColumn(
        "line",
        F.concat(
            "line",
            F.when(F.col("seq") % 2 == 0, "\x0b").otherwise(F.lit(" ")),
            F.lit("tail "),
            F.col("seq").cast("string"),
        ),
    )
    segments.write_segments(glued, path)
    return segments.read_lines(spark, path).select("hostname", "line")


def _rotations(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The log in shares of about equally many line numbers, first numbers first; lines without one come last."""
    lines, seq = v.ban_log_lines(spark, sf), F.col("seq")
    low, high = v.table(spark, sf, "events").agg(F.min("event_id"), F.max("event_id")).first()
    if low is None:
        return [lines]
    starts = [low + (high + 1 - low) * i // ROTATIONS for i in range(1, ROTATIONS)]
    first, last = seq < starts[0], (seq >= starts[-1]) | seq.isNull()
    between = [(seq >= a) & (seq < b) for a, b in itertools.pairwise(starts)]
    return [lines.where(share) for share in (first, *between, last)]


def _ingest(spark: SparkSession, sf: str, folder: str, received_at: Column) -> None:
    """Rotation by rotation through the ingest stream, which goes on from its checkpoint.

    Segments that are written at once are finished in any order, and a stream reads them by that order. So a run
    takes all segments of a rotation together: lines are numbered as they follow each other, and the
    micro-batches are as many for a log of any length.
    """
    log = f"{scratch_folder(spark, 'segments')}/log"
    zones = written(v.host_zones(spark, sf), "zones")
    for lines in _rotations(spark, sf):
        segments.write_segments(lines, log, mode="append")
        new = segments.stream_segments(spark, log)
        _finish(ingest(new, f"{folder}/queue", f"{folder}/checkpoint", zones, received_at=received_at))


def _ingested(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_folder(spark, "ingest")
    _ingest(spark, sf, folder, F.lit(v.AS_OF_S))
    return read_queue(spark, f"{folder}/queue")


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Text segments through the ingest stream into the queue, over several micro-batches."""
    return _ingested(spark, sf).drop("batch_id")


def stream_cold_start(spark: SparkSession, sf: str) -> DataFrame:
    """An ingest that begins when half of the lines lie there already.

    Their segments are older than the start and stay unread. The stream reads what comes then, stops,
    and after a restart with the same checkpoint reads the segments rotated meanwhile.
    """
    folder = scratch_folder(spark, "cold")
    lines, log = v.ban_log_lines(spark, sf), f"{folder}/log"
    half = lines.agg((F.max("seq") / 2).cast("bigint")).first()[0] or 0
    zones = v.host_zones(spark, sf)
    segments.write_segments(lines.where(F.col("seq") < half), log)
    newest = spark.read.text(log).agg(F.max("_metadata.file_modification_time")).first()[0]
    began = None if newest is None else newest.replace(tzinfo=datetime.UTC) + datetime.timedelta(milliseconds=1)

    def run() -> None:
        start = segments.cold_start(spark, f"{folder}/checkpoint", began)
        new = segments.stream_segments(spark, log, start=start)
        _finish(ingest(new, f"{folder}/queue", f"{folder}/checkpoint", zones, received_at=F.lit(v.AS_OF_S)))

    later = F.col("seq") >= F.lit(half + half // 2)
    segments.write_segments(lines.where((F.col("seq") >= half) & ~later), log, mode="append")
    run()
    segments.write_segments(lines.where(later), log, mode="append")
    run()
    return read_queue(spark, f"{folder}/queue").drop("batch_id")


def stream_drain(spark: SparkSession, sf: str) -> DataFrame:
    """Ingest all that is there, then cut what is queued into report batches."""
    batched = _ingested(spark, sf).withColumn(
        "batch_no", F.floor((F.col("id") - 1) / C.BATCH_SIZE).cast("bigint")
    )
    return assemble_reports(batched).drop("payload")


def final_flushes(spark: SparkSession, sf: str) -> DataFrame:
    """Batches each host still gets out when it stops."""
    outcomes = r._batch_outcomes(spark, sf)
    batches = (
        v.outbox(spark, sf)
        .select("hostname", F.floor((F.col("id") - 1) / C.BATCH_SIZE).cast("bigint").alias("batch_no"))
        .groupBy("hostname", "batch_no")
        .agg(F.count("*").alias("bans"))
    )
    return final_drain(
        batches.join(outcomes, ["hostname", "batch_no"], "left").withColumn(
            "outcome", F.coalesce("outcome", F.lit("ack"))
        ),
        most=C.FINAL_FLUSHES,
    )


def _feed_read(spark: SparkSession, sf: str) -> str:
    """The feed's pages, landed in files of no order, through the page reader; where it writes to."""
    folder = scratch_folder(spark, "feed")
    p.land_pages(feeds.logged_page_json(spark, sf).repartition(LANDED_FILES, "page_no"), f"{folder}/landed")
    pages = p.stream_delta_pages(spark, f"{folder}/landed", FILES_PER_TRIGGER, p.LOGGED_PAGE)
    _finish(read_feed(pages, f"{folder}/state", f"{folder}/checkpoint"))
    return f"{folder}/state"


def stream_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The feed as a stream of landed pages, folded into the applied addresses."""
    return applied_state(spark, _feed_read(spark, sf))


def stream_cursors(spark: SparkSession, sf: str) -> DataFrame:
    """Cursors before and after every page, from the log that the page reader keeps."""
    log = page_log(spark, _feed_read(spark, sf))
    return log.select("page_no", "cursor_before", "cursor_after", "global_before", "global_after")


def stream_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Pull cycles and why they end, from the same log."""
    log = page_log(spark, _feed_read(spark, sf))
    return log.select("page_no", "cycle_no", "consumed", "cursor_after", "global_after", "end_reason")


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The receiver's stream without repeats within 24 hours."""
    folder = scratch_folder(spark, "dedup")
    reports = as_received(v.with_host(_stream(spark, sf)))
    _finish(dedup_stream(reports, f"{folder}/out", f"{folder}/checkpoint"))
    return kept_reports(spark, f"{folder}/out")


def stream_flush(spark: SparkSession, sf: str) -> DataFrame:
    """Log segments through the ingest stream into the queue, from there through the flush stream.

    Every ban with its UTC time, and number and time of the flush it leaves with. The clock of the
    lines is the time of entry; rows of these tables are hours apart, so flushes are too.
    """
    folder = scratch_folder(spark, "flush")
    _ingest(spark, sf, folder, F.unix_seconds(F.col("local_ts").cast("timestamp")))
    queue = queue_stream(spark, f"{folder}/queue")
    _finish(flush_stream(queue, f"{folder}/sent", f"{folder}/sent-checkpoint", **FLUSH))
    return flushed_rows(spark, f"{folder}/sent").unionByName(waiting_rows(spark, f"{folder}/sent"))


def stream_liveness(spark: SparkSession, sf: str) -> DataFrame:
    """Status changes per host from a stream of snapshots (here every event is one)."""
    snapshots = v.with_host(_stream(spark, sf)).selectExpr(
        "hostname",
        "at_s",
        "CASE WHEN k < 60 THEN 'healthy' WHEN k < 80 THEN 'degraded' ELSE 'critical' END AS status",
        "CAST(ts AS TIMESTAMP) AS event_time",
    )
    folder = scratch_folder(spark, "liveness")
    with _rocksdb(spark):
        out = _to_table(
            liveness_stream(snapshots, heartbeat_seconds=LIVENESS_HEARTBEAT, time_mode="EventTime"), folder
        )
    return spark.read.parquet(out)


def stream_breaker(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts as a stream through the breaker."""
    attempts = v.with_host(_stream(spark, sf)).selectExpr(
        "hostname", "event_id AS seq", "at_s", "k < 40 AS ok"
    )
    folder = scratch_folder(spark, "breaker")
    _finish(breaker_stream(attempts, f"{folder}/out", f"{folder}/checkpoint", RULES))
    return decisions(spark, f"{folder}/out").select(
        "hostname", "seq", "allowed", "state", "failures", "cooldown", "open_until"
    )


class _rocksdb:
    """State of any size per key needs the RocksDB store; set for one stream."""

    _NAME = "spark.sql.streaming.stateStore.providerClass"
    _CLASS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(self._NAME, None)
        self.conf.set(self._NAME, self._CLASS)

    def __exit__(self, *exc):
        if self.before is None:
            self.conf.unset(self._NAME)
        else:
            self.conf.set(self._NAME, self.before)


QUERIES = {
    "text_segments": text_segments,
    "split_lines": split_lines,
    "stream_ingest": stream_ingest,
    "stream_cold_start": stream_cold_start,
    "stream_drain": stream_drain,
    "final_flushes": final_flushes,
    "stream_merge": stream_merge,
    "stream_cursors": stream_cursors,
    "stream_cycles": stream_cycles,
    "stream_dedup": stream_dedup,
    "stream_flush": stream_flush,
    "stream_liveness": stream_liveness,
    "stream_breaker": stream_breaker,
}

# The queue second by second: w rows wait in a window opened at t0, no is the next flush. A flush
# by time (t_) comes before the second's own rows; what a second doesn't send goes with the next flush.
_W, _EARLY, _MOST = FLUSH["seconds"], FLUSH["early_at"], FLUSH["batch"]
_FLUSH_STEP = f"""SELECT *, CASE WHEN total >= {_EARLY} THEN least(total, n_early * {_MOST}) WHEN s = t0 + {_W} THEN total ELSE 0 END AS gone,
    CASE WHEN total >= {_EARLY} THEN n_early WHEN s = t0 + {_W} THEN 1 ELSE 0 END AS flushes FROM (
  SELECT *, w + n AS total, (w + n) // {_MOST} + CASE WHEN (w + n) % {_MOST} >= {_EARLY} THEN 1 ELSE 0 END AS n_early FROM (
  SELECT hostname, k, s, n, timed, old_t0 + {_W} AS timed_at, CASE WHEN timed THEN 0 ELSE w END AS w, no + CASE WHEN timed THEN 1 ELSE 0 END AS no,
    CASE WHEN timed OR w = 0 THEN s ELSE old_t0 END AS t0 FROM (
  SELECT x.hostname, x.k, x.s, x.n, f.t0 AS old_t0, f.w, f.no, f.w > 0 AND x.s > f.t0 + {_W} AS timed
  FROM folded f JOIN secs x ON x.hostname = f.hostname AND x.k = f.k + 1)))"""
_FLUSH_SQL = f""", secs AS (SELECT hostname, enqueued_at AS s, count(*) AS n, row_number() OVER (PARTITION BY hostname ORDER BY enqueued_at) AS k
    FROM outbox q WHERE enqueued_at < (SELECT max(enqueued_at) FROM outbox r WHERE r.hostname = q.hostname) GROUP BY hostname, enqueued_at),
  folded AS (SELECT DISTINCT hostname, 0::BIGINT AS k, 0::BIGINT AS s, 0::BIGINT AS t0, 0::BIGINT AS w, 0::BIGINT AS no, 0::BIGINT AS before,
      0::BIGINT AS sent, 0::BIGINT AS first_no, 0::BIGINT AS flushes, false AS timed, 0::BIGINT AS timed_at FROM outbox
    UNION ALL SELECT hostname, k, s, CASE WHEN gone > 0 THEN s ELSE t0 END AS t0, total - gone AS w, no + flushes AS no, w AS before,
      gone AS sent, no AS first_no, flushes, timed, timed_at FROM ({_FLUSH_STEP})),
  times AS (SELECT hostname, first_no - 1 AS flush_no, timed_at AS flushed_at FROM folded WHERE timed
    UNION ALL SELECT hostname, unnest(range(first_no, first_no + flushes)) AS flush_no, s AS flushed_at FROM folded WHERE flushes > 0
    UNION ALL SELECT hostname, no AS flush_no, t0 + {_W} AS flushed_at FROM folded f WHERE w > 0
      AND k = (SELECT max(k) FROM folded g WHERE g.hostname = f.hostname)
      AND t0 + {_W} < (SELECT max(enqueued_at) FROM outbox q WHERE q.hostname = f.hostname)),
  placed AS (SELECT q.*, before + row_number() OVER (PARTITION BY q.hostname, enqueued_at ORDER BY id) - 1 AS o, sent, first_no, no
    FROM outbox q LEFT JOIN folded f ON f.hostname = q.hostname AND f.s = q.enqueued_at AND f.k > 0),
  numbered AS (SELECT *, CASE WHEN o < sent THEN first_no + o // {_MOST} ELSE no END AS number FROM placed)
SELECT hostname, id, jail, ip, banned_at, enqueued_at, t.flush_no, t.flushed_at
FROM numbered LEFT JOIN times t USING (hostname) WHERE t.flush_no = number
UNION ALL SELECT hostname, id, jail, ip, banned_at, enqueued_at, NULL, NULL FROM numbered p
WHERE NOT EXISTS (SELECT 1 FROM times t WHERE t.hostname = p.hostname AND t.flush_no = p.number)"""


def _with_recursive(text: str) -> str:
    """The views, then more of them, some recursive."""
    return text.replace("WITH", "WITH RECURSIVE", 1).replace("\n, secs", ", secs")


ORACLES = {
    "text_segments": sql(
        """SELECT hostname, jail, ip, row_number() OVER (PARTITION BY hostname ORDER BY seq) AS id,
            CAST(local_ts AS VARCHAR) AS local_time FROM bans""",
        "bans",
    ),
    "split_lines": sql(
        """SELECT hostname, line FROM ban_log_lines
           UNION ALL SELECT hostname, 'tail ' || seq AS line FROM ban_log_lines""",
        "ban_log_lines",
    ),
    "stream_ingest": sql(
        f"""SELECT hostname, id, jail, ip, banned_at, CAST({v.AS_OF_S} AS BIGINT) AS enqueued_at
          FROM outbox""",
        "outbox",
    ),
    "stream_cold_start": sql(
        f"""SELECT hostname, row_number() OVER (PARTITION BY hostname ORDER BY seq) AS id, jail, ip,
            strftime(utc_ts, '%Y-%m-%dT%H:%M:%SZ') AS banned_at, CAST({v.AS_OF_S} AS BIGINT) AS enqueued_at
          FROM bans_utc WHERE seq >= (SELECT CAST(floor(max(seq) / 2) AS BIGINT) FROM ban_log_lines)""",
        "bans_utc",
    ),
    "stream_drain": sql(
        f"""SELECT hostname, batch_no, count(*) AS n_bans, min(id) AS first_id, max(id) AS last_id,
            {r._key('id')} AS idempotency_key
          FROM (SELECT *, (id - 1) // {C.BATCH_SIZE} AS batch_no FROM outbox)
          GROUP BY hostname, batch_no""",
        "outbox",
    ),
    "final_flushes": sql(
        f"""SELECT hostname, batch_no, bans, outcome FROM (SELECT *, bool_or(outcome NOT IN
              ('ack', 'drop')) OVER (PARTITION BY hostname ORDER BY batch_no
              ROWS UNBOUNDED PRECEDING) AS failed FROM (
            SELECT q.hostname, q.batch_no, q.bans, coalesce(o.outcome, 'ack') AS outcome
            FROM (SELECT hostname, (id - 1) // {C.BATCH_SIZE} AS batch_no, count(*) AS bans FROM outbox
              GROUP BY 1, 2) q
            LEFT JOIN (SELECT hostname, seq, {r._DISPOSITION} AS outcome FROM delivery_attempts) o
              ON o.hostname = q.hostname AND o.seq = q.batch_no))
          WHERE NOT failed AND batch_no < {C.FINAL_FLUSHES}""",
        "outbox",
        "delivery_attempts",
    ),
    "stream_merge": state_sql("SELECT * FROM applied"),
    "stream_cursors": feeds.ORACLES["cursor_progress"],
    "stream_cycles": feeds.ORACLES["feed_drain_pages"],
    "stream_dedup": DELIVERY_ORACLES["report_dedup"],
    "stream_flush": _with_recursive(sql(_FLUSH_SQL, "outbox")),
    # every change of status along a host's snapshots; silence is a change to critical
    "stream_liveness": sql(
        f"""SELECT hostname, 'critical' AS status, at_s + {2 * LIVENESS_HEARTBEAT + 1} AS at_s FROM snapshots
          WHERE status <> 'critical' AND (following - at_s > {2 * LIVENESS_HEARTBEAT} OR (following IS NULL
            AND at_s + {2 * LIVENESS_HEARTBEAT + 1} < (SELECT max(epoch_ms(ts)) / 1000 FROM ev)))
          UNION ALL SELECT hostname, status, at_s FROM snapshots WHERE before IS DISTINCT FROM status""",
        "ev",
        extra={
            "seconds": """SELECT hostname, at_s, CASE WHEN max(k) < 60 THEN 'healthy' WHEN max(k) < 80
                THEN 'degraded' ELSE 'critical' END AS status FROM ev GROUP BY hostname, at_s""",
            "snapshots": f"""SELECT *, lead(at_s) OVER of_host AS following, CASE WHEN at_s - lag(at_s)
                OVER of_host > {2 * LIVENESS_HEARTBEAT} THEN 'critical' ELSE lag(status) OVER of_host END
                AS before FROM seconds WINDOW of_host AS (PARTITION BY hostname ORDER BY at_s)""",
        },
    ),
    "stream_breaker": DELIVERY_ORACLES["breaker_replay"],
}
