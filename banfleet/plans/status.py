"""Queries: fleet status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banfleet import __version__
from banfleet import constants as C
from banfleet.functions import health as h
from banfleet.functions import jsontext as j
from banfleet.operators import delivery as d
from banfleet.operators import outbox as q
from banfleet.operators import sketches as sk
from banfleet.operators import status as st
from banfleet.operators.feed import has_address
from banfleet.operators.lookup import with_values
from banfleet.plans import views as v
from banfleet.plans.feeds import applied_fleet, state_sql
from banfleet.plans.views import AS_OF_S, sql
from banfleet.session import written

# Hosts of these tables report every few hours.
HEARTBEAT = 7200
BACKEND = "https://reports.example/api/v1"
JAIL = "blocklist"


def applied_counts(spark: SparkSession, sf: str) -> DataFrame:
    return st.applied_counts(applied_fleet(spark, sf), v.hosts(spark, sf))


def applied_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return st.distinct_addresses(applied_fleet(spark, sf))


def distinct_sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses ever added per host: counted, and from stored sketches of each day.

    Says whether the estimate from the days' sketches is that of a sketch made at once, and lies
    within three standard errors of the count.
    """
    added = v.feed_items(spark, sf).where(has_address()).where("op = 'add'").select("hostname", "ip", "at_s")
    days = written(sk.distinct_sketches(added, ["hostname"], "ip"), "sketches")
    at_once = sk.distinct_sketches(added, ["hostname"], "ip", window=1 << 40)
    both = sk.estimates(days, ["hostname"], "by_day").join(sk.estimates(at_once, ["hostname"], "at_once"), "hostname")
    counted = added.groupBy("hostname").agg(F.count_distinct("ip").alias("addresses"))
    off = F.abs(F.col("by_day") - F.col("addresses")) <= 1 + 3 * sk.standard_error() * F.col("addresses")
    return counted.join(both, "hostname").select(
        "hostname", "addresses", (F.col("by_day") == F.col("at_once")).alias("parts_agree"), off.alias("within_error")
    )


def applied_of_tenant(spark: SparkSession, sf: str) -> DataFrame:
    return st.of_source(applied_fleet(spark, sf), "tenant").select("hostname", "ip")


def recent_applied(spark: SparkSession, sf: str) -> DataFrame:
    return st.recent(applied_fleet(spark, sf))


def recent_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The status screen's list, with the time on each host's own clock."""
    rows = st.recent_filtered(applied_fleet(spark, sf), "global")
    return rows.join(v.host_zones(spark, sf), "hostname").select(
        "hostname", "rn", "ip", "source", h.clock_text(F.col("applied_at"), F.col("tz")).alias("clock")
    )


def kv_latest(spark: SparkSession, sf: str) -> DataFrame:
    return st.latest_values(v.kv_log(spark, sf))


def kv_by_host(spark: SparkSession, sf: str) -> DataFrame:
    return st.latest_by_host(v.kv_log(spark, sf))


def snapshot_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored snapshot, decoded; damaged ones are NULL throughout."""
    log = v.kv_log(spark, sf).where(F.col("k") == C.KV_SNAPSHOT)
    decoded = log.select("hostname", "seq", j.decode(F.col("v"), j.SNAPSHOT).alias("s"))
    return decoded.select(
        "hostname",
        "seq",
        F.col("s").isNotNull().alias("readable"),
        "s.status",
        F.col("s.snapshot_at").cast("bigint").alias("snapshot_at"),
        "s.hb_ok",
        F.col("s.last_pull_at").cast("bigint").alias("last_pull_at"),
        h.all_alive(F.col("s.threads")).alias("all_alive"),
        F.when(
            F.col("s").isNotNull(), h.raw_status(F.col("s.threads"), ~F.col("s.hb_ok"))
        ).alias("raw_status"),
    )


def feed_stats_decode(spark: SparkSession, sf: str) -> DataFrame:
    log = v.kv_log(spark, sf).where(F.col("k") == C.KV_FEED_STATS)
    decoded = log.select("hostname", "seq", j.decode(F.col("v"), j.FEED_STATS).alias("s"))
    return decoded.select("hostname", "seq", "s.tenant_active", "s.global_active")


def feed_stats_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Feed totals per page as the text that is stored."""
    pages = v.feed_pages(spark, sf)
    return pages.select(
        "page_no", j.encode(F.struct("tenant_active", "global_active")).alias("v")
    )


def jail_counts(spark: SparkSession, sf: str) -> DataFrame:
    return st.jail_counts(v.jail_status(spark, sf))


def jail_drift(spark: SparkSession, sf: str) -> DataFrame:
    return st.jail_drift(applied_counts(spark, sf), jail_counts(spark, sf))


def gathered(spark: SparkSession, sf: str) -> DataFrame:
    hosts = v.hosts(spark, sf)
    # the applied addresses are a stored table, read for counts and for the newest
    applied = written(applied_fleet(spark, sf), "applied")
    return st.gather(
        hosts,
        st.latest_by_host(v.kv_log(spark, sf)),
        st.applied_counts(applied),
        q.depth_and_age(v.queued_bans(spark, sf), hosts, AS_OF_S),
        jail_counts(spark, sf),
        st.recent(applied),
        as_of=AS_OF_S,
        backend_url=BACKEND,
        jail_name=JAIL,
        heartbeat_seconds=HEARTBEAT,
    )


def fleet_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = gathered(spark, sf)
    return rows.select(
        "hostname",
        "version",
        "status",
        h.exit_code(F.col("status")).alias("exit_code"),
        F.col("started_at").cast("bigint").alias("started_at"),
        "uptime_seconds",
        "hb_age_seconds",
        "hb_ok",
        h.all_alive(F.col("threads")).alias("all_alive"),
        "applied_total",
        "applied_tenant",
        "applied_global",
        "tenant_cursor",
        "global_cursor",
        "feed_global_active",
        "jail_banned",
        "outbox_pending",
        "outbox_oldest_seconds",
        "last_pull_age_seconds",
        "snapshot_age_seconds",
        F.size("recent").cast("bigint").alias("recent_rows"),
        F.array_join(F.transform("recent", lambda r: r["ip"]), " ").alias("recent_ips"),
    )


def status_json(spark: SparkSession, sf: str) -> DataFrame:
    return gathered(spark, sf).select("hostname", j.encode(F.struct("*")).alias("body"))


def heartbeat_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Every host's heartbeat. No answer to the last attempt counts as degraded, no attempt as none."""
    attempts = v.delivery_attempts(spark, sf)
    answers = attempts.groupBy("hostname").agg(F.max_by("status_code", "seq").alias("_status"))
    answers = answers.select("hostname", h.heartbeat_degraded(F.col("_status")).alias("degraded"))
    rows = gathered(spark, sf).join(answers, "hostname", "left").join(d.flags(attempts), "hostname", "left")
    rows = rows.fillna(False, ["degraded", "auth_blocked", "tenant_suspended"])
    return rows.select("hostname", st.heartbeat_body().alias("body"))


def heartbeat_interval(spark: SparkSession, sf: str) -> DataFrame:
    """After each answer: degraded or not, and when the next heartbeat is due."""
    degraded = h.heartbeat_degraded(F.col("status_code"))
    return v.delivery_attempts(spark, sf).select(
        "hostname",
        "seq",
        degraded.alias("degraded"),
        (F.col("at_s") + h.heartbeat_interval(degraded)).alias("next_at"),
    )


def feed_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the feed each host has applied, against every total it was told."""
    log = v.kv_log(spark, sf).where(F.col("k") == C.KV_FEED_STATS)
    told = log.select("hostname", "seq", j.decode(F.col("v"), j.FEED_STATS)["global_active"].alias("active"))
    percent = h.coverage_percent(F.coalesce("applied_global", F.lit(0)), F.col("active"))
    counts = st.applied_counts(applied_fleet(spark, sf))
    return with_values(told, counts, ["hostname"], "seq", how="left").select(
        "hostname",
        "seq",
        percent.alias("percent"),
        h.coverage_bar(percent).alias("bar"),
    )


def age_text(spark: SparkSession, sf: str) -> DataFrame:
    """Age of every queued ban as text; some are given no time, some a recent one."""
    shown = F.when(F.col("seq") % 19 == 0, F.lit(None)).when(
        F.col("seq") % 3 == 0, AS_OF_S - F.col("seq") % 7000
    ).otherwise(F.col("enqueued_at"))
    age = h.age_seconds(AS_OF_S, shown.cast("bigint"))
    return v.queued_bans(spark, sf).select("hostname", "seq", h.age_text(age).alias("age"))


QUERIES = {
    "applied_counts": applied_counts,
    "applied_distinct": applied_distinct,
    "distinct_sketched": distinct_sketched,
    "applied_of_tenant": applied_of_tenant,
    "recent_applied": recent_applied,
    "recent_filtered": recent_filtered,
    "kv_latest": kv_latest,
    "kv_by_host": kv_by_host,
    "snapshot_decode": snapshot_decode,
    "feed_stats_decode": feed_stats_decode,
    "feed_stats_encode": feed_stats_encode,
    "jail_counts": jail_counts,
    "jail_drift": jail_drift,
    "fleet_status": fleet_status,
    "status_json": status_json,
    "heartbeat_payload": heartbeat_payload,
    "heartbeat_interval": heartbeat_interval,
    "feed_coverage": feed_coverage,
    "age_text": age_text,
}

_LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hostname, k
    ORDER BY at_s DESC, seq DESC) AS rn FROM kv_log) WHERE rn = 1"""
_RECENT = """SELECT hostname, ip, applied_at, source, row_number() OVER (PARTITION BY hostname
    ORDER BY applied_at DESC, ip) AS rn FROM applied"""
_COUNTS = """SELECT hostname, count(*) AS applied_total,
    count(*) FILTER (WHERE source = 'tenant') AS applied_tenant,
    count(*) FILTER (WHERE source = 'global') AS applied_global FROM applied GROUP BY hostname"""
_JAILS = """SELECT hostname, CASE WHEN rc = 0 THEN TRY_CAST(regexp_extract(out,
    'Currently banned: ([^\n]*)', 1) AS BIGINT) END AS jail_banned FROM jail_status"""
_SNAPS = """SELECT hostname, seq, v, v NOT LIKE '{not%' AS readable,
    CASE WHEN v NOT LIKE '{not%' THEN v->>'$.status' END AS status,
    CASE WHEN v NOT LIKE '{not%' THEN CAST(v->>'$.snapshot_at' AS BIGINT) END AS snapshot_at,
    CASE WHEN v NOT LIKE '{not%' THEN CAST(v->>'$.started_at' AS BIGINT) END AS started_at,
    CASE WHEN v NOT LIKE '{not%' THEN CAST(v->>'$.hb_last_at' AS BIGINT) END AS hb_last_at,
    CASE WHEN v NOT LIKE '{not%' THEN CAST(v->>'$.hb_ok' AS BOOLEAN) END AS hb_ok,
    CASE WHEN v NOT LIKE '{not%' THEN CAST(v->>'$.last_pull_at' AS BIGINT) END AS last_pull_at,
    CASE WHEN v NOT LIKE '{not%' THEN CAST(v->>'$.last_flush_at' AS BIGINT) END
      AS last_flush_at,
    CASE WHEN v NOT LIKE '{not%' THEN CAST(v->>'$.threads.reader' AS BOOLEAN) END AS reader"""


def _value(key: str) -> str:
    return f"(SELECT hostname, v FROM latest WHERE k = '{key}')"


_NOW = AS_OF_S
_GATHERED = f"""SELECT hosts.hostname,
    CASE WHEN snapshot_at IS NULL OR {_NOW} - snapshot_at > {2 * HEARTBEAT} THEN 'critical'
      ELSE status END AS status, started_at, {_NOW} - started_at AS uptime_seconds, hb_last_at,
    {_NOW} - hb_last_at AS hb_age_seconds, coalesce(hb_ok, false) AS hb_ok, reader,
    coalesce(applied_total, 0) AS applied_total, coalesce(applied_tenant, 0) AS applied_tenant,
    coalesce(applied_global, 0) AS applied_global,
    coalesce(TRY_CAST(tc.v AS BIGINT), 0) AS tenant_cursor,
    coalesce(TRY_CAST(gc.v AS BIGINT), 0) AS global_cursor,
    CASE WHEN fs.v NOT LIKE '{{not%' THEN CAST(fs.v->>'$.global_active' AS BIGINT) END
      AS feed_global_active, jail_banned, coalesce(pending, 0) AS outbox_pending,
    coalesce(oldest, 0) AS outbox_oldest_seconds, last_pull_at,
    {_NOW} - last_pull_at AS last_pull_age_seconds, last_flush_at,
    {_NOW} - snapshot_at AS snapshot_age_seconds, coalesce(recent_rows, 0) AS recent_rows,
    coalesce(recent_ips, '') AS recent_ips, coalesce(recent_json, '') AS recent_json
  FROM (SELECT DISTINCT hostname FROM ev) hosts
  LEFT JOIN snaps USING (hostname) LEFT JOIN counts USING (hostname)
  LEFT JOIN {_value(C.KV_BLOCKLIST_CURSOR)} tc USING (hostname)
  LEFT JOIN {_value(C.KV_GLOBAL_CURSOR)} gc USING (hostname)
  LEFT JOIN {_value(C.KV_FEED_STATS)} fs USING (hostname) LEFT JOIN jails USING (hostname)
  LEFT JOIN (SELECT hostname, count(*) AS pending, greatest(0, {_NOW} - min(at_s)) AS oldest
    FROM bans GROUP BY hostname) USING (hostname)
  LEFT JOIN (SELECT hostname, count(*) AS recent_rows, string_agg(ip, ' ' ORDER BY rn)
      AS recent_ips, string_agg('{{"ip":"' || ip || '","applied_at":' || applied_at ||
      ',"source":"' || source || '"}}', ',' ORDER BY rn) AS recent_json
    FROM recent WHERE rn <= {C.RECENT_LIMIT} GROUP BY hostname) USING (hostname)"""
_STATUS_CTES = {
    "latest": _LATEST,
    "snaps": _SNAPS + f" FROM latest WHERE k = '{C.KV_SNAPSHOT}'",
    "recent": _RECENT,
    "counts": _COUNTS,
    "jails": _JAILS,
    "gathered": _GATHERED,
}


def _status_sql(body: str, *views: str, more: dict[str, str] | None = None) -> str:
    from banfleet.plans.feeds import _STATE

    return sql(
        body, "feed_items", "feed_pages", "kv_log", "jail_status", "bans", *views,
        extra={**_STATE, **_STATUS_CTES, **(more or {})},
    )


def _json_time(name: str) -> str:
    return f"""'"{name}":' || coalesce({name} || '.000000', 'null')"""


def _json_number(name: str) -> str:
    return f"""'"{name}":' || coalesce(CAST({name} AS VARCHAR), 'null')"""


_BODY = " || ',' || ".join(
    [
        f"""'{{"version":"{__version__}"'""",
        """'"hostname":"' || hostname || '"'""",
        """'"status":"' || status || '"'""",
        _json_time("started_at"),
        _json_number("uptime_seconds"),
        _json_time("hb_last_at"),
        _json_number("hb_age_seconds"),
        _json_number("hb_ok"),
        """'"threads":{' || CASE WHEN reader IS NULL THEN '' ELSE '"reader":' || reader ||
            ',"sender":true,"puller":true,"heartbeat":true' END || '}'""",
        f"""'"backend_url":"{BACKEND}"'""",
        """'"feed_global_enabled":true'""",
        *map(
            _json_number,
            (
                "applied_total",
                "applied_tenant",
                "applied_global",
                "tenant_cursor",
                "global_cursor",
                "feed_global_active",
            ),
        ),
        f"""'"jail_name":"{JAIL}"'""",
        *map(_json_number, ("jail_banned", "outbox_pending", "outbox_oldest_seconds")),
        _json_time("last_pull_at"),
        _json_number("last_pull_age_seconds"),
        _json_time("last_flush_at"),
        _json_number("snapshot_age_seconds"),
        """'"recent":[' || recent_json || ']}'""",
    ]
)
_OUTCOME_FLAGS = """SELECT hostname,
    arg_max_null(status_code, seq) AS last_status, true AS tried,
    bool_or(coalesce(status_code = 401, false)) AS auth_blocked,
    bool_or(coalesce(status_code = 403 AND error = 'tenant_suspended', false))
      AS tenant_suspended FROM delivery_attempts GROUP BY hostname"""

ORACLES = {
    "applied_counts": state_sql(
        f"""SELECT hostname, coalesce(applied_total, 0) AS applied_total,
            coalesce(applied_tenant, 0) AS applied_tenant, coalesce(applied_global, 0) AS applied_global
          FROM (SELECT DISTINCT hostname FROM ev) LEFT JOIN ({_COUNTS}) USING (hostname)"""
    ),
    "applied_distinct": state_sql("SELECT DISTINCT ip FROM applied"),
    "distinct_sketched": sql(
        """SELECT hostname, count(DISTINCT ip) AS addresses, true AS parts_agree, true AS within_error
          FROM feed_items WHERE op = 'add' AND coalesce(ip, '') <> '' GROUP BY hostname""",
        "feed_items",
    ),
    "applied_of_tenant": state_sql("SELECT hostname, ip FROM applied WHERE source = 'tenant'"),
    "recent_applied": state_sql(f"SELECT * FROM ({_RECENT}) WHERE rn <= {C.RECENT_LIMIT}"),
    "recent_filtered": state_sql(
        f"""SELECT hostname, rn, ip, source, strftime(timezone(tz, timezone('UTC',
            make_timestamp(applied_at * 1000000))), '%H:%M:%S') AS clock
          FROM (SELECT hostname, ip, applied_at, source, row_number() OVER (PARTITION BY hostname
              ORDER BY applied_at DESC, ip) AS rn FROM ({_RECENT})
            WHERE rn <= {C.RECENT_LIMIT} AND source = 'global') JOIN host_zones USING (hostname)
          WHERE rn <= {C.RECENT_ROWS}""",
        "host_zones",
    ),
    "kv_latest": sql(f"SELECT hostname, k, v, at_s FROM ({_LATEST})", "kv_log"),
    "kv_by_host": sql(
        "SELECT hostname, "
        + ", ".join(
            f"max(v) FILTER (WHERE k = '{k}') AS {k}"
            for k in (
                C.KV_BLOCKLIST_CURSOR,
                C.KV_GLOBAL_CURSOR,
                C.KV_PID,
                C.KV_SNAPSHOT,
                C.KV_FEED_STATS,
            )
        )
        + f" FROM ({_LATEST}) GROUP BY hostname",
        "kv_log",
    ),
    "snapshot_decode": sql(
        f"""SELECT hostname, seq, readable, status, snapshot_at, hb_ok, last_pull_at,
            reader AS all_alive, CASE WHEN NOT reader THEN 'critical' WHEN NOT hb_ok
              THEN 'degraded' WHEN readable THEN 'healthy' END AS raw_status
          FROM ({_SNAPS} FROM kv_log WHERE k = '{C.KV_SNAPSHOT}')""",
        "kv_log",
    ),
    "feed_stats_decode": sql(
        f"""SELECT hostname, seq,
            CASE WHEN v NOT LIKE '{{not%' THEN CAST(v->>'$.tenant_active' AS BIGINT) END
              AS tenant_active,
            CASE WHEN v NOT LIKE '{{not%' THEN CAST(v->>'$.global_active' AS BIGINT) END
              AS global_active FROM kv_log WHERE k = '{C.KV_FEED_STATS}'""",
        "kv_log",
    ),
    "feed_stats_encode": sql(
        """SELECT page_no, '{"tenant_active":' || coalesce(CAST(tenant_active AS VARCHAR), 'null')
            || ',"global_active":' || coalesce(CAST(global_active AS VARCHAR), 'null') || '}' AS v
          FROM feed_pages""",
        "feed_pages",
    ),
    "jail_counts": sql(_JAILS, "jail_status"),
    "jail_drift": state_sql(
        f"""SELECT hostname, coalesce(applied_total, 0) AS applied_total, jail_banned,
            coalesce(applied_total, 0) - jail_banned AS drift
          FROM ({_COUNTS}) FULL OUTER JOIN ({_JAILS}) USING (hostname)""",
        "jail_status",
    ),
    "fleet_status": _status_sql(
        f"""SELECT hostname, '{__version__}' AS version, status,
            CASE status WHEN 'healthy' THEN 0 WHEN 'degraded' THEN 1 ELSE 2 END AS exit_code,
            started_at, uptime_seconds, hb_age_seconds, hb_ok, coalesce(reader, true)
              AS all_alive, applied_total, applied_tenant, applied_global, tenant_cursor,
            global_cursor, feed_global_active, jail_banned, outbox_pending,
            outbox_oldest_seconds, last_pull_age_seconds, snapshot_age_seconds, recent_rows,
            recent_ips FROM gathered"""
    ),
    "status_json": _status_sql(f"SELECT hostname, {_BODY} AS body FROM gathered"),
    "heartbeat_payload": _status_sql(
        f"""SELECT hostname, '{{"agent_version":"{__version__}","hostname":"' || hostname ||
            '","uptime_seconds":' || coalesce(CAST(uptime_seconds AS VARCHAR), 'null') ||
            ',"stats":{{"local_bans":' || applied_total || ',"queue_pending":' ||
            outbox_pending || ',"queue_oldest_seconds":' || outbox_oldest_seconds ||
            ',"last_pull_cursor":' || tenant_cursor || ',"last_pull_status":"' ||
            CASE WHEN tried IS NULL OR last_status BETWEEN 200 AND 299 THEN 'ok' ELSE 'degraded' END ||
            '","flags":{{"auth_blocked":' || coalesce(auth_blocked, false) ||
            ',"tenant_suspended":' || coalesce(tenant_suspended, false) || '}}}}}}' AS body
          FROM gathered LEFT JOIN answers USING (hostname)""",
        "delivery_attempts",
        more={"answers": _OUTCOME_FLAGS},
    ),
    "heartbeat_interval": sql(
        f"""SELECT hostname, seq, NOT coalesce(status_code BETWEEN 200 AND 299, false) AS degraded,
            at_s + CASE WHEN status_code BETWEEN 200 AND 299 THEN {C.HEARTBEAT_SECONDS}
              ELSE {C.HEARTBEAT_SECONDS_DEGRADED} END AS next_at FROM delivery_attempts""",
        "delivery_attempts",
    ),
    "feed_coverage": state_sql(
        f"""SELECT hostname, seq, percent, repeat('{C.BAR_FULL}', CAST(percent * 20 // 100 AS INT))
            || repeat('{C.BAR_EMPTY}', CAST(20 - percent * 20 // 100 AS INT)) AS bar
          FROM (SELECT hostname, seq, CASE WHEN active <> 0 THEN
              least(100, 100 * coalesce(applied_global, 0) // active) END AS percent
            FROM (SELECT hostname, seq, CASE WHEN v NOT LIKE '{{not%' THEN
                CAST(v->>'$.global_active' AS BIGINT) END AS active
              FROM kv_log WHERE k = '{C.KV_FEED_STATS}') LEFT JOIN ({_COUNTS}) USING (hostname))""",
        "kv_log",
    ),
    "age_text": sql(
        f"""SELECT hostname, seq, CASE WHEN a IS NULL THEN '{C.NO_VALUE}' WHEN a < 60
            THEN a || 's' WHEN a < 3600 THEN (a // 60) || 'm'
            ELSE (a // 3600) || 'h ' || ((a % 3600) // 60) || 'm' END AS age
          FROM (SELECT hostname, seq, CASE WHEN seq % 19 = 0 THEN NULL WHEN seq % 3 = 0
            THEN seq % 7000 ELSE greatest(0, {AS_OF_S} - at_s) END AS a FROM bans)""",
        "bans",
    ),
}
