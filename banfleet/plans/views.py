"""Input tables of the fleet, derived from the given tables.

Each view exists twice: as a DataFrame and as a SQL common table expression, so
that a query and its SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banfleet.functions.banlog import BAN_LINE, iso_text, local_to_utc, parse_bans
from banfleet.operators.lookup import with_values
from banfleet.operators.running import running, running_count
from banfleet.session import written

_HOST = "concat('srv-', lpad(CAST(user_id % 12 AS STRING), 2, '0'))"
_IP = """CASE WHEN event_id % 103 = 0 THEN '256.1.1.1'
    WHEN event_id % 7 = 0 THEN concat('2001:db8::', CAST(user_id % 10000 AS STRING))
    ELSE concat('198.51.', CAST(user_id % 256 AS STRING), '.', CAST(k % 4 AS STRING)) END"""
_JAIL = """CASE event_type WHEN 'click' THEN 'sshd' WHEN 'view' THEN 'wp-login'
    WHEN 'purchase' THEN 'postfix-sasl' WHEN 'error' THEN 'nginx_http' ELSE 'recidive' END"""
_LINE = """CASE WHEN event_id % 97 = 0 THEN 'random text' ELSE concat(
    CASE WHEN event_id % 101 = 0 THEN '2024-02-30' ELSE substr(CAST(ts AS STRING), 1, 10) END,
    substr(CAST(ts AS STRING), 11, 9), ',', lpad(CAST(event_id % 1000 AS STRING), 3, '0'),
    ' fail2ban.actions [', CAST(user_id + 1000 AS STRING), ']: NOTICE  [', jail, '] ',
    CASE event_id % 10 WHEN 7 THEN 'Unban' WHEN 8 THEN 'Found' WHEN 9 THEN 'Restore Ban'
    ELSE 'Ban' END, ' ', ip) END"""
_ZONE = """CASE CAST(substr(hostname, 5, 2) AS INT) % 3 WHEN 0 THEN 'UTC'
    WHEN 1 THEN 'Europe/Madrid' ELSE 'America/New_York' END"""
_FEED_IP = "CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN '' ELSE ip END"
_OP = "CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'noop' ELSE 'add' END"
_SOURCE = "CASE WHEN k < 30 THEN 'tenant' WHEN k < 90 THEN 'global' ELSE NULL END"
_STATUS = """CASE WHEN k < 70 THEN 202 WHEN k < 78 THEN 503 WHEN k < 84 THEN 429
    WHEN k < 88 THEN 422 WHEN k < 92 THEN 403 WHEN k < 95 THEN 401 ELSE NULL END"""
_ERROR = """CASE WHEN k BETWEEN 88 AND 89 THEN 'tenant_suspended'
    WHEN k = 90 THEN 'plan_quota_exceeded' WHEN k = 91 THEN 'forbidden' END"""
_RETRY_AFTER = """CASE WHEN k BETWEEN 78 AND 83 THEN CASE k WHEN 78 THEN '30' WHEN 79 THEN '-5'
    WHEN 80 THEN 'soon' WHEN 81 THEN '' WHEN 82 THEN ' 120 ' ELSE NULL END END"""
_SNAPSHOT_JSON = """concat('{"status": "', CASE WHEN k < 60 THEN 'healthy' WHEN k < 80
    THEN 'degraded' ELSE 'critical' END, '", "snapshot_at": ', CAST(at_s AS STRING),
    ', "started_at": ', CAST(at_s - 1000 AS STRING), ', "hb_ok": ',
    CASE WHEN k < 60 THEN 'true' ELSE 'false' END,
    ', "hb_last_at": ', CAST(at_s - 30 AS STRING), ', "last_pull_at": ',
    CASE WHEN k % 4 = 0 THEN 'null' ELSE CAST(at_s - 200 AS STRING) END,
    ', "last_flush_at": ', CAST(at_s - 5 AS STRING),
    ', "threads": {"reader": ', CASE WHEN k % 10 = 4 AND user_id % 2 = 0 THEN 'false' ELSE 'true' END,
    ', "sender": true, "puller": true, "heartbeat": true}}')"""
_FEED_STATS_JSON = """concat('{"tenant_active": ', CAST(user_id AS STRING),
    ', "global_active": ', CAST(k * 100 AS STRING), '}')"""
_KV_KEY = """CASE k % 5 WHEN 0 THEN 'blocklist_cursor' WHEN 1 THEN 'global_cursor'
    WHEN 2 THEN 'fail2ban_pid' WHEN 3 THEN 'feed_stats' ELSE 'status_snapshot' END"""
_KV_VALUE = f"""CASE WHEN event_id % 29 = 0 THEN '{{not json'
    WHEN k % 5 <= 2 THEN CAST(event_id AS STRING)
    WHEN k % 5 = 3 THEN {_FEED_STATS_JSON} ELSE {_SNAPSHOT_JSON} END"""
_SETTING = """CASE k % 2 WHEN 0 THEN
    CASE WHEN k < 40 THEN 'AUTO' WHEN k < 80 THEN '/var/log/fail2ban.log' ELSE 'SYSLOG' END
    ELSE CASE WHEN k < 30 THEN concat(chr(9), 'Yes ', chr(10)) WHEN k < 60 THEN 'off' WHEN k < 80 THEN ''
    ELSE 'TRUE' END END"""
_INSTALL_EVENT = """CASE WHEN k < 70 THEN 'step' WHEN k < 85 THEN 'warn' WHEN k < 92 THEN 'error'
    WHEN k < 96 THEN 'start' ELSE 'success' END"""
_STEP = """CASE user_id % 5 WHEN 0 THEN 'boot' WHEN 1 THEN 'preflight' WHEN 2 THEN 'api_test'
    WHEN 3 THEN 'venv_setup' ELSE 'service_start' END"""
_ERROR_CODE = """CASE WHEN k BETWEEN 85 AND 91 THEN
    concat('http_', CAST(400 + k AS STRING)) END"""
_API_KEY = """concat(CASE s_suppkey % 4 WHEN 0 THEN 'ab_test_' WHEN 1 THEN 'key_'
    ELSE 'ab_live_' END,
    lpad(CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 9 = 0 THEN 8 ELSE 20 END, 'A0'))"""
_VERSION_TEXT = """concat('Fail2Ban v', CAST(s_suppkey % 2 AS STRING), '.',
    CAST(s_suppkey % 13 AS STRING), '.', CAST(s_suppkey % 3 AS STRING))"""

# The latest second of the tables plus a minute: "now" for every age.
AS_OF = "CAST(1706659200 AS BIGINT)"
AS_OF_S = 1706659200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_host(events: DataFrame) -> DataFrame:
    """``ev``: events as fleet activity. Works on a batch or a stream."""
    return events.selectExpr(
        "*",
        "unix_seconds(CAST(ts AS TIMESTAMP)) AS at_s",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k",
        f"{_HOST} AS hostname",
        f"{_JAIL} AS jail",
    ).selectExpr("*", f"{_IP} AS ip")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_host(table(spark, sf_dir, "events"))


def as_lines(events: DataFrame) -> DataFrame:
    """Log lines. The generator makes ``line`` a column like one that was read: it is
    put together once, however many conditions on it follow."""
    return with_host(events).selectExpr(
        "hostname", "event_id AS seq", "at_s", f"explode(array({_LINE})) AS line"
    )


def ban_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_lines(table(spark, sf_dir, "events"))


def host_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "events").selectExpr(f"{_HOST} AS hostname").distinct()
    return hosts.selectExpr("hostname", f"{_ZONE} AS tz")


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(f"{_HOST} AS hostname").distinct()


def queued_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue rows before they are numbered: what depth, age and expiry need. Times are UTC."""
    bans = with_values(parse_bans(ban_log_lines(spark, sf_dir)), host_zones(spark, sf_dir), ["hostname"], "seq")
    return bans.select(
        "hostname",
        "seq",
        "jail",
        "ip",
        iso_text(local_to_utc("local_ts", "tz")).alias("banned_at"),
        F.col("at_s").alias("enqueued_at"),
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue of every host, numbered from 1.

    The queue is a stored table: the lines are parsed once, and numbering reads
    the far fewer bans twice.
    """
    bans = written(queued_bans(spark, sf_dir), "queue")
    return running(bans, ["hostname"], "seq", {"id": running_count()}).select("hostname", "id", "jail", "ip", "banned_at", "enqueued_at")


FEED_COLUMNS = (
    "hostname",
    "CAST(floor(event_id / 200) AS BIGINT) + 1 AS page_no",
    "event_id % 200 AS pos",
    "at_s",
    f"{_FEED_IP} AS ip",
    f"{_OP} AS op",
    f"{_SOURCE} AS source",
    "event_id % 41 <> 0 AS enforced",
)


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).selectExpr(*FEED_COLUMNS)


def feed_pages(spark: SparkSession, sf_dir: str, variant: str = "mixed") -> DataFrame:
    """Page headers. Variants: ``mixed``, ``more`` (a next page everywhere),
    ``endless`` (the same without the error)."""
    status = "200" if variant == "endless" else "CASE WHEN page_no = 40 THEN 500 ELSE 200 END"
    following = "CASE WHEN page_no % 6 = 0 THEN NULL ELSE page_no END"
    return (
        ev(spark, sf_dir)
        .selectExpr("CAST(floor(event_id / 200) AS BIGINT) + 1 AS page_no", "event_id", "k")
        .groupBy("page_no")
        .agg(
            F.expr("max(event_id) FILTER (WHERE k < 30 OR k >= 90)").alias("cursor"),
            F.expr("max(event_id) FILTER (WHERE k BETWEEN 30 AND 89)").alias("_global"),
            F.count("*").alias("_n"),
        )
        .selectExpr(
            "page_no",
            f"{status} AS status_code",
            "cursor",
            f"{following if variant == 'mixed' else 'page_no'} AS next_cursor",
            "CASE WHEN page_no % 12 <> 0 THEN _global END AS global_cursor",
            "page_no % 3 <> 0 AS has_stats",
            "CASE WHEN page_no % 3 <> 0 AND page_no % 5 <> 2 THEN _n END AS tenant_active",
            "CASE WHEN page_no % 3 <> 0 AND page_no % 25 <> 2 THEN _n * 10 END AS global_active",
        )
    )


def delivery_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).selectExpr(
        "hostname",
        "event_id AS seq",
        "at_s",
        f"{_STATUS} AS status_code",
        f"{_ERROR} AS error",
        f"{_RETRY_AFTER} AS retry_after",
    )


def breaker_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).selectExpr("hostname", "event_id AS seq", "at_s", "k < 40 AS ok")


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).selectExpr(
        "hostname", "at_s", "event_id AS seq", f"{_KV_KEY} AS k", f"{_KV_VALUE} AS v"
    )


def jail_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        ev(spark, sf_dir)
        .groupBy("hostname")
        .agg(F.count("*").alias("n"))
        .selectExpr(
            "hostname",
            "CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS rc",
            r"""concat('Status for the jail: x', chr(10), '   |- Currently banned: ',
                CASE WHEN n % 7 = 0 THEN 'garbage' ELSE CAST(n AS STRING) END, chr(10),
                '   `- Total banned: 100') AS out""",
        )
    )


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two setting files per host."""
    return ev(spark, sf_dir).selectExpr(
        "hostname",
        "CASE WHEN k % 3 = 0 THEN 'local' ELSE 'conf' END AS file",
        "event_id AS line_no",
        "CASE k % 2 WHEN 0 THEN 'logtarget' ELSE 'include_global' END AS key",
        f"{_SETTING} AS value",
    )


def install_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).selectExpr(
        "hostname",
        "at_s",
        "event_id AS seq",
        f"{_INSTALL_EVENT} AS event",
        f"{_STEP} AS step_name",
        f"{_ERROR_CODE} AS error_code",
    )


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('srv-', lpad(CAST(s_suppkey % 12 AS STRING), 2, '0')) AS hostname",
        "s_suppkey AS agent_id",
        f"{_API_KEY} AS api_key",
        f"{_VERSION_TEXT} AS version_text",
    )


# The same views in SQL.
_BAN_LINE_SQL = BAN_LINE.replace("'", "''")
_PAGE_SQL = """SELECT page_no, {status} AS status_code, cursor, {following} AS next_cursor,
    CASE WHEN page_no % 12 <> 0 THEN g END AS global_cursor,
    page_no % 3 <> 0 AS has_stats,
    CASE WHEN page_no % 3 <> 0 AND page_no % 5 <> 2 THEN n END AS tenant_active,
    CASE WHEN page_no % 3 <> 0 AND page_no % 25 <> 2 THEN n * 10 END AS global_active
  FROM (SELECT CAST(floor(event_id / 200) AS BIGINT) + 1 AS page_no,
      max(event_id) FILTER (WHERE k < 30 OR k >= 90) AS cursor,
      max(event_id) FILTER (WHERE k BETWEEN 30 AND 89) AS g, count(*) AS n
    FROM ev GROUP BY 1)"""
_ERR40 = "CASE WHEN page_no = 40 THEN 500 ELSE 200 END"
_SIXTH = "CASE WHEN page_no % 6 = 0 THEN NULL ELSE page_no END"

# name -> (views it reads, SQL)
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": (
        (),
        f"""SELECT *, {_IP} AS ip FROM (SELECT *, epoch_us(ts) // 1000000 AS at_s,
            CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
            {_HOST} AS hostname, {_JAIL} AS jail FROM events)""",
    ),
    "ban_log_lines": (
        ("ev",),
        f"SELECT hostname, event_id AS seq, at_s, {_LINE} AS line FROM ev",
    ),
    "bans": (
        ("ban_log_lines",),
        f"""SELECT hostname, seq, at_s, jail, ip, local_ts FROM (
            SELECT hostname, seq, at_s,
              regexp_extract(line, '{_BAN_LINE_SQL}', 2) AS jail,
              regexp_extract(line, '{_BAN_LINE_SQL}', 3) AS ip,
              TRY_CAST(regexp_extract(line, '{_BAN_LINE_SQL}', 1) AS TIMESTAMP) AS local_ts
            FROM ban_log_lines) WHERE ip <> '' AND local_ts IS NOT NULL""",
    ),
    "host_zones": (
        ("ev",),
        f"SELECT hostname, {_ZONE} AS tz FROM (SELECT DISTINCT hostname FROM ev)",
    ),
    "bans_utc": (
        ("bans", "host_zones"),
        """SELECT hostname, seq, at_s, jail, ip,
            timezone('UTC', timezone(tz, local_ts)) AS utc_ts
          FROM bans JOIN host_zones USING (hostname)""",
    ),
    "outbox": (
        ("bans_utc",),
        """SELECT hostname, row_number() OVER (PARTITION BY hostname ORDER BY seq) AS id,
            jail, ip, strftime(utc_ts, '%Y-%m-%dT%H:%M:%SZ') AS banned_at,
            at_s AS enqueued_at FROM bans_utc""",
    ),
    "feed_items": (
        ("ev",),
        f"""SELECT hostname, CAST(floor(event_id / 200) AS BIGINT) + 1 AS page_no,
            event_id % 200 AS pos,
            at_s, {_FEED_IP} AS ip, {_OP} AS op, {_SOURCE} AS source,
            event_id % 41 <> 0 AS enforced FROM ev""",
    ),
    "feed_pages": (("ev",), _PAGE_SQL.format(status=_ERR40, following=_SIXTH)),
    "feed_pages_more": (("ev",), _PAGE_SQL.format(status=_ERR40, following="page_no")),
    "feed_pages_endless": (("ev",), _PAGE_SQL.format(status="200", following="page_no")),
    "delivery_attempts": (
        ("ev",),
        f"""SELECT hostname, event_id AS seq, at_s, {_STATUS} AS status_code,
            {_ERROR} AS error, {_RETRY_AFTER} AS retry_after FROM ev""",
    ),
    "breaker_attempts": (
        ("ev",),
        """SELECT hostname, event_id AS seq, at_s, k < 40 AS ok,
            row_number() OVER (PARTITION BY hostname ORDER BY event_id) AS rn FROM ev""",
    ),
    "kv_log": (
        ("ev",),
        f"SELECT hostname, at_s, event_id AS seq, {_KV_KEY} AS k, {_KV_VALUE} AS v FROM ev",
    ),
    "jail_status": (
        ("ev",),
        """SELECT hostname, CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS rc,
            concat('Status for the jail: x', chr(10), '   |- Currently banned: ',
              CASE WHEN n % 7 = 0 THEN 'garbage' ELSE CAST(n AS STRING) END, chr(10),
              '   `- Total banned: 100') AS out
          FROM (SELECT hostname, count(*) AS n FROM ev GROUP BY 1)""",
    ),
    "settings": (
        ("ev",),
        f"""SELECT hostname, CASE WHEN k % 3 = 0 THEN 'local' ELSE 'conf' END AS file,
            event_id AS line_no,
            CASE k % 2 WHEN 0 THEN 'logtarget' ELSE 'include_global' END AS key,
            {_SETTING} AS value FROM ev""",
    ),
    "install_events": (
        ("ev",),
        f"""SELECT hostname, at_s, event_id AS seq, {_INSTALL_EVENT} AS event,
            {_STEP} AS step_name, {_ERROR_CODE} AS error_code FROM ev""",
    ),
    "agents": (
        (),
        f"""SELECT concat('srv-', lpad(CAST(s_suppkey % 12 AS STRING), 2, '0')) AS hostname,
            s_suppkey AS agent_id, {_API_KEY} AS api_key, {_VERSION_TEXT} AS version_text
          FROM supplier""",
    ),
}


def sql(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """A full SQL text: the views ``body`` reads, in order, then ``body``."""
    chosen: dict[str, str] = {}

    def add(name: str) -> None:
        if name in chosen:
            return
        needs, text = SQL_VIEWS[name]
        for need in needs:
            add(need)
        chosen[name] = text

    for view in views:
        add(view)
    chosen.update(extra or {})
    if not chosen:
        return body
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in chosen.items())
    return f"WITH {ctes}\n{body}"
