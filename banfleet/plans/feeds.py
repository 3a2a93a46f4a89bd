"""Queries: blocklist feed and applied addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banfleet import constants as C
from banfleet.operators import feed as f
from banfleet.operators import status as st
from banfleet.plans import views as v
from banfleet.plans.views import AS_OF_S, sql
from banfleet.session import written
from banfleet.sources import pages as p

ONE_HOST = ("ip",)


_ITEM = ("ip", "op", "source")
_LOGGED_ITEM = (*_ITEM, "hostname", "at_s", "enforced")


def page_json(spark: SparkSession, sf: str, fields: tuple[str, ...] = _ITEM) -> DataFrame:
    """Pages as they land: JSON text, at most 200 items each."""
    item = F.struct("pos", *fields)
    items = (
        v.feed_items(spark, sf)
        .groupBy("page_no")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )
    headers = v.feed_pages(spark, sf)
    stats = F.when(F.col("has_stats"), F.struct("tenant_active", "global_active"))
    page = F.struct(
        "status_code",
        "cursor",
        "next_cursor",
        "global_cursor",
        F.transform("items", lambda i: F.struct(*[i[f].alias(f) for f in fields])).alias("items"),
        stats.alias("stats"),
    )
    return headers.join(items, "page_no").select("page_no", F.to_json(page).alias("body"))


def logged_page_json(spark: SparkSession, sf: str) -> DataFrame:
    """The same, with what became of each item on its host."""
    return page_json(spark, sf, _LOGGED_ITEM)


def _without_page_no(schema: str) -> str:
    return schema.removeprefix("page_no bigint, ")


def feed_explode(spark: SparkSession, sf: str) -> DataFrame:
    pages = p.parse_pages(page_json(spark, sf), "body", _without_page_no(p.DELTA_PAGE))
    return p.page_items(pages).select("page_no", "status_code", "pos", "ip", "op", "source")


def feed_headers(spark: SparkSession, sf: str) -> DataFrame:
    pages = p.parse_pages(page_json(spark, sf), "body", _without_page_no(p.DELTA_PAGE))
    return p.page_headers(pages)


def _full_items(spark: SparkSession, sf: str) -> DataFrame:
    return v.feed_items(spark, sf).where("op = 'add'")


def full_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot pages: the same, without operations, missing sources filled in."""
    item = F.struct("pos", "ip", "source")
    body = (
        _full_items(spark, sf)
        .groupBy("page_no")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select(
            "page_no",
            F.to_json(F.struct(F.transform(
                "items", lambda i: F.struct(i["ip"].alias("ip"), i["source"].alias("source"))
            ).alias("items"))).alias("body"),
        )
    )
    pages = p.parse_pages(body, "body", _without_page_no(p.FULL_PAGE))
    return f.valid_items(p.page_items(pages)).select("page_no", "pos", "ip", "source")


def cursor_progress(spark: SparkSession, sf: str) -> DataFrame:
    return f.cursor_progress(v.feed_pages(spark, sf)).select(
        "page_no", "cursor_before", "cursor_after", "global_before", "global_after"
    )


def _cycles(variant: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return f.pull_cycles(v.feed_pages(spark, sf, variant))

    return run


def _full_pages(spark: SparkSession, sf: str) -> DataFrame:
    return v.feed_pages(spark, sf).select(
        "page_no", "status_code", (F.col("page_no") + 1).alias("next_page")
    )


def full_sync_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Which snapshot pages a full sync applies before it meets a failed page."""
    return f.full_sync_pages(_full_pages(spark, sf)).select("page_no", "applied")


def ops(spark: SparkSession, sf: str) -> DataFrame:
    """Valid operations of the pages that arrived."""
    return f.valid_ops(f.of_consumed_pages(v.feed_items(spark, sf), v.feed_pages(spark, sf)))


def enforced_ops(spark: SparkSession, sf: str) -> DataFrame:
    return ops(spark, sf).where("enforced")


def applied_state(spark: SparkSession, sf: str) -> DataFrame:
    return f.apply_ops(enforced_ops(spark, sf), ONE_HOST)


def applied_fleet(spark: SparkSession, sf: str) -> DataFrame:
    return f.apply_ops(enforced_ops(spark, sf))


def last_ops(spark: SparkSession, sf: str) -> DataFrame:
    return f.last_ops(enforced_ops(spark, sf))


def _snapshot(spark: SparkSession, sf: str, keys=f.KEY) -> DataFrame:
    items = f.of_applied_pages(_full_items(spark, sf), _full_pages(spark, sf))
    return f.snapshot_rows(items.where("enforced"), AS_OF_S, keys)


def state_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The feed's operations merged into the state a full sync left."""
    return f.merge_ops(_snapshot(spark, sf), enforced_ops(spark, sf))


def unapplied_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Operations lost because the host could not enforce them."""
    return ops(spark, sf).where("NOT enforced").select(
        "hostname", "page_no", "pos", "ip", "op", "source"
    )


def pull_counters(spark: SparkSession, sf: str) -> DataFrame:
    cycles = f.pull_cycles(v.feed_pages(spark, sf))
    return f.op_counts(f.valid_ops(v.feed_items(spark, sf)), cycles)


def feed_stats_latest(spark: SparkSession, sf: str) -> DataFrame:
    return f.latest_stats(v.feed_pages(spark, sf))


def full_sync_merge(spark: SparkSession, sf: str) -> DataFrame:
    return f.merge_snapshot(applied_fleet(spark, sf), _snapshot(spark, sf))


def sync_drift(spark: SparkSession, sf: str) -> DataFrame:
    return f.drift(applied_fleet(spark, sf), _snapshot(spark, sf))


def feed_off(spark: SparkSession, sf: str) -> DataFrame:
    """Global addresses leave, but for IPv6 ones, which these hosts fail to unban."""
    current = written(applied_fleet(spark, sf), "applied")
    outcome = current.select("hostname", "ip", (~F.col("ip").contains(":")).alias("enforced"))
    return f.feed_off(current, outcome)


def feed_off_keys(spark: SparkSession, sf: str) -> DataFrame:
    """All applied addresses less the global ones, as sets."""
    current = written(applied_fleet(spark, sf), "applied")
    return current.select("hostname", "ip").exceptAll(
        current.where(F.col("source") == C.GLOBAL_SOURCE).select("hostname", "ip")
    )


def active_bans(spark: SparkSession, sf: str) -> DataFrame:
    return f.active(applied_fleet(spark, sf), AS_OF_S)


def feed_union(spark: SparkSession, sf: str) -> DataFrame:
    items = f.valid_items(v.feed_items(spark, sf)).select("page_no", "pos", "ip", "op", "source")
    tenant = items.where(F.col("source") == C.DEFAULT_SOURCE).drop("source")
    other = items.where(F.col("source") == C.GLOBAL_SOURCE).drop("source")
    return f.union_feeds(tenant, other)


def feed_tenant_only(spark: SparkSession, sf: str) -> DataFrame:
    """Applied addresses of a host that does not take the global feed."""
    items = f.of_consumed_pages(v.feed_items(spark, sf), v.feed_pages(spark, sf))
    return f.apply_ops(f.valid_ops(items, include_global=False).where("enforced"))


def full_sync_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Per host: does it need a full sync, and why."""
    stored = st.latest_values(v.kv_log(spark, sf).where(F.col("k") == C.KV_PID)).select(
        "hostname", F.col("v").try_cast("bigint").alias("stored_pid")
    )
    counts = applied_fleet(spark, sf).groupBy("hostname").agg(
        F.count("*").alias("applied_total")
    )
    number = F.substring("hostname", 5, 2).cast("int")
    current = (
        F.when(number % 4 == 0, F.lit(None))
        .when(number % 4 == 1, F.col("stored_pid"))
        .otherwise(F.lit(4242))
        .cast("bigint")
    )
    gathered = (
        v.hosts(spark, sf)
        .join(stored, "hostname", "left")
        .join(counts, "hostname", "left")
        # every sixth host starts from an empty state
        .withColumn("applied_total", F.when(number % 6 == 5, 0).otherwise(
            F.coalesce("applied_total", F.lit(0))).cast("bigint"))
        .withColumn("current_pid", current)
        # and every third has never stored a process id
        .withColumn("stored_pid", F.when(number % 3 != 0, F.col("stored_pid")))
    )
    reason = f.full_sync_decision()
    return gathered.select(
        "hostname", reason.isNotNull().alias("full_sync"), reason.alias("reason")
    )


QUERIES = {
    "feed_explode": feed_explode,
    "feed_headers": feed_headers,
    "full_explode": full_explode,
    "cursor_progress": cursor_progress,
    "feed_drain_pages": _cycles("mixed"),
    "feed_drain_pages_more": _cycles("more"),
    "feed_drain_pages_endless": _cycles("endless"),
    "full_sync_pages": full_sync_pages,
    "applied_state": applied_state,
    "applied_fleet": applied_fleet,
    "last_ops": last_ops,
    "state_merge": state_merge,
    "unapplied_ops": unapplied_ops,
    "pull_counters": pull_counters,
    "feed_stats_latest": feed_stats_latest,
    "full_sync_merge": full_sync_merge,
    "sync_drift": sync_drift,
    "feed_off": feed_off,
    "feed_off_keys": feed_off_keys,
    "active_bans": active_bans,
    "feed_union": feed_union,
    "feed_tenant_only": feed_tenant_only,
    "full_sync_decision": full_sync_decision,
}

_VALID = "coalesce(ip, '') <> ''"
_SRC = "coalesce(source, 'tenant')"
_OPS = f"""SELECT i.hostname, i.page_no, i.pos, i.at_s, i.ip, i.op, {_SRC} AS source, i.enforced
  FROM feed_items i JOIN feed_pages p USING (page_no)
  WHERE p.status_code = 200 AND {_VALID} AND i.op IN ('add', 'remove')"""


def _last(keys: str, source: str = "ops") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys}
      ORDER BY page_no DESC, pos DESC) AS rn FROM {source} WHERE enforced) WHERE rn = 1"""


_APPLIED = """SELECT hostname, ip, at_s AS applied_at, source FROM last_op WHERE op = 'add'"""
# a full sync ends at the first page that failed, or isn't there
_STOP = """(SELECT coalesce(min(p.page_no), 9223372036854775807) FROM feed_pages p
  WHERE p.status_code <> 200 OR (p.page_no > 1 AND NOT EXISTS
    (SELECT 1 FROM feed_pages q WHERE q.page_no = p.page_no - 1)))"""
_SNAP = f"""SELECT hostname, ip, CAST({AS_OF_S} AS BIGINT) AS applied_at, source FROM (
    SELECT hostname, ip, {_SRC} AS source, row_number() OVER (PARTITION BY hostname, ip
      ORDER BY page_no DESC, pos DESC) AS rn FROM feed_items
    WHERE op = 'add' AND enforced AND {_VALID} AND page_no < {_STOP}) WHERE rn = 1"""
_STATE = {"ops": _OPS, "last_op": _last("hostname, ip"), "applied": _APPLIED, "snap": _SNAP}


def state_sql(body: str, *more: str) -> str:
    return sql(body, "feed_items", "feed_pages", *more, extra=_STATE)


def _cycle_ctes(pages: str, cap: int = C.DELTA_PAGE_CAP) -> dict[str, str]:
    return {
        "c1": f"""SELECT *, row_number() OVER (ORDER BY page_no) AS place,
            greatest(0, max(CASE WHEN status_code = 200 THEN cursor END) OVER (ORDER BY page_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS cursor_before,
            greatest(0, max(CASE WHEN status_code = 200 THEN cursor END)
              OVER (ORDER BY page_no ROWS UNBOUNDED PRECEDING)) AS cursor_after,
            greatest(0, max(CASE WHEN status_code = 200 THEN global_cursor END) OVER (
              ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
              AS global_before,
            greatest(0, max(CASE WHEN status_code = 200 THEN global_cursor END)
              OVER (ORDER BY page_no ROWS UNBOUNDED PRECEDING)) AS global_after FROM {pages}""",
        "c2": """SELECT *, CASE WHEN status_code <> 200 THEN 'error' WHEN next_cursor IS NULL
            AND NOT coalesce(global_cursor > global_before, false) THEN 'drained' END AS why
            FROM c1""",
        "c3": """SELECT *, place - 1 - coalesce(max(CASE WHEN why IS NOT NULL THEN place END) OVER
            (ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS in_run
            FROM c2""",
        "cycles": f"""SELECT page_no, CAST(sum(CASE WHEN in_run % {cap} = 0 THEN 1 ELSE 0 END)
            OVER (ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cycle_no,
            status_code = 200 AS consumed, cursor_after, global_after,
            coalesce(why, CASE WHEN in_run % {cap} = {cap} - 1 THEN 'cap' END) AS end_reason
            FROM c3""",
    }


def _cycle_sql(pages: str) -> str:
    return sql("SELECT * FROM cycles", pages, extra=_cycle_ctes(pages))


ORACLES = {
    "feed_explode": sql(
        """SELECT page_no, status_code, pos, ip, op, source FROM feed_items
           JOIN feed_pages USING (page_no)""",
        "feed_items",
        "feed_pages",
    ),
    "feed_headers": sql(
        """SELECT page_no, status_code, cursor, next_cursor, global_cursor,
            has_stats, tenant_active, global_active
          FROM feed_pages""",
        "feed_pages",
    ),
    "full_explode": sql(
        f"""SELECT * FROM (SELECT page_no, ip, {_SRC} AS source,
              row_number() OVER (PARTITION BY page_no ORDER BY pos) - 1 AS pos
            FROM feed_items WHERE op = 'add') WHERE {_VALID}""",
        "feed_items",
    ),
    "cursor_progress": sql(
        """SELECT page_no, cursor_before, cursor_after, global_before, global_after FROM c1""",
        "feed_pages",
        extra=_cycle_ctes("feed_pages"),
    ),
    "feed_drain_pages": _cycle_sql("feed_pages"),
    "feed_drain_pages_more": _cycle_sql("feed_pages_more"),
    "feed_drain_pages_endless": _cycle_sql("feed_pages_endless"),
    "full_sync_pages": sql(
        f"SELECT page_no, page_no < {_STOP} AS applied FROM feed_pages",
        "feed_pages",
    ),
    "applied_state": sql(
        "SELECT ip, at_s AS applied_at, source FROM last_op WHERE op = 'add'",
        "feed_items",
        "feed_pages",
        extra={"ops": _OPS, "last_op": _last("ip")},
    ),
    "applied_fleet": state_sql("SELECT * FROM applied"),
    "last_ops": state_sql("SELECT hostname, ip, op, source, at_s AS applied_at FROM last_op"),
    "state_merge": state_sql(
        """SELECT hostname, ip, coalesce(l.at_s, s.applied_at) AS applied_at,
            coalesce(l.source, s.source) AS source
          FROM snap s FULL OUTER JOIN last_op l USING (hostname, ip)
          WHERE l.op IS NULL OR l.op = 'add'"""
    ),
    "unapplied_ops": state_sql(
        "SELECT hostname, page_no, pos, ip, op, source FROM ops WHERE NOT enforced"
    ),
    "pull_counters": sql(
        f"""SELECT cycle_no, count(DISTINCT c.page_no) AS pages,
            count(*) FILTER (WHERE consumed AND op = 'add') AS added,
            count(*) FILTER (WHERE consumed AND op = 'remove') AS removed
          FROM cycles c LEFT JOIN (SELECT * FROM feed_items WHERE {_VALID} AND enforced) i
            ON c.page_no = i.page_no GROUP BY cycle_no""",
        "feed_items",
        "feed_pages",
        extra=_cycle_ctes("feed_pages"),
    ),
    "feed_stats_latest": sql(
        """SELECT page_no, coalesce(tenant_active, 0) AS tenant_active,
            coalesce(global_active, 0) AS global_active FROM feed_pages
           WHERE status_code = 200 AND has_stats ORDER BY page_no DESC LIMIT 1""",
        "feed_pages",
    ),
    "full_sync_merge": state_sql(
        """SELECT * FROM snap UNION ALL SELECT * FROM applied a WHERE NOT EXISTS
           (SELECT 1 FROM snap s WHERE s.hostname = a.hostname AND s.ip = a.ip)"""
    ),
    "sync_drift": state_sql(
        """SELECT hostname, ip, 'applied_only' AS side FROM
            (SELECT hostname, ip FROM applied EXCEPT SELECT hostname, ip FROM snap)
          UNION ALL SELECT hostname, ip, 'feed_only' AS side FROM
            (SELECT hostname, ip FROM snap EXCEPT SELECT hostname, ip FROM applied)"""
    ),
    "feed_off": state_sql(
        "SELECT * FROM applied WHERE NOT (source = 'global' AND NOT contains(ip, ':'))"
    ),
    "feed_off_keys": state_sql("SELECT hostname, ip FROM applied WHERE source <> 'global'"),
    "active_bans": state_sql(
        f"SELECT * FROM applied WHERE applied_at + {C.BAN_SECONDS} > {AS_OF_S}"
    ),
    "feed_union": sql(
        f"SELECT page_no, pos, ip, op, {_SRC} AS source FROM feed_items WHERE {_VALID}",
        "feed_items",
    ),
    "feed_tenant_only": sql(
        "SELECT hostname, ip, at_s AS applied_at, source FROM last_op WHERE op = 'add'",
        "feed_items",
        "feed_pages",
        extra={
            "ops": f"SELECT * FROM ({_OPS}) WHERE source <> 'global'",
            "last_op": _last("hostname, ip"),
        },
    ),
    "full_sync_decision": state_sql(
        """SELECT hostname, reason IS NOT NULL AS full_sync, reason FROM (
          SELECT hostname, CASE WHEN applied_total = 0 THEN 'first_boot_no_applied_ips'
            WHEN stored IS NULL AND cur IS NOT NULL THEN 'first_pid_snapshot'
            WHEN stored <> cur THEN 'pid_changed_old_' || stored || '_new_' || cur END AS reason
          FROM (SELECT hostname, CASE WHEN n % 6 = 5 THEN 0 ELSE coalesce(total, 0) END
              AS applied_total, CASE WHEN n % 3 <> 0 THEN pid END AS stored,
            CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN pid ELSE 4242 END AS cur
            FROM (SELECT DISTINCT hostname, CAST(substr(hostname, 5, 2) AS INT) AS n FROM ev)
            LEFT JOIN (SELECT hostname, TRY_CAST(arg_max(v, seq) AS BIGINT) AS pid FROM kv_log
              WHERE k = 'fail2ban_pid' GROUP BY 1) USING (hostname)
            LEFT JOIN (SELECT hostname, count(*) AS total FROM applied GROUP BY 1)
              USING (hostname)))""",
        "kv_log",
    ),
}
