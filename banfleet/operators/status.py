"""Fleet status: latest values, counts and the one row per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banfleet import __version__
from banfleet import constants as C
from banfleet.functions import health as h
from banfleet.functions import jsontext as j
from banfleet.operators.running import top_n


def latest_values(log: DataFrame) -> DataFrame:
    """Last written value per ``(hostname, k)`` from an append-only log."""
    last = F.max(F.struct("at_s", "seq", "v")).alias("_last")
    return log.groupBy("hostname", "k").agg(last).select("hostname", "k", "_last.v", "_last.at_s")


def latest_by_host(log: DataFrame) -> DataFrame:
    """The same with one column per key: one pass, one shuffle of partial results."""

    def last(key: str) -> Column:
        return F.max(F.when(F.col("k") == key, F.struct("at_s", "seq", "v")))["v"].alias(key)

    return log.groupBy("hostname").agg(
        *[
            last(key)
            for key in (
                C.KV_BLOCKLIST_CURSOR,
                C.KV_GLOBAL_CURSOR,
                C.KV_PID,
                C.KV_SNAPSHOT,
                C.KV_FEED_STATS,
            )
        ]
    )


def decoded(latest: DataFrame) -> DataFrame:
    """Latest values with their types; damaged JSON counts as absent."""
    zero = F.lit(0).cast("bigint")
    return latest.select(
        "hostname",
        F.coalesce(F.col(C.KV_BLOCKLIST_CURSOR).try_cast("bigint"), zero).alias("tenant_cursor"),
        F.coalesce(F.col(C.KV_GLOBAL_CURSOR).try_cast("bigint"), zero).alias("global_cursor"),
        F.col(C.KV_PID).try_cast("bigint").alias("stored_pid"),
        j.decode(F.col(C.KV_SNAPSHOT), j.SNAPSHOT).alias("snapshot"),
        j.decode(F.col(C.KV_FEED_STATS), j.FEED_STATS).alias("feed_stats"),
    )


_COUNTS = ("applied_total", "applied_tenant", "applied_global")


def applied_counts(applied: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Applied addresses per host; with ``hosts``, also of those that have none."""
    counts = applied.groupBy("hostname").agg(
        F.count("*").alias("applied_total"),
        F.count_if(F.col("source") == "tenant").alias("applied_tenant"),
        F.count_if(F.col("source") == "global").alias("applied_global"),
    )
    if hosts is None:
        return counts
    return hosts.select("hostname").join(counts, "hostname", "left").fillna(0, _COUNTS)


def of_source(applied: DataFrame, source: str) -> DataFrame:
    return applied.where(F.col("source") == source)


def distinct_addresses(applied: DataFrame) -> DataFrame:
    return applied.select("ip").distinct()


def recent(applied: DataFrame, limit: int = C.RECENT_LIMIT) -> DataFrame:
    """The newest applied addresses per host; equal times are ordered by address."""
    return top_n(applied, ["hostname"], [F.col("applied_at").desc(), F.col("ip")], limit)


def recent_filtered(
    applied: DataFrame,
    source: str = "all",
    rows: int = C.RECENT_ROWS,
    limit: int = C.RECENT_LIMIT,
) -> DataFrame:
    """What a status screen lists: newest first, then the source filter, then ``rows``."""
    newest = recent(applied, limit).drop("rn")
    if source != "all":
        newest = of_source(newest, source)
    place = Window.partitionBy("hostname").orderBy(F.col("applied_at").desc(), "ip")
    return newest.withColumn("rn", F.row_number().over(place).cast("bigint")).where(F.col("rn") <= rows)


def jail_counts(jail_status: DataFrame) -> DataFrame:
    return jail_status.select(
        "hostname", h.jail_count(F.col("rc"), F.col("out")).alias("jail_banned")
    )


def jail_drift(counts: DataFrame, jails: DataFrame) -> DataFrame:
    """Applied addresses against what the jail itself reports, for every host of either side."""
    applied = F.coalesce("applied_total", F.lit(0))
    return counts.join(jails, "hostname", "full_outer").select(
        "hostname",
        applied.alias("applied_total"),
        "jail_banned",
        (applied - F.col("jail_banned")).alias("drift"),
    )


def gather(
    hosts: DataFrame,
    latest: DataFrame,
    counts: DataFrame,
    queue: DataFrame,
    jails: DataFrame,
    recent_rows: DataFrame,
    *,
    as_of: int,
    backend_url: str = "",
    jail_name: str = "",
    include_global: bool = True,
    heartbeat_seconds: int = C.HEARTBEAT_SECONDS,
    version: str = __version__,
) -> DataFrame:
    """One status row per host, also for hosts that never reported.

    All inputs have at most one row per host (``recent_rows`` a bounded number),
    so Spark chooses the joins by their size at run time.
    """
    lists = recent_rows.groupBy("hostname").agg(
        F.array_sort(F.collect_list(F.struct("rn", "ip", "applied_at", "source"))).alias("_recent")
    )
    joined = hosts
    for side in (decoded(latest), counts, queue, jails, lists):
        joined = joined.join(side, "hostname", "left")
    snap = F.col("snapshot")
    zero = F.lit(0).cast("bigint")

    def since(name: str) -> Column:
        return h.age_seconds(as_of, snap[name])

    snapshot_age = since("snapshot_at")
    no_threads = F.create_map().cast("map<string, boolean>")
    no_recent = F.array().cast("array<struct<ip: string, applied_at: bigint, source: string>>")
    return joined.select(
        F.lit(version).alias("version"),
        "hostname",
        h.effective_status(snap["status"], snapshot_age, heartbeat_seconds * 2).alias("status"),
        snap["started_at"].alias("started_at"),
        since("started_at").alias("uptime_seconds"),
        snap["hb_last_at"].alias("hb_last_at"),
        since("hb_last_at").alias("hb_age_seconds"),
        F.coalesce(snap["hb_ok"], F.lit(False)).alias("hb_ok"),
        F.coalesce(snap["threads"], no_threads).alias("threads"),
        F.lit(backend_url).alias("backend_url"),
        F.lit(include_global).alias("feed_global_enabled"),
        F.coalesce("applied_total", zero).alias("applied_total"),
        F.coalesce("applied_tenant", zero).alias("applied_tenant"),
        F.coalesce("applied_global", zero).alias("applied_global"),
        F.coalesce("tenant_cursor", zero).alias("tenant_cursor"),
        F.coalesce("global_cursor", zero).alias("global_cursor"),
        F.col("feed_stats.global_active").alias("feed_global_active"),
        F.lit(jail_name).alias("jail_name"),
        "jail_banned",
        F.coalesce("pending", zero).alias("outbox_pending"),
        F.coalesce("oldest_seconds", zero).alias("outbox_oldest_seconds"),
        snap["last_pull_at"].alias("last_pull_at"),
        since("last_pull_at").alias("last_pull_age_seconds"),
        snap["last_flush_at"].alias("last_flush_at"),
        snapshot_age.alias("snapshot_age_seconds"),
        F.coalesce(
            F.transform(
                "_recent",
                lambda r: F.struct(
                    r["ip"].alias("ip"),
                    r["applied_at"].alias("applied_at"),
                    r["source"].alias("source"),
                ),
            ),
            no_recent,
        ).alias("recent"),
    )


def heartbeat_body(version: str = __version__) -> Column:
    """JSON body of a heartbeat from status, flag and degraded columns."""
    return j.encode(
        F.struct(
            F.lit(version).alias("agent_version"),
            "hostname",
            "uptime_seconds",
            F.struct(
                F.col("applied_total").alias("local_bans"),
                F.col("outbox_pending").alias("queue_pending"),
                F.col("outbox_oldest_seconds").alias("queue_oldest_seconds"),
                F.col("tenant_cursor").alias("last_pull_cursor"),
                F.when(F.col("degraded"), "degraded").otherwise(F.lit("ok")).alias(
                    "last_pull_status"
                ),
                F.struct("auth_blocked", "tenant_suspended").alias("flags"),
            ).alias("stats"),
        )
    )
