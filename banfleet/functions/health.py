"""Ages, health and status texts, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from banfleet import constants as C


def age_seconds(as_of: Column | int, ts: Column) -> Column:
    """Whole seconds since ``ts``, never negative; NULL stays NULL."""
    now = F.lit(as_of) if isinstance(as_of, int) else as_of
    zero = F.lit(0).cast("bigint")
    # greatest() skips NULLs and would turn a missing time into age 0
    return F.when(ts.isNotNull(), F.greatest(zero, (now - ts).cast("bigint")))


def age_text(seconds: Column) -> Column:
    def whole(value: Column) -> Column:
        return value.cast("bigint").cast("string")

    hours = F.floor(seconds / 3600)
    minutes = F.floor((seconds % 3600) / 60)
    return (
        F.when(seconds.isNull(), F.lit(C.NO_VALUE))
        .when(seconds < 60, F.concat(whole(seconds), F.lit("s")))
        .when(seconds < 3600, F.concat(whole(F.floor(seconds / 60)), F.lit("m")))
        .otherwise(F.concat(whole(hours), F.lit("h "), whole(minutes), F.lit("m")))
    )


def coverage_percent(applied: Column, active: Column) -> Column:
    """Share of the feed that is applied, at most 100; NULL if the total is unknown."""
    share = F.floor(F.lit(100) * applied / F.nullif(active, F.lit(0).cast("bigint")))
    return F.when(
        F.coalesce(active != 0, F.lit(False)), F.least(F.lit(100).cast("bigint"), share)
    )


def coverage_bar(percent: Column, cells: int = C.COVERAGE_CELLS) -> Column:
    filled = F.floor(percent * cells / 100).cast("int")
    return F.concat(
        F.repeat(F.lit(C.BAR_FULL), filled), F.repeat(F.lit(C.BAR_EMPTY), F.lit(cells) - filled)
    )


def clock_text(epoch: Column, tz: Column) -> Column:
    """``HH:MM:SS`` on the host's clock; a missing or zero time gives a dash."""
    local = F.from_utc_timestamp(F.timestamp_seconds(epoch), tz)
    known = F.coalesce(epoch != 0, F.lit(False))
    return F.when(known, F.date_format(local, "HH:mm:ss")).otherwise(F.lit(C.NO_VALUE))


def all_alive(threads: Column) -> Column:
    return F.forall(F.map_values(threads), lambda alive: F.coalesce(alive, F.lit(False)))


def raw_status(threads: Column, degraded: Column) -> Column:
    return (
        F.when(~all_alive(threads), "critical")
        .when(degraded, "degraded")
        .otherwise(F.lit("healthy"))
    )


def effective_status(raw: Column, snapshot_age: Column, max_age: Column | int) -> Column:
    """Missing or stale snapshots are critical, whatever they say."""
    limit = F.lit(max_age) if isinstance(max_age, int) else max_age
    known = F.coalesce(raw.isin("healthy", "degraded", "critical"), F.lit(False))
    return (
        F.when(snapshot_age.isNull() | (snapshot_age > limit), "critical")
        .when(known, raw)
        .otherwise(F.lit("unknown"))
    )


def exit_code(status: Column) -> Column:
    return F.when(status == "healthy", 0).when(status == "degraded", 1).otherwise(F.lit(2))


def heartbeat_degraded(status_code: Column) -> Column:
    """After a heartbeat: degraded unless a 2xx came back."""
    return ~F.coalesce(status_code.between(200, 299), F.lit(False))


def heartbeat_interval(degraded: Column) -> Column:
    return F.when(degraded, C.HEARTBEAT_SECONDS_DEGRADED).otherwise(F.lit(C.HEARTBEAT_SECONDS))


def jail_count(rc: Column, out: Column) -> Column:
    """Number in the first "Currently banned" line, after its last colon.

    NULL if the command failed, there is no such line or no number in it.
    """
    line = F.regexp_extract(out, "(?m)^(.*Currently banned.*)$", 1)
    number = F.trim(F.substring_index(line, ":", -1)).try_cast("bigint")
    return F.when(rc == 0, number)
