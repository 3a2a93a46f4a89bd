"""Blocklist feed: cursors, pull cycles and the table of applied addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banfleet import constants as C
from banfleet.operators.running import CHUNK, running, running_count, running_max, running_sum
from banfleet.session import written

KEY = ("hostname", "ip")


def source_or_default(source: Column | str = "source") -> Column:
    """A missing source means ``tenant``, be the field absent or null."""
    return F.coalesce(F.col(source) if isinstance(source, str) else source,
                      F.lit(C.DEFAULT_SOURCE))


def has_address(ip: str = "ip") -> Column:
    return F.coalesce(F.col(ip), F.lit("")) != ""


def valid_items(items: DataFrame, include_global: bool = True) -> DataFrame:
    """Items with an address, their source filled in; global ones only if wanted."""
    kept = items.where(has_address()).withColumn("source", source_or_default())
    return kept if include_global else kept.where(F.col("source") != C.GLOBAL_SOURCE)


def valid_ops(items: DataFrame, include_global: bool = True) -> DataFrame:
    """Valid items that add or remove; an unknown operation is ignored."""
    return valid_items(items, include_global).where(F.col("op").isin("add", "remove"))


def page_ok() -> Column:
    return F.coalesce(F.col("status_code") == 200, F.lit(False))


def of_consumed_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items of pages that arrived.

    The failed pages are the small side of the anti join, so the items need not
    be shuffled for it as long as Spark finds that side small at run time.
    """
    failed = pages.where(~page_ok()).select("page_no")
    return items.join(failed, "page_no", "left_anti")


def cursor_progress(
    pages: DataFrame,
    keys: Sequence[str] = (),
    *,
    stored_cursor: int | Column = 0,
    stored_global: int | Column = 0,
    width: int = CHUNK,
) -> DataFrame:
    """Both cursors before and after every page. A cursor only ever rises.

    Stored cursors may be columns of ``pages``, one value per key.
    """
    tenant, feed = (F.when(page_ok(), F.col(c)) for c in ("cursor", "global_cursor"))
    seen = running(
        pages,
        keys,
        "page_no",
        {
            "_place": running_count(),
            "cursor_before": running_max(tenant, before=True),
            "cursor_after": running_max(tenant),
            "global_before": running_max(feed, before=True),
            "global_after": running_max(feed),
        },
        width=width,
    )

    def at_least(stored: int | Column, name: str) -> Column:
        return F.greatest(F.lit(stored).cast("bigint"), F.col(name))

    return seen.withColumns(
        {
            "cursor_before": at_least(stored_cursor, "cursor_before"),
            "cursor_after": at_least(stored_cursor, "cursor_after"),
            "global_before": at_least(stored_global, "global_before"),
            "global_after": at_least(stored_global, "global_after"),
        }
    )


def _end_reason() -> Column:
    """Why a pull cycle stops at a page, the cap aside; NULL where it goes on."""
    advanced = F.coalesce(F.col("global_cursor") > F.col("global_before"), F.lit(False))
    return F.when(~page_ok(), "error").when(
        F.col("next_cursor").isNull() & ~advanced, "drained"
    )


def cycle_pages(
    pages: DataFrame,
    keys: Sequence[str] = (),
    *,
    stored_cursor: int | Column = 0,
    stored_global: int | Column = 0,
    open_pages: int | Column = 0,
    cycles: int | Column = 0,
    cap: int = C.DELTA_PAGE_CAP,
    width: int = CHUNK,
) -> DataFrame:
    """Pages with their cursors, the pull cycle that reads them and why it ends there.

    ``stored_cursor``, ``stored_global``, ``open_pages`` (already read by a cycle that goes on) and
    ``cycles`` (begun so far) say where earlier pages left off. The column ``open_pages`` is what it
    is after each page. Each step reads the result of the one before twice (carries and rows), so
    the header table is written in between.
    """
    zero = F.lit(0).cast("bigint")
    progress = cursor_progress(
        pages, keys, stored_cursor=stored_cursor, stored_global=stored_global, width=width
    ).withColumn("end_reason", _end_reason())
    progress = written(progress, "pages")
    placed = running(
        progress,
        keys,
        "page_no",
        {
            "_last_end": running_max(
                F.when(F.col("end_reason").isNotNull(), F.col("_place")), before=True
            )
        },
        width=width,
    ).withColumn("_in_run", F.col("_place") - F.coalesce("_last_end", -(zero + open_pages)) - 1)
    placed = written(placed, "pages")
    starts = (F.col("_in_run") % cap == 0).cast("bigint")
    numbered = running(placed, keys, "page_no", {"cycle_no": running_sum(starts)}, width=width)
    at_cap = F.col("_in_run") % cap == cap - 1
    ended = F.coalesce("end_reason", F.when(at_cap, "cap"))
    return numbered.withColumns(
        {
            "cycle_no": F.col("cycle_no") + cycles,
            "consumed": page_ok(),
            "end_reason": ended,
            "open_pages": F.when(ended.isNotNull(), zero).otherwise(F.col("_in_run") % cap + 1),
        }
    ).drop("_place", "_last_end", "_in_run")


def pull_cycles(
    pages: DataFrame,
    keys: Sequence[str] = (),
    *,
    stored_cursor: int = 0,
    stored_global: int = 0,
    cap: int = C.DELTA_PAGE_CAP,
    width: int = CHUNK,
) -> DataFrame:
    """Assign every page of a feed to the pull cycle that reads it.

    A cycle ends with a failed page, with a page after which nothing is left
    (no next page and the global cursor did not move), or at the cap; the next
    page starts a new cycle from the cursors stored so far.
    """
    stored = {"stored_cursor": stored_cursor, "stored_global": stored_global}
    return cycle_pages(pages, keys, **stored, cap=cap, width=width).select(
        *keys, "page_no", "cycle_no", "consumed", "cursor_after", "global_after", "end_reason"
    )


def full_sync_pages(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Mark the pages of a full snapshot that get applied.

    Those from page 1 on, up to the first without a next page, and before the first that failed; a
    page that isn't there is one that failed. With a ``cap``, pages beyond it aren't applied, and
    ``over_cap`` marks those that would have been.
    """
    failed = pages.where(~page_ok()).agg(F.min("page_no")).scalar()
    last = pages.where(F.col("next_page").isNull()).agg(F.min("page_no")).scalar()
    before = pages.select((F.col("page_no") + 1).alias("page_no"))
    gap = pages.where("page_no > 1").join(before, "page_no", "left_anti").agg(F.min("page_no")).scalar()
    in_reach = page_ok() & F.coalesce(F.col("page_no") < failed, F.lit(True))
    in_reach = in_reach & F.coalesce(F.col("page_no") <= last, F.lit(True))
    in_reach = in_reach & F.coalesce(F.col("page_no") < gap, F.lit(True))
    if cap is None:
        return pages.withColumn("applied", in_reach)
    within = F.col("page_no") <= cap
    return pages.withColumns({"applied": in_reach & within, "over_cap": in_reach & ~within})


def of_applied_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items of the pages that a full sync applies."""
    return items.join(full_sync_pages(pages).where("applied").select("page_no"), "page_no", "left_semi")


def last_ops(ops: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """The last operation per address: what is left of applying all in order.

    One map-side combined aggregate; a key with a third of all operations
    shrinks to one row per input partition before the shuffle.
    """
    last = F.max(F.struct("page_no", "pos", "op", "source", "at_s")).alias("_last")
    return ops.groupBy(*keys).agg(last).select(
        *keys, "_last.op", "_last.source", F.col("_last.at_s").alias("applied_at")
    )


def apply_ops(ops: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Applied addresses after all operations, starting from none."""
    return last_ops(ops, keys).where(F.col("op") == "add").select(*keys, "applied_at", "source")


def merge_ops(current: DataFrame, ops: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Applied addresses after the operations, starting from ``current``.

    An add replaces source and time; a remove deletes whatever the source. Both
    sides have one row per key, so the join cannot be skewed.
    """
    new = last_ops(ops, keys).select(
        *keys, "op", F.col("source").alias("_source"), F.col("applied_at").alias("_applied_at")
    )
    added = F.col("op") == "add"
    return (
        current.join(new, list(keys), "full_outer")
        .where(F.coalesce(F.col("op") != "remove", F.lit(True)))
        .select(
            *keys,
            F.when(added, F.col("_applied_at")).otherwise(F.col("applied_at")).alias("applied_at"),
            F.when(added, F.col("_source")).otherwise(F.col("source")).alias("source"),
        )
    )


def snapshot_rows(
    items: DataFrame, as_of: int, keys: Sequence[str] = KEY
) -> DataFrame:
    """A full snapshot as applied rows; of an address listed twice the last counts."""
    last = F.max(F.struct("page_no", "pos", "source")).alias("_last")
    return (
        valid_items(items)
        .groupBy(*keys)
        .agg(last)
        .select(*keys, F.lit(as_of).cast("bigint").alias("applied_at"), "_last.source")
    )


def merge_snapshot(
    current: DataFrame, snapshot: DataFrame, keys: Sequence[str] = KEY
) -> DataFrame:
    """Full sync: snapshot rows replace or add, nothing is ever removed.

    Both sides have one row per key and are read once, by one join.
    """
    new = snapshot.select(
        *keys, F.struct(F.col("applied_at").alias("at"), F.col("source").alias("of")).alias("_new")
    )
    replaced = F.col("_new").isNotNull()
    return current.join(new, list(keys), "full_outer").select(
        *keys,
        F.when(replaced, F.col("_new.at")).otherwise(F.col("applied_at")).alias("applied_at"),
        F.when(replaced, F.col("_new.of")).otherwise(F.col("source")).alias("source"),
    )


def drift(current: DataFrame, snapshot: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Addresses on one side only: both differences from one join."""
    here = current.select(*keys, F.lit(True).alias("_here"))
    there = snapshot.select(*keys, F.lit(True).alias("_there"))
    side = F.when(F.col("_there").isNull(), "applied_only").when(
        F.col("_here").isNull(), "feed_only"
    )
    return (
        here.join(there, list(keys), "full_outer")
        .select(*keys, side.alias("side"))
        .where("side IS NOT NULL")
    )


def feed_off(
    current: DataFrame, unbanned: DataFrame, keys: Sequence[str] = KEY
) -> DataFrame:
    """Leave the global feed: global rows go where the removal was enforced."""
    outcome = unbanned.groupBy(*keys).agg(F.bool_or("enforced").alias("_gone"))
    gone = (F.col("source") == C.GLOBAL_SOURCE) & F.col("_gone")
    return (
        current.join(outcome, list(keys), "left")
        .where(~F.coalesce(gone, F.lit(False)))
        .select(*current.columns)
    )


def active(current: DataFrame, as_of: int, ban_seconds: int = C.BAN_SECONDS) -> DataFrame:
    """Applied addresses whose ban has not run out."""
    return current.where(F.col("applied_at") + F.lit(ban_seconds) > F.lit(as_of))


def union_feeds(tenant: DataFrame, global_feed: DataFrame) -> DataFrame:
    """Two feeds as one item stream."""
    return tenant.withColumn("source", F.lit(C.DEFAULT_SOURCE)).unionByName(
        global_feed.withColumn("source", F.lit(C.GLOBAL_SOURCE))
    )


def op_counts(ops: DataFrame, cycles: DataFrame) -> DataFrame:
    """Operations that took effect, per pull cycle: operations, not addresses."""
    per_page = ops.where("enforced").groupBy("page_no").agg(
        F.count_if(F.col("op") == "add").alias("added"),
        F.count_if(F.col("op") == "remove").alias("removed"),
    )
    return (
        cycles.join(per_page, "page_no", "left")
        .groupBy("cycle_no")
        .agg(
            F.count("*").alias("pages"),
            F.coalesce(F.sum(F.when(F.col("consumed"), F.col("added"))), F.lit(0)).alias("added"),
            F.coalesce(F.sum(F.when(F.col("consumed"), F.col("removed"))), F.lit(0)).alias(
                "removed"
            ),
        )
    )


def latest_stats(pages: DataFrame) -> DataFrame:
    """Feed totals of the last page that carried any (``has_stats``); a missing one counts 0."""
    zero = F.lit(0).cast("bigint")
    stats = F.struct(
        "page_no",
        F.coalesce("tenant_active", zero).alias("tenant_active"),
        F.coalesce("global_active", zero).alias("global_active"),
    )
    carried = pages.where(page_ok()).where("has_stats")
    return carried.agg(F.max(stats).alias("s")).where("s IS NOT NULL").select("s.*")


def full_sync_decision() -> Column:
    """Reason for a full sync from ``applied_total, stored_pid, current_pid``; NULL for none."""
    stored, current = F.col("stored_pid"), F.col("current_pid")
    changed = F.concat(
        F.lit("pid_changed_old_"), stored.cast("string"), F.lit("_new_"), current.cast("string")
    )
    return (
        F.when(F.col("applied_total") == 0, "first_boot_no_applied_ips")
        .when(stored.isNull() & current.isNotNull(), "first_pid_snapshot")
        .when(stored.isNotNull() & current.isNotNull() & (stored != current), changed)
    )
