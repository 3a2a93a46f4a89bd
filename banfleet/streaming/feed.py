"""The paged feed as a stream: pages in order, cursors and pull cycles carried on.

Pages may land in any order and be cut into micro-batches in any way. A feed's reader knows the page
it awaits; pages beyond a gap wait until the gap closes, so cursors, cycles and the state come out
as if an agent had read one page after the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from banfleet import constants as C
from banfleet.operators.feed import KEY, cycle_pages, valid_items
from banfleet.operators.running import running, running_count
from banfleet.sources.pages import page_headers, page_items
from banfleet.streaming.merge import COMPACT_EVERY, fold
from banfleet.streaming.versions import Version, Versions, folder

_ALL = "_feed"  # the key of a stream that is one feed
_READER = "next_page bigint, cursor bigint, global_cursor bigint, cycle_no bigint, open_pages bigint, ended string"
_PROGRESS = ("cursor_before", "cursor_after", "global_before", "global_after", "cycle_no", "consumed", "end_reason")


def read_feed(
    pages: DataFrame,
    out: str,
    checkpoint: str,
    *,
    feed_keys: Sequence[str] = (),
    keys: Sequence[str] = KEY,
    first_page: int = 1,
    stored_cursor: int = 0,
    stored_global: int = 0,
    cap: int = C.DELTA_PAGE_CAP,
    include_global: bool = True,
    enforced: Column | None = None,
    applied_at: Column | None = None,
    compact_every: int = COMPACT_EVERY,
    poll: str | None = None,
) -> StreamingQuery:
    """Read landed pages (:func:`banfleet.sources.pages.stream_delta_pages`) into the state at ``out``.

    ``feed_keys`` name columns that tell feeds apart, each with pages numbered from ``first_page``
    on; without any, all pages are one feed. Items change the state of ``keys``, columns of the
    items or the pages; ``enforced`` says of an item whether the host carried it out (its column of
    that name, if there is one, else always), ``applied_at`` when, in epoch seconds (its ``at_s``, or the clock).

    A page without a number is passed over, and one that comes again, however late, counts once.
    Each micro-batch writes, under its own number: the pages still waiting, the log of the pages it
    consumed, the reader (next page, cursors, cycle, why the last one ended) and the changes of the state. One pointer
    makes them visible together; a batch that runs again replaces what it left, or, where it had
    finished, does nothing. Cost per batch follows the pages that came or wait, not the feed.
    """
    spark, raw = pages.sparkSession, pages.columns
    feed = list(feed_keys) or [_ALL]

    def keyed(df: DataFrame) -> DataFrame:
        return df if feed_keys else df.withColumn(_ALL, F.lit(0))

    def write(batch: DataFrame, batch_id: int) -> None:
        versions = Versions(spark, out)
        last = versions.newest()
        if last is not None and last.number >= batch_id:
            return
        reader = _reader(spark, versions, last, batch, feed)
        landed = batch.where("page_no IS NOT NULL")
        if last is not None:
            waiting = spark.read.schema(batch.schema).parquet(*versions.paths(last.folders["arrived"]))
            landed = waiting.unionByName(landed)
        awaited = F.coalesce("next_page", F.lit(first_page))
        fresh = keyed(landed).join(reader.select(*feed, "next_page"), feed, "left").where(F.col("page_no") >= awaited)
        arrived = _written(fresh.dropDuplicates([*feed, "page_no"]).select(*raw), versions, "arrived", batch_id)

        start = {"next_page": first_page, "cursor": stored_cursor, "global_cursor": stored_global, "cycle_no": 0, "open_pages": 0}
        known = reader.select(*feed, *[F.col(c).alias(f"_{c}") for c in start])
        headers = keyed(page_headers(arrived)).join(known, feed, "left")
        headers = headers.withColumns({f"_{c}": F.coalesce(f"_{c}", F.lit(x).cast("bigint")) for c, x in start.items()})
        # of distinct numbers from the awaited one on, the n-th is in its place only before a gap
        placed = running(headers, feed, "page_no", {"_nth": running_count()})
        ready = placed.where(F.col("page_no") == F.col("_next_page") + F.col("_nth") - 1)
        log = cycle_pages(
            ready, feed, cap=cap, stored_cursor=F.col("_cursor"), stored_global=F.col("_global_cursor"),
            open_pages=F.col("_open_pages"), cycles=F.col("_cycle_no"),
        )
        carried = [c for c in page_headers(arrived).columns if c not in feed]
        log = _written(log.select(*feed, *carried, *_PROGRESS, "open_pages"), versions, "pages", batch_id)

        newest = log.groupBy(*feed).agg(
            (F.max("page_no") + 1).alias("next_page"),
            F.max("cursor_after").alias("cursor"),
            F.max("global_after").alias("global_cursor"),
            F.max("cycle_no").alias("cycle_no"),
            F.max_by("open_pages", "page_no").alias("open_pages"),
            F.max_by("end_reason", F.when(F.col("end_reason").isNotNull(), F.col("page_no"))).alias("ended"),
        )
        moved = reader.join(newest.select(*feed), feed, "left_anti").unionByName(
            newest.join(reader.select(*feed, F.col("ended").alias("_ended")), feed, "left")
            .withColumn("ended", F.coalesce("ended", "_ended")).drop("_ended")
        )
        _written(moved, versions, "reader", batch_id)

        read = log.where("consumed").select(*feed, "page_no")
        items = page_items(keyed(arrived).join(read, [*feed, "page_no"], "left_semi").select(*raw))
        parts = fold(versions, _ops(items, include_global, enforced, applied_at), batch_id, last, keys, compact_every, ordered=True)
        own = {t: [folder(t, batch_id)] for t in ("arrived", "reader")}
        versions.publish(Version(batch_id, own | parts))
        versions.retire()

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)
    return writer.start()


def _written(df: DataFrame, versions: Versions, table: str, batch_id: int) -> DataFrame:
    path = f"{versions.out}/{folder(table, batch_id)}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _reader(spark: SparkSession, versions: Versions, last: Version | None, batch: DataFrame, feed: list[str]) -> DataFrame:
    kinds = dict(batch.dtypes) | {_ALL: "int"}
    schema = ", ".join(f"{k} {kinds[k]}" for k in feed) + f", {_READER}"
    if last is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*versions.paths(last.folders["reader"]))


def _ops(items: DataFrame, include_global: bool, enforced: Column | None, applied_at: Column | None) -> DataFrame:
    if enforced is None:
        enforced = F.coalesce("enforced", F.lit(False)) if "enforced" in items.columns else F.lit(True)
    if applied_at is None:
        applied_at = F.col("at_s") if "at_s" in items.columns else F.unix_timestamp()
    return valid_items(items, include_global).withColumns({"enforced": enforced, "at_s": applied_at.cast("bigint")})


def feed_readers(spark: SparkSession, out: str) -> DataFrame:
    """Where each feed's reader stands: the page it awaits, both cursors, and why a cycle ended last."""
    versions = Versions(spark, out)
    last = versions.newest()
    return spark.read.parquet(*versions.paths(last.folders["reader"])).drop(_ALL) if last else spark.createDataFrame([], _READER)


def waiting_pages(spark: SparkSession, out: str, schema, feed_keys: Sequence[str] = ()) -> DataFrame:
    """Pages that landed beyond a gap and wait for it to close."""
    versions = Versions(spark, out)
    last = versions.newest()
    if last is None:
        return spark.createDataFrame([], schema)
    arrived = spark.read.schema(schema).parquet(*versions.paths(last.folders["arrived"]))
    reader = spark.read.parquet(*versions.paths(last.folders["reader"]))
    next_page = reader.select(*(feed_keys or [_ALL]), "next_page")
    joined = arrived.withColumn(_ALL, F.lit(0)).join(next_page, list(feed_keys) or [_ALL], "left")
    return joined.where(F.col("next_page").isNull() | (F.col("page_no") >= F.col("next_page"))).select(*arrived.columns)


def page_log(spark: SparkSession, out: str) -> DataFrame:
    """All pages read so far, each with its header, cursors before and after, cycle and end."""
    versions = Versions(spark, out)
    last = versions.newest()
    if last is None:
        raise ValueError(f"nothing has been read into {out}")
    return spark.read.parquet(f"{out}/pages").where(F.col("batch_id") <= last.number).drop(_ALL, "batch_id", "open_pages")
