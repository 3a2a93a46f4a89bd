"""Flush policy as a stream: queue rows to report batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from banfleet import __version__
from banfleet import constants as C
from banfleet.operators.flushing import plan_flushes
from banfleet.operators.outbox import assemble_reports
from banfleet.streaming.ingest import QUEUE
from banfleet.streaming.versions import Version, Versions, folder

_CLOCKS = "hostname string, clock bigint, next_flush bigint"
_PLACED = f"{QUEUE}, flush_no bigint, flushed_at bigint"


def flush_stream(
    queue: DataFrame,
    out: str,
    checkpoint: str,
    *,
    seconds: int = C.FLUSH_SECONDS,
    early_at: int = C.FLUSH_EARLY_AT,
    batch: int = C.BATCH_SIZE,
    poll: str | None = None,
) -> StreamingQuery:
    """Rows of the ingest queue, flushed as :func:`banfleet.operators.flushing.plan_flushes` says.

    A host's clock is the second of its newest row; rows of earlier seconds are settled. Rows that
    come later than their host's clock enter at the clock. As long as none do, membership, number and time of all
    flushes are those of one batch over all rows, whatever the cut into micro-batches. A row without a
    hostname is a tick (see :func:`with_ticks`): it moves all hosts' clocks, so that a host that falls silent is
    flushed too. Carried on are the rows that wait, and two numbers per host.
    """
    spark = queue.sparkSession

    def write(arrived: DataFrame, batch_id: int) -> None:
        versions = Versions(spark, out)
        last = versions.newest()
        if last is not None and last.number >= batch_id:
            return

        def kept(df: DataFrame, table: str) -> DataFrame:
            path = f"{versions.out}/{folder(table, batch_id)}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        if last is None:
            clocks, waiting = spark.createDataFrame([], _CLOCKS), spark.createDataFrame([], QUEUE)
        else:
            clocks = spark.read.schema(_CLOCKS).parquet(*versions.paths(last.folders["clocks"]))
            before = spark.read.schema(_PLACED).parquet(f"{out}/{folder('placed', last.number)}")
            waiting = before.where("flush_no IS NULL").drop("flush_no", "flushed_at")
        ticks = arrived.where("hostname IS NULL").select(F.col("enqueued_at").alias("clock"))
        tick = ticks.unionByName(clocks.where("hostname IS NULL").select("clock")).agg(F.max("clock")).first()[0]
        hosts = clocks.where("hostname IS NOT NULL")
        new = arrived.where("hostname IS NOT NULL").join(hosts, "hostname", "left")
        entered = F.greatest("enqueued_at", "clock", F.lit(tick).cast("bigint"))
        new = new.withColumn("enqueued_at", entered).select(*waiting.columns)
        rows = kept(waiting.unionByName(new), "rows")
        zero = F.lit(0).cast("bigint")
        seen = rows.groupBy("hostname").agg(F.max("enqueued_at").alias("clock")).withColumn("next_flush", zero)
        moved = hosts.unionByName(seen).groupBy("hostname").agg(F.max("clock").alias("clock"), F.max("next_flush").alias("next_flush"))
        moved = moved.withColumn("clock", F.greatest("clock", F.lit(tick).cast("bigint")))
        placed = kept(plan_flushes(rows, moved, seconds=seconds, early_at=early_at, batch=batch), "placed")
        used = placed.where("flush_no IS NOT NULL").groupBy("hostname").agg((F.max("flush_no") + 1).alias("_next"))
        after = moved.join(used, "hostname", "left").select("hostname", "clock", F.greatest("next_flush", "_next").alias("next_flush"))
        if tick is not None:
            after = after.unionByName(spark.createDataFrame([(None, tick, None)], _CLOCKS))
        kept(after, "clocks")
        versions.publish(Version(batch_id, {t: [folder(t, batch_id)] for t in ("clocks", "rows")}))
        versions.retire()

    writer = queue.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)
    return writer.start()


def with_ticks(queue: DataFrame) -> DataFrame:
    """The queue and the clock: a row without hostname every second, so that silent hosts are flushed."""
    ticks = queue.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    at = F.unix_seconds("timestamp")
    return queue.unionByName(ticks.select(F.lit(None).cast("string").alias("hostname"), at.alias("enqueued_at")), allowMissingColumns=True)


def queue_stream(spark: SparkSession, out: str, files_per_trigger: int | None = None) -> DataFrame:
    """The queue that :func:`banfleet.streaming.ingest.ingest` writes at ``out``, as a stream."""
    reader = spark.readStream.schema(QUEUE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{out}/rows/batch_id=*")


def _placed(spark: SparkSession, out: str) -> tuple[DataFrame, int]:
    last = Versions(spark, out).newest()
    table = spark.read.schema(f"{_PLACED}, batch_id bigint").parquet(f"{out}/placed") if last else spark.createDataFrame([], f"{_PLACED}, batch_id bigint")
    return table, last.number if last else -1


def flushed_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows that have left, with the number and time of their flush."""
    table, newest = _placed(spark, out)
    return table.where((F.col("batch_id") <= newest) & F.col("flush_no").isNotNull()).drop("batch_id")


def waiting_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows that wait, as of the last finished micro-batch."""
    table, newest = _placed(spark, out)
    return table.where((F.col("batch_id") == newest) & F.col("flush_no").isNull()).drop("batch_id")


def flushed_reports(spark: SparkSession, out: str, agent_version: str = __version__) -> DataFrame:
    """One report per flush: key, JSON body and ``flushed_at``."""
    rows = flushed_rows(spark, out).withColumnRenamed("flush_no", "batch_no")
    times = rows.groupBy("hostname", "batch_no").agg(F.max("flushed_at").alias("flushed_at"))
    return assemble_reports(rows, agent_version=agent_version).join(times, ["hostname", "batch_no"]).withColumnRenamed("batch_no", "flush_no")
