"""Log segments: text files that are complete once they appear.

A segment lies under ``hostname=<host>/`` (and any further folders). A rotated
log is a new segment; a file that still grows must not be placed here, because
Spark reads every file once.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banfleet.functions.banlog import parse_bans
from banfleet.operators.running import CHUNK, CHUNK_COLUMN, running, running_count

# Characters besides LF, CR and CRLF that end a line.
LINE_BREAKS = "[\\x0b\\x0c\\x1c-\\x1e\\u0085\\u2028\\u2029]"
_SCHEMA = "value string, hostname string"


def _texts(raw: DataFrame) -> DataFrame:
    return raw.select(
        "hostname",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )


def as_lines(texts: DataFrame) -> DataFrame:
    """Non-empty lines with their place: file, block and number within the block.

    The text source itself splits at LF, CR and CRLF and puts U+FFFD for bytes
    that are not UTF-8. Line numbers rise within a block, which one task reads.
    """
    pieces = F.posexplode(F.split("value", LINE_BREAKS)).alias("piece", "line")
    return (
        texts.withColumn("line_no", F.monotonically_increasing_id())
        .select("hostname", "file", "block", "line_no", pieces)
        .where("line <> ''")
    )


def read_lines(spark: SparkSession, path: str, *, modified_after: str | None = None) -> DataFrame:
    """Lines of all segments. ``modified_after`` skips older segments (cold start)."""
    reader = spark.read.schema(_SCHEMA)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return as_lines(_texts(reader.text(path)))


def stream_segments(
    spark: SparkSession,
    path: str,
    *,
    start: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Segments as a stream; ``start`` skips those older than that.

    Lines are cut per micro-batch, with :func:`as_lines`.
    """
    reader = spark.readStream.schema(_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.text(path)
    if start:
        raw = raw.where(F.col("_metadata.file_modification_time") >= F.lit(start).cast("timestamp"))
    return _texts(raw)


def cold_start(spark: SparkSession, checkpoint: str, now: datetime.datetime | None = None) -> str:
    """When a stream first began, for ``start`` of :func:`stream_segments`: kept beside its checkpoint.

    The first call notes ``now`` (UTC; the clock, if not given); every later one, after a restart, returns
    what was noted. So segments that were there before the first start are never read, and
    those that came while the stream was down are.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}-start")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        text = (now or datetime.datetime.now(datetime.UTC)).strftime("%Y-%m-%d %H:%M:%S.%f")
        draft = path.suffix(f"-{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(text.encode())
        stream.close()
        if not files.rename(draft, path):  # another driver was first
            files.delete(draft, False)
    stream = files.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def number_lines(parsed: DataFrame, name: str = "id") -> DataFrame:
    """Number rows 1, 2, ... per host, by file name, block and line.

    Chunks are the blocks, which the reader has bounded already; there is no
    global sort.
    """
    in_blocks = parsed.withColumn(CHUNK_COLUMN, F.struct("file", "block"))
    order = ["line_no", "piece"]
    return running(in_blocks, ["hostname"], order, {name: running_count()}).drop(CHUNK_COLUMN)


def bans_of_segments(lines: DataFrame) -> DataFrame:
    return number_lines(parse_bans(lines))


def write_segments(
    lines: DataFrame, path: str, *, order: str = "seq", width: int = CHUNK, mode: str = "error"
) -> None:
    """Write lines as segments of ``width`` order values; names sort like the order.

    With mode ``append``, what is there stays, and a host's later lines are files of their own.
    """
    segment = F.lpad(F.floor(F.col(order) / width).cast("string"), 12, "0")
    (
        lines.withColumn("segment", F.concat(F.lit("s"), segment))
        .repartition("hostname", "segment")
        .sortWithinPartitions("hostname", "segment", order)
        .select("hostname", "segment", F.col("line").alias("value"))
        .write.mode(mode)
        .partitionBy("hostname", "segment")
        .text(path)
    )
