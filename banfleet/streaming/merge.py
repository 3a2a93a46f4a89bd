"""Feed operations folded into the versioned table of applied addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from banfleet.operators.feed import KEY, last_ops, valid_ops
from banfleet.streaming.versions import Version, Versions, folder

COMPACT_EVERY = 100


def merge_stream(
    ops: DataFrame,
    out: str,
    checkpoint: str,
    *,
    keys: Sequence[str] = KEY,
    poll: str | None = None,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Fold a stream of feed operations, in any order, into the state at ``out``.

    ``ops`` has the keys and ``page_no, pos, op, source, at_s, enforced``. A micro-batch writes only
    the last operation per key it saw, so its cost depends on the batch, not on the state. Every
    ``compact_every`` batches the changes so far become one file set. Since an older operation may
    still come, removals are kept; where pages come in order (:mod:`banfleet.streaming.feed`) they go.
    """
    spark = ops.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        versions = Versions(spark, out)
        last = versions.newest()
        if last is None or last.number < batch_id:  # else this batch was finished before
            parts = fold(versions, batch, batch_id, last, keys, compact_every)
            versions.publish(Version(batch_id, parts))
            versions.retire()

    writer = ops.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)
    return writer.start()


def fold(
    versions: Versions,
    ops: DataFrame,
    batch_id: int,
    last: Version | None,
    keys: Sequence[str] = KEY,
    compact_every: int = COMPACT_EVERY,
    *,
    ordered: bool = False,
) -> dict[str, list[str]]:
    """Write what a batch changes; the folders of base and changes that make the state then.

    With ``ordered``, every later batch has later operations only, so that a base needs no removals.
    """
    spark = ops.sparkSession
    base, changes = (last.folders[t] for t in ("base", "changes")) if last else ([], [])
    changes = [*changes, folder("changes", batch_id)]
    new = _newest(valid_ops(ops).where("enforced"), keys)
    new.write.mode("overwrite").parquet(f"{versions.out}/{changes[-1]}")
    if len(changes) >= compact_every:
        merged = _newest(_read(spark, versions, base + changes, keys), keys)
        if ordered:
            merged = merged.where(F.col("op") == "add")
        base, changes = [folder("base", batch_id)], []
        merged.write.mode("overwrite").parquet(f"{versions.out}/{base[0]}")
    return {"base": base, "changes": changes}


def _newest(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    last = F.max(F.struct("page_no", "pos", "op", "source", "at_s")).alias("_last")
    return ops.groupBy(*keys).agg(last).select(*keys, "_last.*")


def _schema(keys: Sequence[str]) -> str:
    names = ", ".join(f"{k} string" for k in keys)
    return f"{names}, page_no bigint, pos bigint, op string, source string, at_s bigint"


def _read(spark: SparkSession, versions: Versions, folders: list[str], keys: Sequence[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], _schema(keys))
    return spark.read.schema(_schema(keys)).parquet(*versions.paths(folders))


def applied_state(
    spark: SparkSession, out: str, keys: Sequence[str] = KEY, *, version: int | None = None
) -> DataFrame:
    """The applied addresses of the newest whole version, or of one that isn't retired yet."""
    versions = Versions(spark, out)
    found = versions.newest() if version is None else versions.at(version)
    folders = found.folders["base"] + found.folders["changes"] if found else []
    ops = _read(spark, versions, folders, keys)
    return last_ops(ops, keys).where(F.col("op") == "add").select(*keys, "applied_at", "source")
