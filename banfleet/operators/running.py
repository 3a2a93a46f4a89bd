"""Running totals and top-n over keys of any size.

A plain window ``partitionBy(key)`` puts all rows of a key into one task. When
one host owns a third of the fleet's rows, that task never ends. The operators
here cut every key into chunks first, so that no task sees more than one chunk
of a key at a time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 18
CHUNK_COLUMN = "_chunk"


@dataclass(frozen=True)
class Running:
    """``sum``, ``max`` or ``xor`` over all rows up to this one, or up to the one before.

    ``since`` sums the rows after the last one with ``reset``; ``total`` sums all rows of the key.
    """

    kind: str
    value: Column
    before: bool = False
    reset: Column | None = None


def running_sum(value: Column, before: bool = False) -> Running:
    return Running("sum", value, before)


def running_max(value: Column, before: bool = False) -> Running:
    return Running("max", value, before)


def running_xor(value: Column, before: bool = False) -> Running:
    """All bits of the integers so far, exclusive-or: a prefix digest if the values are hashes."""
    return Running("xor", value, before)


def running_since(value: Column, reset: Column) -> Running:
    """Sum since the last row where ``reset`` holds, that row aside; of all rows if none has."""
    return Running("since", value, reset=F.coalesce(reset, F.lit(False)))


def key_total(value: Column) -> Running:
    """Sum over all rows of the key, from the same pass as the others."""
    return Running("total", value)


def running_count() -> Running:
    return running_sum(F.lit(1).cast("bigint"))


def _combine(kind: str, carried: Column, inside: Column, had: Column) -> Column:
    if kind == "max":
        return F.greatest(carried, inside)  # NULLs are skipped
    zero = F.lit(0).cast("bigint")
    carried, inside = F.coalesce(carried, zero), F.coalesce(inside, zero)
    if kind == "since":
        return F.when(had, inside).otherwise(carried + inside)
    return carried.bitwiseXOR(inside) if kind == "xor" else carried + inside


def chunked(
    df: DataFrame, order: str, *, width: int = CHUNK, chunk: Column | None = None
) -> DataFrame:
    """Add the chunk of each row: ``width`` values of the integer order column."""
    if chunk is None:
        chunk = F.floor(F.col(order) / F.lit(width)).cast("bigint")
    return df.withColumn(CHUNK_COLUMN, chunk)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    totals: Mapping[str, Running],
    *,
    width: int = CHUNK,
    chunk: Column | None = None,
) -> DataFrame:
    """Add one running total per entry of ``totals``, per key in ``order``.

    ``order`` is an integer column, unique per key, and a chunk is a run of
    ``width`` of its values; so a chunk never holds more than ``width`` rows. For
    other orders pass ``chunk``, an expression that rises with the order (for
    text: file and block). Keys and order must not be NULL.

    A ``_chunk`` column from :func:`chunked` is used as it is and kept, so that
    several steps over the same chunks share one shuffle.

    Plan: chunk totals are aggregated map-side and give each chunk its carry (a
    window over one row per chunk), rows then need one shuffle by (key, chunk)
    that serves both the join with the carry and the window inside the chunk. With a ``since``, the
    chunks' totals come from the dealt rows: one scan, and one shuffle that both sides read. It needs
    an integer order.
    """
    order = [order] if isinstance(order, str) else list(order)
    keys = list(keys)
    inputs = {name: f"_in_{name}" for name in totals}
    base = df if CHUNK_COLUMN in df.columns else chunked(df, order[0], width=width, chunk=chunk)
    base = base.withColumns({inputs[n]: t.value for n, t in totals.items()})

    aggregate = {"sum": F.sum, "max": F.max, "xor": F.bit_xor, "total": F.sum}
    in_chunk = Window.partitionBy(*keys, CHUNK_COLUMN).orderBy(*order)
    until = {
        False: in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        True: in_chunk.rowsBetween(Window.unboundedPreceding, -1),
    }
    since = [n for n, t in totals.items() if t.kind == "since"]
    if since:  # where a chunk's last reset lies shows in its order only: rows are dealt out first
        base = base.withColumns({f"_sum_{n}": F.sum(inputs[n]).over(until[False]) for n in since})
        cleared = {f"_clear_{n}": F.last(F.when(totals[n].reset, F.col(f"_sum_{n}")), True).over(until[False]) for n in since}
        base = base.withColumns(cleared)
        base = base.withColumns({inputs[n]: F.col(f"_sum_{n}") - F.coalesce(f"_clear_{n}", F.lit(0).cast("bigint")) for n in since})

    per_chunk = base.groupBy(*keys, CHUNK_COLUMN).agg(
        *[aggregate[t.kind](inputs[n]).alias(inputs[n]) for n, t in totals.items() if n not in since],
        *[F.max_by(inputs[n], order[0]).alias(inputs[n]) for n in since],
        *[F.max(F.col(f"_clear_{n}").isNotNull().cast("int")).alias(f"_had_{n}") for n in since],
    )
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK_COLUMN)
    earlier_chunks = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    if since:  # a chunk with a reset begins a stretch of its own
        stretch = by_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        per_chunk = per_chunk.withColumns({f"_part_{n}": F.sum(f"_had_{n}").over(stretch) for n in since})
        per_chunk = per_chunk.withColumns({
            f"_open_{n}": F.sum(inputs[n]).over(
                Window.partitionBy(*keys, f"_part_{n}").orderBy(CHUNK_COLUMN).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            )
            for n in since
        })

    def carried(n: str, t: Running) -> Column:
        if t.kind == "since":
            return F.lag(f"_open_{n}").over(by_chunk)
        if t.kind == "total":
            return F.sum(inputs[n]).over(Window.partitionBy(*keys))
        return aggregate[t.kind](inputs[n]).over(earlier_chunks)

    carry = per_chunk.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col(CHUNK_COLUMN).alias("_carry_chunk"),
        *[carried(n, t).alias(f"_carry_{n}") for n, t in totals.items()],
    )
    matches = F.col(CHUNK_COLUMN) == F.col("_carry_chunk")
    for k in keys:
        matches = matches & (F.col(k) == F.col(f"_key_{k}"))

    def inside(n: str, t: Running) -> Column:
        if t.kind == "since":
            return F.col(inputs[n])
        if t.kind == "total":
            return F.lit(0).cast("bigint")
        return aggregate[t.kind](inputs[n]).over(until[t.before])

    def had(n: str) -> Column:
        return F.col(f"_clear_{n}").isNotNull() if n in since else F.lit(False)

    return base.join(carry, matches, "left").select(
        *df.columns,
        *[_combine(t.kind, F.col(f"_carry_{n}"), inside(n, t), had(n)).alias(n) for n, t in totals.items()],
    )


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, *, lanes: int = 64
) -> DataFrame:
    """The first ``n`` rows per key, with their rank in ``rn``.

    Every input partition keeps at most ``n`` rows per key before the shuffle
    (Spark plans a window group limit); these survivors are spread over
    ``lanes``, so the last step sees at most ``n * lanes`` rows of a key. The
    lane does not influence the result.
    """
    laned = df.withColumn("_lane", F.spark_partition_id() % F.lit(lanes))
    per_lane = Window.partitionBy(*keys, "_lane").orderBy(*order)
    per_key = Window.partitionBy(*keys).orderBy(*order)
    return (
        laned.withColumn("_rn", F.row_number().over(per_lane))
        .where(F.col("_rn") <= n)
        .drop("_rn", "_lane")
        .withColumn("rn", F.row_number().over(per_key))
        .where(F.col("rn") <= n)
        .withColumn("rn", F.col("rn").cast("bigint"))
    )
