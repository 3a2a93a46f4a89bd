"""Distinct counts that can be stored, merged and carried on.

A sketch per key and window of time is some kilobytes, however many values it has seen. Sketches of
windows, hosts or days merge into that of all of them, so a new day costs its own rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86400
#: 2^14 registers: a standard error of 0.8%.
REGISTERS_LOG2 = 14


def standard_error(registers_log2: int = REGISTERS_LOG2) -> float:
    """Of an estimate, as a share of the true count."""
    return 1.04 / 2 ** (registers_log2 / 2)


def distinct_sketches(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    clock: str = "at_s",
    *,
    window: int = DAY,
    registers_log2: int = REGISTERS_LOG2,
) -> DataFrame:
    """One sketch of the distinct values per key and window, with the window's first second.

    Null values aren't counted. Sketches are built map-side, so a hot key sends one per partition.
    """
    start = (F.floor(F.col(clock) / window) * window).cast("bigint").alias("window_start")
    return rows.groupBy(*keys, start).agg(F.hll_sketch_agg(value, registers_log2).alias("sketch"))


def merged(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The sketches of each key as one."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame, keys: Sequence[str] = (), name: str = "distinct") -> DataFrame:
    """Distinct values per key over all its sketches.

    Read from the union in every case, so that the number depends on the values alone, not on the
    parts they were merged from.
    """
    return merged(sketches, keys).select(*keys, F.hll_sketch_estimate("sketch").alias(name))
