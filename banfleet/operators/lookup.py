"""Values of a key added to all its rows, however many rows a key has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that a key's rows are dealt into, and copies that its value is made.
SPREAD = 64
_PART = "_part"


def with_values(
    rows: DataFrame,
    values: DataFrame,
    keys: Sequence[str],
    spread: Column | str,
    *,
    how: str = "inner",
    parts: int = SPREAD,
) -> DataFrame:
    """``rows`` joined with ``values``, which has one row per key.

    Where the values are small, Spark sends them to the rows and nothing else moves: it goes by their measured
    size. Where they aren't, rows are dealt out by key and part, so that a key with a third of all rows
    is spread over ``parts`` tasks. ``spread`` is a column of the rows, like a line number, that
    differs within a key; the part follows from it, so a task that runs again deals rows the same way.
    """
    part = F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")
    copies = values.withColumn(_PART, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumn(_PART, part).join(copies, [*keys, _PART], how).drop(_PART)
