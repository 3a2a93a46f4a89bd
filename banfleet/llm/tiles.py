"""Comparing all rows of a group with each other, in tiles of bounded size.

A group's rows are dealt into blocks by hash, and a tile compares two blocks. Tiles give counts
and a spanning forest of what they link, never the pairs, so a group of any size leaves rows in
proportion to its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiled(rows: DataFrame, group: list[str], size: Column, deal: list[str | Column], block: int) -> DataFrame:
    """Rows once for every tile they take part in: ``_i <= _j`` name it, ``_b`` is the row's block.

    ``size`` is the number of rows of the row's group; ``deal`` is hashed to choose its block.
    """
    blocks = F.greatest(F.lit(1), F.ceil(size / block)).cast("int")
    own = rows.withColumn("_n", blocks).withColumn("_b", F.pmod(F.xxhash64(*deal), F.col("_n")).cast("int"))
    spread = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return (
        spread.withColumn("_i", F.least("_b", "_o"))
        .withColumn("_j", F.greatest("_b", "_o"))
        .drop("_n", "_o")
        .repartition(*group, "_i", "_j")
        .sortWithinPartitions(*group, "_i", "_j")
    )


def stretches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys; only one stretch is held besides a batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(len(batch), bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.append(np.flatnonzero(new), len(batch))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def compare_tile(
    table: pa.Table, order: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray], weight: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Weighted number of links of each row, and the position of the root it hangs on.

    ``order`` holds the rows' positions by ascending id; ``linked(a, others)`` says which of the
    others are linked to ``a``. Rows of one block (``_i = _j``) are all compared, else those of different blocks.
    """
    n, block = len(table), table.column("_b").to_numpy()
    single = table.column("_i")[0] == table.column("_j")[0]
    count, tree = np.zeros(n, np.int64), np.arange(n)
    block, weight = block[order], weight[order]
    other = np.flatnonzero(block != block[0]) if n and not single else None
    for a in range(n):
        if single:
            candidates = np.arange(a + 1, n)
        elif block[a] == block[0]:
            candidates = other
        else:
            continue
        if not len(candidates):
            continue
        own = linked(int(order[a]), order[candidates])
        found = candidates[own]
        if len(found):
            count[a] += weight[found].sum()
            count[found] += weight[a]
            if (tree[found] != tree[a]).any():
                joined = np.unique(np.append(tree[found], tree[a]))
                tree[np.isin(tree, joined)] = joined[0]
    out_count, out_root = np.empty(n, np.int64), np.empty(n, np.int64)
    out_count[order] = count
    out_root[order] = order[tree]
    return out_count, out_root
