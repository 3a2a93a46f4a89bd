"""Packing documents into sequences of nearly equal length by multiway differencing.

A document's ids are cut into pieces where a sequence must end anyway. Pieces meet in groups of
bounded size, drawn by hash, and each group is split into windows by the Karmarkar-Karp method:
the two partial partitions with the widest spread are merged with opposing order, large windows
with small ones, until one is left.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banfleet.llm.pieces import Pieces
from banfleet.llm.workers import forget, text_chunks, worker_cache, worker_holds, written

#: Pieces that are packed together, on average. More fill windows better, in more time.
GROUP = 1024


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Items by window, by multiway differencing; windows may be empty.

    A partial partition holds its windows that are not empty, smallest first. Merging two pads
    both with empty windows, and adds the largest of one to the smallest of the other.
    """
    if windows == 1:
        return [list(range(len(sizes)))]
    heap = [(-size, i, 0, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, low_a, a = heapq.heappop(heap)
        _, _, low_b, b = heapq.heappop(heap)
        both = len(a) + len(b) - windows
        if both <= 0:
            merged = a + b
        else:
            merged = a[both:] + b[both:]
            merged += [(x + y, p + q) for (x, p), (y, q) in zip(a[:both], reversed(b[:both]))]
        merged.sort(key=_size)
        low = low_a + low_b
        if len(merged) == windows and (least := merged[0][0]):
            low += least
            merged = [(x - least, p) for x, p in merged]
        spread = merged[-1][0] - (merged[0][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, n, low, merged))
        n += 1
    found = [p for _, p in heap[0][3]] if heap else []
    return found + [[] for _ in range(windows - len(found))]


def _size(window: tuple[int, list[int]]) -> int:
    return window[0]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items by window, none over ``capacity``; no item is larger than that.

    Starts from as few windows as could hold all, and rises while one is too full.
    """
    total = sum(sizes)
    windows = max(1, -(-total // capacity))
    while True:
        found = difference(sizes, windows)
        over = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in found)
        if not over:
            return [w for w in found if w]
        windows += max(1, over // capacity)


_PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    alone: bool = False,
) -> DataFrame:
    """Each document's ids and ``end_id``, cut at every multiple of ``capacity``.

    With ``alone``, a worker lets go of what other operators kept in it before it loads the tokenizer.
    One row per piece: id, start, length, ids_crc32, doc_tokens, and the ids themselves if asked for.
    A null or empty text has one id, ``end_id``.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        content = f.read()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if alone and not worker_holds(("pieces", tokenizer)):
            forget()
        coder = worker_cache(("pieces", tokenizer), lambda: Pieces(content))
        last = np.array([end_id], np.int32)
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            for chunk in text_chunks(((x or "", len(x or "")) for x in texts), 4 << 20):
                rows, cut = [], []
                for row, found in enumerate(coder.ids(chunk), at):
                    ids = np.append(found, last)
                    for start in range(0, len(ids), capacity):
                        part = ids[start : start + capacity]
                        rows.append((row, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids)))
                        if with_ids:
                            cut.append(part)
                at += len(chunk)
                table = np.array(rows, np.int64)
                columns = [batch.column("id").take(pa.array(table[:, 0])), *(pa.array(table[:, i]) for i in range(1, 5))]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(cut, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, {_PIECE}" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    alone: bool = False,
) -> DataFrame:
    """One row per piece, with ``sequence_id`` and ``offset``; sequences hold at most ``capacity`` ids.

    Only the pieces' lengths and digests are shuffled, not their ids (unless asked for), and every
    group has about :data:`GROUP` pieces whatever their source, so no key can be hot. Repeated rows
    are packed like different documents; an empty table gives no rows. The pieces are written once
    to the shared folder, as their number sets the number of groups.
    """
    cut = written(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids, alone), "pieces")
    groups = max(1, -(-cut.count() // GROUP))
    drawn = F.pmod(F.xxhash64(F.col(id_col), "start", "ids_crc32"), F.lit(groups))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    grouped = cut.withColumn("_group", drawn).groupBy("_group")
    return grouped.applyInPandas(_pack_group(capacity), f"{schema}, sequence_id long, offset long")


def _pack_group(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([c for c in rows.columns if c not in ("ids", "_group")], kind="stable", ignore_index=True)
        sizes = rows["length"].to_numpy()
        window, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        # repeated rows fall into one group: packed a bounded number at a time
        first = 0
        for a in range(0, len(rows), 4 * GROUP):
            own = pack(sizes[a : a + 4 * GROUP].tolist(), capacity)
            for w, items in enumerate(own, first):
                at = np.array(items) + a
                window[at] = w
                offset[at] = np.cumsum(sizes[at]) - sizes[at]
            first += len(own)
        rows["sequence_id"] = key[0] * (1 << 32) + window
        rows["offset"] = offset
        return rows.drop(columns="_group")

    return run
