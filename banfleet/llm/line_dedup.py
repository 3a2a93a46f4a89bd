"""Lines that many documents share, found with two Bloom filters.

Every line's key is hashed. The hashes, eight bytes for a whole line, are dealt into slices of the
hash space; a slice adds each to a filter of what was seen once, and to a second one what that
filter held already. Only lines whose key the second filter holds are suspects; only they travel
as text, to be counted exactly and to choose the first occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banfleet.llm.textbytes import LOWER, SPACE, Texts, chunks, span_hashes
from banfleet.llm.workers import discard, partitions, written

#: Hash functions of a filter, and bits for each hash it is made for: 1 in 150 is suspected in vain.
HASHES, BITS = 4, 12
#: Bits of the second filter that go to every task. Beyond 10^8 lines or so more lines are suspected
#: in vain; they take the exact way, so the result doesn't change.
MOST_BITS = 1 << 30
#: Hashes that a task gathers before it hands them on.
_HELD = 1 << 19


def lines_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line the row in the chunk, and of its key first byte, end and code points.

    A line ends at a newline or with its text. A key is a line without white space (bytes 9 to 13
    and 32) at both ends.
    """
    data, starts = texts.data, texts.starts
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([starts[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([starts[1:], breaks]), kind="stable")
    row = np.repeat(np.arange(len(starts) - 1), np.searchsorted(breaks, starts[1:]) - np.searchsorted(breaks, starts[:-1]) + 1)
    solid = np.append(np.flatnonzero(~SPACE[data]), len(data))
    first = np.minimum(solid[np.searchsorted(solid, begin)], end)
    last = np.searchsorted(solid, end)
    stop = np.where(last > 0, solid[np.maximum(last - 1, 0)] + 1, 0)
    stop = np.maximum(stop, first)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    return row, first, stop, points[stop] - points[first]


def key_hashes(texts: Texts, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return span_hashes(LOWER[texts.data], first, stop)


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Where a hash falls in a filter of ``bits``, a power of two."""
    step = (h >> np.uint64(20)) | np.uint64(1)
    for i in range(HASHES):
        yield ((h + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64)


def _slice(h: np.ndarray, slices: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(slices)).astype(np.int32)


def _by_slice(once: list[np.ndarray], more: list[np.ndarray], slices: int) -> pa.RecordBatch:
    """Hashes of one document of those gathered, and of several, as one row per slice."""
    keys, n = np.unique(np.concatenate([*once, *more, *more]), return_counts=True)
    place = _slice(keys, slices)
    order = np.argsort(place, kind="stable")
    keys, n, place = keys[order], n[order], place[order]
    edges = np.flatnonzero(np.diff(place, prepend=-1))
    cut = [(k[m == 1].tobytes(), k[m > 1].tobytes()) for k, m in zip(np.split(keys, edges[1:]), np.split(n, edges[1:]), strict=True)]
    columns = [
        pa.array(place[edges], pa.int32()),
        pa.array(np.diff(np.append(edges, len(keys))), pa.int64()),
        pa.array([x for x, _ in cut], pa.binary()),
        pa.array([x for _, x in cut], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "n", "once", "more"])


def _hashed(slices: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more, held = [], [], 0
        for batch in batches:
            for texts in chunks(batch.column("text")):
                row, first, stop, size = lines_of(texts)
                h = key_hashes(texts, first, stop)
                h, row = h[size >= least], row[size >= least]
                if not len(h):
                    continue
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                fresh = np.ones(len(h), bool)  # a document counts once
                fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                keys, n = np.unique(h[fresh], return_counts=True)
                once.append(keys[n == 1])
                more.append(keys[n > 1])
                held += len(keys)
                if held >= _HELD:
                    yield _by_slice(once, more, slices)
                    once, more, held = [], [], 0
        if held:
            yield _by_slice(once, more, slices)

    return run


def _filters(bits: int):
    """Both filters of each slice; the second one goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None

        def row() -> pa.RecordBatch:
            columns = [pa.array([at], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["slice", "bits"])

        for batch in batches:
            for slice_, single, several in zip(*(batch.column(x).to_pylist() for x in ("slice", "once", "more")), strict=True):
                if slice_ != at:
                    if at is not None:
                        yield row()
                    at, once, twice = slice_, np.zeros(bits, bool), np.zeros(bits, bool)
                new, known = np.frombuffer(single, np.uint64), np.frombuffer(several, np.uint64)
                places = list(_places(new, bits))
                seen = np.ones(len(new), bool)
                for place in places:
                    seen &= once[place]
                for place in places:
                    once[place] = True
                    twice[place[seen]] = True
                for place in _places(known, bits):
                    once[place] = twice[place] = True
        if at is not None:
            yield row()

    return run


class Suspects:
    """The second filter of all slices. Holds every key of two documents or more, and some others."""

    def __init__(self, slices: int, bits: int, found: dict[int, bytes]):
        self.slices, self.bits = slices, bits
        empty = bytes(bits // 8)
        self.table = np.frombuffer(b"".join(found.get(i, empty) for i in range(slices)), np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out, base = np.ones(len(h), bool), _slice(h, self.slices).astype(np.int64) * self.bits
        for place in _places(h, self.bits):
            place = place + base
            out &= (self.table[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
        return out


def suspects(rows: DataFrame, least: int, most_bits: int = MOST_BITS) -> Suspects:
    """Filters of all keys of ``rows`` (text). The driver gets the second one, at most ``most_bits``."""
    slices = partitions(rows.sparkSession)
    hashed = rows.select("text").mapInArrow(_hashed(slices, least), "slice int, n long, once binary, more binary")
    hashes = written(hashed, "line-hashes")
    per_slice = hashes.groupBy("slice").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 1
    room = max(8, most_bits // slices)
    bits = 1 << min(int(room).bit_length() - 1, int(per_slice * BITS).bit_length())
    dealt = hashes.repartition(slices, "slice").sortWithinPartitions("slice")
    found = dealt.mapInArrow(_filters(bits), "slice int, bits binary").collect()
    discard(hashes)
    return Suspects(slices, bits, {r["slice"]: r["bits"] for r in found})


def _suspected(filters, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in chunks(batch.column("text")):
                row, first, stop, size = lines_of(texts)
                h = key_hashes(texts, first, stop)
                hit = np.flatnonzero((size >= least) & filters.value.holds(h))
                if not len(hit):
                    continue
                lower = LOWER[texts.data]
                keys = [lower[a:b].tobytes() for a, b in zip(first[hit].tolist(), stop[hit].tolist(), strict=True)]
                own = row[hit]
                number = hit - np.searchsorted(row, own)
                rows = pa.array(own + texts.first)
                columns = [batch.column("id").take(rows), batch.column("version").take(rows), pa.array(number, pa.int64()), pa.array(keys, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "version", "line", "key"])

    return run


def repeated_lines(docs: DataFrame, *, min_docs: int = 2, least_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """Lines to drop: ``id``, ``version`` (hash of the text), ``line`` (from 0), one row each.

    A key counts by the distinct ids of the documents that hold it, compared as bytes; a null id is
    one id. With ``keep_first`` its first line, by id (nulls first) and then number, isn't listed.
    """
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    filters = spark.sparkContext.broadcast(suspects(rows, least_chars, most_bits))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_suspected(filters, least_chars), f"id {kind}, version long, line long, key binary")
    found = written(found, "suspects")
    # one row per key and document first: a key that a third of all documents hold is summed map-side
    per_doc = found.groupBy("key", "id").agg(F.min("line").alias("line"))
    first = [F.min(F.struct("id", "line")).alias("first")] if keep_first else []
    many = per_doc.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *first).where(F.col("n") >= min_docs).drop("n")
    # as a table, so that the join deals both sides itself and can split the rows of a hot key
    gone = found.join(written(many, "repeated-keys"), "key")
    if keep_first:
        gone = gone.where(~(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.line") == F.col("line"))))
    return gone.select("id", "version", "line")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, total, gone = [], [], []
        for text, lines in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True):
            if lines:
                drop, parts = set(lines), text.split(b"\n")
                text = b"\n".join([x for i, x in enumerate(parts) if i not in drop])
                total.append(len(parts))
                gone.append(len(drop))
            else:
                total.append(text.count(b"\n") + 1)
                gone.append(0)
            kept.append(text)
        columns = [batch.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n_lines", "n_dropped", "kept"])


def drop_repeated_lines(docs: DataFrame, *, min_docs: int = 2, least_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """Each document without the lines that at least ``min_docs`` documents hold.

    A text is split at newlines; a line's key is the line without ASCII white space at both ends, A
    to Z in lower case. Keys shorter than ``least_chars`` code points never go. Every line of a key
    that goes leaves every document, or with ``keep_first`` all but the first one.

    Returns one row per row: the id, ``n_lines`` before, ``n_dropped``, and ``kept`` as bytes, what
    stays joined by newlines; nothing if all lines go. A null or empty text is one empty line. Rows
    with the same id, or null ids, are kept apart but count as one document. An empty table gives
    no rows. Other columns aren't read, whatever their names.
    """
    options = {"min_docs": min_docs, "least_chars": least_chars, "keep_first": keep_first, "most_bits": most_bits}
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, **options)
    lists = gone.groupBy("id", "version").agg(F.collect_set("line").alias("lines"))
    rows, lists = _rows(docs, id_col, text_col).alias("d"), lists.alias("g")
    same = F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.version") == F.col("g.version"))
    joined = rows.join(lists, same, "left").select("d.id", "d.text", "g.lines")
    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(_without, f"id {kind}, n_lines long, n_dropped long, kept binary").withColumnRenamed("id", id_col)
