"""Removal of byte strings that repeat across documents, by suffix arrays built in two stages.

Every string of :data:`LENGTH` bytes belongs to one anchor, the run of :data:`GRAM` bytes in it with
the least hash; equal strings have equal anchors. Only around anchors that several documents
hold can a string repeat. Their surroundings meet by anchor, and a task builds the suffix array of
what it gets: suffixes smaller than their successors are sorted directly, the others are induced by
scans over the buckets, and neighbours with a common prefix of the whole length are equal strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banfleet.llm.textbytes import Texts, chunks, mixed, span_hashes
from banfleet.llm.tiles import stretches
from banfleet.llm.workers import discard, release, written

LENGTH = 50
GRAM = 24
#: Anchors gathered in a task before they are sent on.
FLUSH = 1 << 20
#: Bytes of a text whose anchors are found together; a longer one is worked on in windows.
WINDOW = 4 << 20
#: Bytes of text gathered in a task before they are sent on.
FLUSH_BYTES = 16 << 20
#: Bytes of a suffix array's text, about.
ARRAY = 3 << 20
#: An anchor is common from so many documents on; at most so many of them, the commonest, are listed.
COMMON, LISTED = 20_000, 100_000

_ANCHOR = np.dtype([("fp", "u8"), ("id", "i8"), ("lo", "i4"), ("n", "i4")])
_MARK = np.dtype([("fp", "u8"), ("lo", "i4"), ("n", "u1")])
_SPAN = np.dtype([("lo", "i4"), ("hi", "i4")])
_BLOB = "kind int, bucket int, id long, data binary"
_NAMES = ["kind", "bucket", "id", "data"]


# -- suffix arrays ---------------------------------------------------------------------------


def keys_of(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number that sorts like them; zeros past the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(text)]
    return out


def rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1:] = -1
    last = np.where(step != 0, np.arange(n), n)
    decides = np.minimum.accumulate(last[::-1])[::-1]
    return step[decides] > 0


def _direct(at: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` bytes from them on, eight at a time where still equal."""
    order = at[np.argsort(keys[at], kind="stable")]
    group = keys[order]
    same = np.zeros(len(order), bool)
    same[1:] = group[1:] == group[:-1]
    for offset in range(8, depth, 8):
        tied = same.copy()
        tied[:-1] |= same[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        run = np.cumsum(~same[where])
        beyond = order[where] + offset
        more = np.where(beyond < len(keys), keys[np.minimum(beyond, len(keys) - 1)], np.uint64(0))
        new = np.lexsort((more, run))
        order[where] = order[where][new]
        more = more[new]
        same[where[1:]] &= more[1:] == more[:-1]
    return order


def suffix_array(text: np.ndarray, depth: int = LENGTH + 6) -> np.ndarray:
    """Positions sorted by the text from them on, at least ``depth`` bytes deep."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    keys, up = keys_of(text), rising(text)
    direct = _direct(np.flatnonzero(up), keys, depth)
    ends = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        induced = []
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(wave):
            induced.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & ~up[before]]
        bucket = np.concatenate([*induced, direct[ends[c] : ends[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & ~up[before]]
        if len(before):
            first = text[before]
            before = before[np.argsort(first, kind="stable")]
            count = np.bincount(first, minlength=256)
            cuts = np.cumsum(count)
            for x in np.flatnonzero(count).tolist():
                waiting[x].append(before[cuts[x] - count[x] : cuts[x]])
    return np.concatenate(out)


def repeated(text: np.ndarray, starts: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which strings of ``length`` bytes, at ``starts``, a smaller owner also has.

    ``starts`` are ascending; no string reaches past the text's end.
    """
    place = np.full(len(text), -1)
    place[starts] = np.arange(len(starts))
    order = place[suffix_array(text, length)]
    order = order[order >= 0]
    at, keys = starts[order], keys_of(text)
    equal = np.ones(max(len(at) - 1, 0), bool)
    for offset in [*range(0, length - 8, 8), length - 8]:
        part = keys[at + offset]
        equal &= part[1:] == part[:-1]
    first = np.flatnonzero(np.append(True, ~equal))
    least = np.minimum.reduceat(owner[order], first)
    run = np.cumsum(np.append(True, ~equal)) - 1
    out = np.zeros(len(starts), bool)
    out[order] = owner[order] > least[run]
    return out


# -- anchors ---------------------------------------------------------------------------------


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with the same anchor: hash of the anchor, first string, number of strings.

    ``data`` is shorter than 16 MB, so that places fit into 24 bits.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(data) - GRAM + 1)
    h = span_hashes(data, at, at + GRAM)
    low = np.uint64((1 << 24) - 1)
    rank = h & ~low | at.astype(np.uint64)
    width = LENGTH - GRAM + 1
    least, span = rank, 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    valid = np.ones(n, bool)
    for end in starts[1:-1]:  # strings that would cross the end of a text
        valid[max(0, end - LENGTH + 1) : end] = False
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    s = np.flatnonzero(valid)
    first = s[new[s]]
    count = np.diff(np.append(np.searchsorted(s, first), len(s)))
    return h[(least[first] & low).astype(np.int64)], first, count


def _windows(texts: Texts, window: int) -> Iterator[tuple[int, Texts]]:
    """A long text in stretches that overlap so that each string is whole in one; with where they begin."""
    n = len(texts.data)
    if n < window + LENGTH or len(texts.starts) > 2:
        yield 0, texts
        return
    for at in range(0, n - LENGTH + 1, window):
        data = texts.data[at : at + window + LENGTH - 1]
        yield at, Texts(texts.first, data, np.array([0, len(data)]))


def _packed(records: np.ndarray) -> bytes:
    """Records by column and byte, compressed: ids and places have few different high bytes."""
    planes = [np.ascontiguousarray(records[x]).view(np.uint8).reshape(len(records), -1).T.tobytes() for x in records.dtype.names]
    return len(records).to_bytes(4, "little") + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    out = []
    for blob in blobs:
        n = int.from_bytes(blob[:4], "little")
        raw = np.frombuffer(pa.decompress(blob[4:], n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
        records, at = np.empty(n, kind), 0
        for name in kind.names:
            size = n * kind[name].itemsize
            column = np.ascontiguousarray(raw[at : at + size].reshape(-1, n).T)
            records[name] = column.view(kind[name]).reshape(n)
            at += size
        out.append(records)
    return np.concatenate(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES)


def _cuts(values: np.ndarray) -> list[int]:
    """Where values change, with both ends."""
    if not len(values):
        return [0]
    return [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]


def _with_id(kind: np.dtype) -> np.dtype:
    return np.dtype([("id", "i8"), *((x, kind[x]) for x in kind.names)])


def _by_document(ids: np.ndarray, records: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """What is known about documents, a row (kind 1) per bucket of documents."""
    bucket = (mixed(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((ids, bucket))
    own, bucket = np.empty(len(ids), _with_id(records.dtype)), bucket[order]
    own["id"] = ids[order]
    for name in records.dtype.names:
        own[name] = records[name][order]
    cuts = _cuts(bucket)
    if len(own):
        yield _batch([(1, int(bucket[a]), None, _packed(own[a:b])) for a, b in zip(cuts, cuts[1:])])


def _of_documents(kind: np.dtype):
    """Rows by bucket of documents to a row per document: its records, without the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in stretches(batches, ["bucket"]):
            found = _unpacked(table.column("data").to_pylist(), _with_id(kind))
            found = found[np.argsort(found["id"], kind="stable")]
            records = np.empty(len(found), kind)
            for name in kind.names:
                records[name] = found[name]
            cuts = _cuts(found["id"])
            for i in range(0, len(cuts) - 1, 10_000):
                own = cuts[i : i + 10_001]
                blobs = pa.array([records[a:b].tobytes() for a, b in zip(own, own[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(found["id"][own[:-1]]), blobs], names=["id", "data"])

    return run


def _documents(rows: DataFrame, kind: np.dtype) -> DataFrame:
    """One row per document, id and ``data``, of rows by bucket of documents."""
    met = rows.select("bucket", "data").repartition("bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(_of_documents(kind), "id long, data binary")


class _Outbox:
    """What a task finds for documents, whatever the bucket of anchors it works on; sent on each time it is much."""

    def __init__(self, buckets: int, limit: int):
        self.buckets, self.limit, self.held, self.size = buckets, limit, [], 0

    def add(self, ids: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((ids, records))
        self.size += len(ids)
        if self.size >= self.limit:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            ids, records = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.size = [], 0
            yield from _by_document(ids, records, self.buckets)


def _marks(records: np.ndarray) -> np.ndarray:
    out = np.empty(len(records), _MARK)
    for name in _MARK.names:
        out[name] = records[name]
    return out


def _known(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records of anchors that two documents share here, and what others have to be told.

    The second holds all records of the other anchors, and one with ``n`` 0 and the number of records in
    ``lo`` for each shared one.
    """
    records = records[np.argsort(records["fp"], kind="stable")]
    first = np.flatnonzero(np.append(True, records["fp"][1:] != records["fp"][:-1]))
    size = np.diff(np.append(first, len(records)))
    told = records["n"] == 0
    ids = records["id"]
    shared = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
    shared |= np.logical_or.reduceat(told, first)
    weight = np.add.reduceat(np.where(told, records["lo"], 1).astype(np.int64), first)
    every = np.repeat(shared, size)
    signs = records[first[shared]]
    signs["n"], signs["lo"] = 0, np.minimum(weight[shared], 1 << 30)
    return records[every & ~told], np.concatenate([records[~every], signs])


def _find(buckets: int):
    """Texts to anchors by bucket (kind 0), and to anchors already known to be shared (kind 1)."""

    def send(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        shared, rest = _known(records)
        yield from _by_document(shared["id"], _marks(shared), buckets)
        bucket = (rest["fp"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rest, bucket = rest[order], bucket[order]
        cuts = _cuts(bucket)
        if len(rest):
            yield _batch([(0, int(bucket[a]), None, _packed(rest[a:b])) for a, b in zip(cuts, cuts[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for begin, c in (x for whole in chunks(batch.column("text")) for x in _windows(whole, WINDOW)):
                fp, first, count = anchors(c.data, c.starts)
                own = np.searchsorted(c.starts, first, "right") - 1
                records = np.empty(len(fp), _ANCHOR)
                records["fp"], records["id"] = fp, ids[c.first + own]
                records["lo"], records["n"] = begin + first - c.starts[own], count
                held.append(records)
                size += len(records)
                if size >= FLUSH:
                    yield from send(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield from send(np.concatenate(held))

    return run


def _meet(common: int, buckets: int):
    """Anchors by bucket to shared ones by document (kind 1) and to common ones (kind 2, count as id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outbox = _Outbox(buckets, FLUSH)
        for table in stretches(batches, ["bucket", "kind"]):
            if table.column("kind")[0].as_py() == 1:
                yield from table.to_batches()
                continue
            shared, rest = _known(_unpacked(table.column("data").to_pylist(), _ANCHOR))
            yield from outbox.add(shared["id"], _marks(shared))
            signs = rest[(rest["n"] == 0) & (rest["lo"] >= common)]
            if len(signs):
                yield _batch([(2, 0, int(n), x.tobytes()) for x, n in zip(signs["fp"], signs["lo"])])
        yield from outbox.rest()

    return run


# -- strings around shared anchors -------------------------------------------------------------

_PLACE = np.dtype([("fp", "u8"), ("id", "i8"), ("lo", "i4"), ("size", "i4")])


def _alone(place: np.ndarray, raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which surroundings equal those of a smaller document, the first that each equals, and which anchors have no other.

    They lie in ``raw``, meet by a hash and are compared byte by byte. In the first kind every string repeats; what is not of it equals only surroundings of its
    own document, so that the first of them can stand for all. The last kind can only repeat elsewhere.
    """
    one = span_hashes(np.frombuffer(raw, np.uint8), begin, end)
    order = np.lexsort((place["id"], one))
    new = np.append(True, one[order][1:] != one[order][:-1])
    twin = np.empty(len(place), np.int64)
    twin[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    copies = np.flatnonzero(twin != np.arange(len(place)))
    ends = (x[y].tolist() for y in (copies, twin[copies]) for x in (begin, end))
    equal = np.fromiter((raw[a:b] == raw[c:d] for a, b, c, d in zip(*ends)), bool, len(copies))
    twin[copies[~equal]] = copies[~equal]
    again = place["id"] > place["id"][twin]
    order = np.argsort(place["fp"], kind="stable")
    fp = place["fp"][order]
    first = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
    kept = np.add.reduceat((twin == np.arange(len(place)))[order].astype(np.int64), first)
    single = np.zeros(len(place), bool)
    single[order] = np.repeat(kept == 1, np.diff(np.append(first, len(fp))))
    return again, twin, single


def _copied(place: np.ndarray, of: np.ndarray, at: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and spans of all surroundings ``of`` which ``at`` stands, by the spans found in that one."""
    order = np.argsort(of, kind="stable")
    low, high = (np.searchsorted(of[order], at, side) for side in ("left", "right"))
    n = high - low
    to = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
    out, shift = np.repeat(spans, n), place["lo"][to] - np.repeat(place["lo"][at], n)
    out["lo"] += shift
    out["hi"] += shift
    return place["id"][to], out


def _spans(place: np.ndarray) -> np.ndarray:
    out = np.empty(len(place), _SPAN)
    out["lo"] = place["lo"]
    out["hi"] = place["lo"] + place["size"]
    return out


def _cut(common: np.ndarray, arrays: int, buckets: int):
    """Texts with their shared anchors to surroundings by bucket (kind 0), and to spans (kind 1).

    Of surroundings that are equal here, only the least document's go on; in the others
    every string is known to repeat.
    """

    def send(places, texts) -> Iterator[pa.RecordBatch]:
        place, raw = np.concatenate(places), b"".join(texts)
        end = np.cumsum(place["size"].astype(np.int64))
        begin = end - place["size"]
        again, _, _ = _alone(place, raw, begin, end)
        yield from _by_document(place["id"][again], _spans(place[again]), buckets)
        on = np.flatnonzero(~again)
        bucket = (mixed(place["fp"][on]) % np.uint64(arrays)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        on, bucket, rows = on[order], bucket[order], []
        cuts = _cuts(bucket)
        for a, b in zip(cuts, cuts[1:]):
            own = on[a:b]
            head = _packed(place[own])
            body = b"".join([raw[x:y] for x, y in zip(begin[own].tolist(), end[own].tolist())])
            body = pa.compress(body, codec="zstd", asbytes=True)  # surroundings overlap, and are most of what is sent
            rows.append((0, int(bucket[a]), None, len(head).to_bytes(4, "little") + head + body))
        if rows:
            yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, texts, size = [], [], 0
        for batch in batches:
            for id_, blob, text in zip(*(batch.column(x).to_pylist() for x in ("id", "data", "text"))):
                records = np.frombuffer(blob, _MARK)
                raw = text.encode()
                lo, n, fp = records["lo"].astype(np.int64), records["n"].astype(np.int64), records["fp"]
                if len(common) and (hot := np.isin(fp, common)).any():
                    # single strings, which meet by their own hash
                    each = np.repeat(lo[hot], n[hot]) + np.arange(n[hot].sum()) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
                    each.sort()
                    own = span_hashes(np.frombuffer(raw, np.uint8), each, each + LENGTH)
                    lo, n, fp = (np.concatenate(x) for x in ((lo[~hot], each), (n[~hot], np.ones(len(each), np.int64)), (fp[~hot], own)))
                place = np.empty(len(lo), _PLACE)
                place["fp"], place["id"], place["lo"], place["size"] = fp, id_, lo, n + LENGTH - 1
                places.append(place)
                texts += [raw[a:b] for a, b in zip(lo.tolist(), (lo + place["size"]).tolist())]
                size += int(place["size"].sum())
                if size >= FLUSH_BYTES:
                    yield from send(places, texts)
                    places, texts, size = [], [], 0
        if size:
            yield from send(places, texts)

    return run


def _sort(buckets: int):
    """Surroundings by bucket to spans that repeat a smaller document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outbox = _Outbox(buckets, FLUSH)
        for table in stretches(batches, ["bucket", "kind"]):
            if table.column("kind")[0].as_py() == 1:
                yield from table.to_batches()
                continue
            places, bodies = [], []
            for blob in table.column("data").to_pylist():
                cut = 4 + int.from_bytes(blob[:4], "little")
                places.append(_unpacked([blob[4:cut]], _PLACE))
                size = int(places[-1]["size"].sum(dtype=np.int64))
                bodies.append(pa.decompress(blob[cut:], size, codec="zstd", asbytes=True))
            place, raw = np.concatenate(places), b"".join(bodies)
            size = place["size"].astype(np.int64)
            begin = np.cumsum(size) - size
            again, twin, single = _alone(place, raw, begin, begin + size)
            yield from outbox.add(place["id"][again], _spans(place[again]))
            left = np.flatnonzero((twin == np.arange(len(place))) & ~single)
            if not len(left):
                continue
            text = np.frombuffer(b"".join([raw[a : a + n] for a, n in zip(begin[left].tolist(), size[left].tolist())]), np.uint8)
            at, spans = _repeating(place[left], text)
            own = np.flatnonzero(~again)
            yield from outbox.add(*_copied(place[own], np.searchsorted(own, twin[own]), np.searchsorted(own, left[at]), spans))
        yield from outbox.rest()

    return run


def _repeating(place: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and spans of what repeats a smaller document's, among surroundings that lie after each other."""
    size = place["size"].astype(np.int64)
    begin, n = np.cumsum(size) - size, size - LENGTH + 1
    own = np.repeat(np.arange(len(place)), n)
    inner = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    again = repeated(text, begin[own] + inner, place["id"][own])
    # neighbouring strings make one span
    start = again.copy()
    start[1:] &= ~again[:-1] | (inner[1:] == 0)
    stop = again.copy()
    stop[:-1] &= ~again[1:] | (inner[1:] == 0)
    first, last = np.flatnonzero(start), np.flatnonzero(stop)
    spans = np.empty(len(first), _SPAN)
    spans["lo"] = place["lo"][own[first]] + inner[first]
    spans["hi"] = place["lo"][own[last]] + inner[last] + LENGTH
    return own[first], spans


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Spans as maximal runs."""
    spans = spans[np.argsort(spans["lo"], kind="stable")]
    reach = np.maximum.accumulate(spans["hi"])
    first = np.flatnonzero(np.append(True, spans["lo"][1:] > reach[:-1]))
    last = np.append(first[1:] - 1, len(spans) - 1)
    return list(zip(spans["lo"][first].tolist(), reach[last].tolist()))


def _remove(others: list[str], whole_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, blob in zip(batch.column("text").to_pylist(), batch.column("data").to_pylist()):
                raw = (text or "").encode()
                runs = merged(np.frombuffer(blob, _SPAN)) if blob else []
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in runs), runs, b"".join(kept)))
            n, removed, runs, kept = zip(*rows) if rows else ((), (), (), ())
            spans = pa.array([[{"start": a, "end": b} for a, b in x] for x in runs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [*batch.select(["row", *others]).columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), spans, pa.array(kept, pa.binary())]
            names = ["row", *others, "n_bytes", "n_removed", "spans", "kept"]
            if whole_rows:
                columns.append(pa.array([x.decode(errors="ignore") for x in kept], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs) and ``kept`` (bytes).

    Each byte covered by a string of :data:`LENGTH` bytes that also starts in a document with a smaller id is
    removed; overlaps count, and strings are judged on the input. A null text is empty. Rows with a
    null id lose nothing and cost nobody anything. Ids are meant to be unique: rows with an equal id aren't judged
    against each other, and of different texts only those with the least checksum take part. Other columns are not
    read; an empty table gives no rows. With ``whole_rows`` they are kept in a struct ``rest``, and ``kept_text``
    has the whole characters that are left.

    What tasks send on about an anchor or a string is one row per task, however many documents hold it, and
    what they found for documents is a row per task and bucket of documents.
    Around an anchor that very many documents hold, single strings meet by their own hash; the list of such
    anchors is bounded by :data:`LISTED` and sent with the tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    others = [c for c in docs.columns if c not in (id_col, text_col)] if whole_rows else []
    rest = [F.struct(*others).alias("rest")] if others else []
    rows = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"), *rest)
    keyed = rows.withColumn("id", F.col("row").cast("long"))
    twice = keyed.groupBy("id").agg(F.min(F.crc32("text")).alias("least"), F.max(F.crc32("text")).alias("most"), F.count(F.lit(1)).alias("n"))
    texts = keyed.select("id", "text").where("id is not null and text is not null")
    twice = twice.where("least < most").select("id", "least")
    several = not keyed.select("id").groupBy("id").count().where("id is not null and count > 1").isEmpty()
    if several:  # else their texts need not be looked at
        texts = texts.join(twice, "id", "left").where("least is null or crc32(text) = least").select("id", "text").distinct()
    spark, buckets, keys = docs.sparkSession, 4 * max(1, docs.rdd.getNumPartitions()), ["bucket", "kind"]
    found = texts.mapInArrow(_find(buckets), _BLOB).repartition("bucket").sortWithinPartitions(*keys)
    met = written(found.mapInArrow(_meet(COMMON, buckets), _BLOB), "shared")
    del found
    release(spark)
    hot = met.where("kind = 2").orderBy(F.desc("id"), "data").limit(LISTED).select("data").collect()
    common = np.unique(np.frombuffer(b"".join(bytes(x[0]) for x in hot), np.uint64))
    shared = written(_documents(met.where("kind = 1"), _MARK), "marks")
    discard(met)
    size = shared.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0] // _MARK.itemsize
    arrays = max(1, -(-size * (LENGTH + 14) // ARRAY))
    cut = shared.join(texts, "id").select("id", "data", "text").mapInArrow(_cut(common, arrays, buckets), _BLOB)
    cut = cut.repartition("bucket").sortWithinPartitions(*keys)
    spans = written(cut.mapInArrow(_sort(buckets), _BLOB).select("bucket", "data"), "spans")
    del cut
    discard(shared)
    release(spark)
    of_text = _documents(spans, _SPAN)
    if several:
        of_text = of_text.join(twice, "id", "left")
        data = F.expr("CASE WHEN least IS NULL OR crc32(text) = least THEN data END")
    else:
        data = F.col("data")
    every = keyed.join(of_text, "id", "left").select("row", "text", data.alias("data"), *(["rest"] if others else []))
    kinds = f", rest {rows.schema['rest'].dataType.simpleString()}" if others else ""
    fields = "n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    fields += ", kept_text string" if whole_rows else ""
    removed = every.mapInArrow(_remove(["rest"] if others else [], whole_rows), f"row {kind}{kinds}, {fields}")
    return removed.withColumnRenamed("row", id_col)
