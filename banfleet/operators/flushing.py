"""When queued rows leave: every so many seconds, or at once when enough of them wait.

A host's queue empties by the second. The first row to wait opens a window. The queue is flushed in
the second in which ``early_at`` rows wait, else when the window's ``seconds`` are over. A flush takes the oldest
rows, at most ``batch``; while ``early_at`` or more still wait, the next follows in the same second, and what
stays opens a window of its own.

Which rows leave when depends on the number of rows per host and second alone. Those numbers are
summed before any shuffle, one light pass per host over its seconds decides, and rows find their
flush by their place within their second, so that no task sees all rows of a host.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banfleet import constants as C
from banfleet.operators.running import CHUNK, running, running_count

_SECOND = "hostname string, enqueued_at long, before long, sent long, first_no long, later_no long, later_at long"
_NAMES = [c.split()[0] for c in _SECOND.split(", ")]


class _Queue:
    """One host's queue, second by second; ``out`` gets a row for each second once its rows' flush is known."""

    def __init__(self, host, clock: int, no: int, seconds: int, early_at: int, batch: int, out: list):
        self.host, self.clock, self.no, self.out = host, clock, no, out
        self.seconds, self.early_at, self.batch = seconds, early_at, batch
        self.waiting, self.opened, self.open = 0, 0, []

    def _leave(self, at: int | None) -> None:
        """All that waits goes in one flush, or, with no time, stays for now."""
        no = None if at is None else self.no
        self.out += [(self.host, *x, no, at) for x in self.open]
        self.no += at is not None
        self.open, self.waiting = [], 0

    def timer(self, until: int) -> None:
        if self.waiting and self.opened + self.seconds < until:
            self._leave(self.opened + self.seconds)

    def second(self, at: int, n: int) -> None:
        if at >= self.clock:  # more may come
            self.out.append((self.host, at, 0, 0, None, None, None))
            return
        self.timer(at)
        if not self.waiting:
            self.opened = at
        before, self.waiting = self.waiting, self.waiting + n
        if self.waiting >= self.early_at:
            full, rest = divmod(self.waiting, self.batch)
            flushes = full + (rest >= self.early_at)
            sent = min(self.waiting, flushes * self.batch)
            first = self.no
            self._leave(at)  # those who waited from before are the oldest
            self.no = first + flushes
            self.waiting = before + n - sent
            self.opened, self.open = at, [(at, before, sent, first)]
            if not self.waiting:
                self._leave(None)
        else:
            self.open.append((at, before, 0, None))
            if at == self.opened + self.seconds:
                self._leave(at)

    def close(self) -> None:
        self.timer(self.clock)
        self._leave(None)


def _decide(seconds: int, early_at: int, batch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue, out = None, []
        for frame in frames:
            for host, at, n, clock, no in frame.itertuples(index=False, name=None):
                if queue is None or queue.host != host:
                    if queue is not None:
                        queue.close()
                    queue = _Queue(host, clock, no, seconds, early_at, batch, out)
                queue.second(at, n)
            yield _frame(out)
            out.clear()
        if queue is not None:
            queue.close()
            yield _frame(out)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES, dtype=object).astype({c: "Int64" for c in _NAMES[1:]})


def plan_flushes(
    queue: DataFrame,
    clocks: DataFrame | None = None,
    *,
    seconds: int = C.FLUSH_SECONDS,
    early_at: int = C.FLUSH_EARLY_AT,
    batch: int = C.BATCH_SIZE,
    width: int = CHUNK,
) -> DataFrame:
    """Queue rows with ``flush_no`` (from 0 per host) and ``flushed_at``; both null while they wait.

    Rows have ``hostname, id`` and ``enqueued_at`` in seconds, and leave in the order of time, then id. ``clocks``
    (hostname, clock, next_flush) tells how far a host's time has come, so that all rows before that second are
    there, and its next number; without it that is the second of its newest row, and 0. A host whose
    clock isn't told keeps its rows. ``early_at`` may not exceed ``batch``.
    """
    if not 0 < early_at <= batch:
        raise ValueError("early_at must lie between 1 and batch")
    if clocks is None:
        zero = F.lit(0).cast("bigint").alias("next_flush")
        clocks = queue.groupBy("hostname").agg(F.max("enqueued_at").alias("clock"), zero)
    per_second = queue.groupBy("hostname", "enqueued_at").agg(F.count(F.lit(1)).alias("n")).join(clocks, "hostname")
    in_order = per_second.select("hostname", "enqueued_at", "n", "clock", "next_flush").repartition("hostname")
    decided = in_order.sortWithinPartitions("hostname", "enqueued_at").mapInPandas(_decide(seconds, early_at, batch), _SECOND)
    placed = running(queue, ["hostname", "enqueued_at"], "id", {"_nth": running_count()}, width=width)
    place = F.col("before") + F.col("_nth") - 1
    now = place < F.col("sent")
    return placed.join(decided, ["hostname", "enqueued_at"], "left").select(
        *queue.columns,
        F.when(now, F.col("first_no") + F.floor(place / batch)).otherwise(F.col("later_no")).cast("bigint").alias("flush_no"),
        F.when(now, F.col("enqueued_at")).otherwise(F.col("later_at")).alias("flushed_at"),
    )
