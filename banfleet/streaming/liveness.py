"""Liveness: a host whose snapshots stop coming turns critical."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from banfleet import constants as C


def now_ms(timer_values, time_mode: str) -> int:
    """The stream's clock: the watermark in event time, else the wall clock."""
    if time_mode == "EventTime":
        return timer_values.getCurrentWatermarkInMs()
    return timer_values.getCurrentProcessingTimeInMs()


_OUT = "hostname string, status string, at_s bigint"
#: From best to worst; of snapshots of the same second the worst counts.
SEVERITY = ("healthy", "degraded", "critical")
_SILENT = "critical"
#: Heartbeats in a slice of a host's time.
SLICE = 64


def changes(first: np.ndarray, last: np.ndarray, status: np.ndarray, max_age: int) -> list[tuple[str, int]]:
    """Changes of status along one host's stretches (or snapshots), in order of time, silences included.

    The first entry is where the host stood before; it gives no change itself.
    """
    out = []
    silent = first[1:] - last[:-1] > max_age
    before = np.where(silent, _SILENT, status[:-1])
    for i in np.flatnonzero((silent & (status[:-1] != _SILENT)) | (status[1:] != before)).tolist():
        if silent[i] and status[i] != _SILENT:
            out.append((_SILENT, int(last[i]) + max_age + 1))
        if status[i + 1] != before[i]:
            out.append((status[i + 1], int(first[i + 1])))
    return out


def worst_by_second(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per host and second, in order: the worst, with the latest event time of all."""
    rank = rows["status"].map({x: i for i, x in enumerate(SEVERITY)}).fillna(-1)
    rows = rows.assign(rank=rank).sort_values(["hostname", "at_s", "rank", "status"])
    rows["event_time"] = rows.groupby(["hostname", "at_s"], dropna=False)["event_time"].transform("max")
    return rows.drop_duplicates(["hostname", "at_s"], keep="last").drop(columns="rank").reset_index(drop=True)


def stretches(rows: pd.DataFrame, max_age: int, width: int) -> pd.DataFrame:
    """A row for each stretch of one status without a silence, by host and slice of time: from ``first_s`` to ``at_s``.

    ``rows`` are all snapshots of their hosts and slices.
    """
    rows = worst_by_second(rows)
    host, status = (rows[x].to_numpy(object) for x in ("hostname", "status"))
    at_s = rows["at_s"].to_numpy(np.int64)
    on = (host[1:] == host[:-1]) & (at_s[1:] // width == at_s[:-1] // width)
    on &= (status[1:] == status[:-1]) & (np.diff(at_s) <= max_age)
    begins = np.append(True, ~on)
    stretch = np.cumsum(begins)
    rows["event_time"] = rows["event_time"].groupby(stretch).transform("max")
    rows = rows[np.append(~on, True)]
    return rows.assign(first_s=at_s[begins])


def thinned(snapshots: DataFrame, max_age: int, width: int) -> DataFrame:
    """Snapshots as stretches: hostname, first_s, at_s, status, event_time.

    Seconds are reduced to their worst snapshot before the shuffle. That is by host and slice of time, so a
    host with many snapshots is spread over tasks, and each slice is seen whole, in whatever files it came.
    """
    columns = ["hostname", "at_s", "status", "event_time"]
    rows = snapshots.select(*columns).where("at_s is not null")

    def worst(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield worst_by_second(pdf)[columns]

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in frames if len(pdf)]
        if held:
            yield stretches(pd.concat(held, ignore_index=True), max_age, width)[["first_s", *columns]]

    by_slice = rows.mapInPandas(worst, rows.schema).repartition("hostname", F.floor(F.col("at_s") / width))
    kinds = ", ".join(f"{x} {rows.schema[x].dataType.simpleString()}" for x in columns)
    return by_slice.mapInPandas(joined, f"first_s bigint, {kinds}")


class LivenessProcessor(StatefulProcessor):
    """Keeps the latest snapshot time of one host and reports changes of status."""

    def __init__(self, max_age: int, time_mode: str):
        self.max_age, self.time_mode = max_age, time_mode

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at_s bigint, status string, due bigint")

    def _frame(self, key, found: list[tuple[str, int]]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame([(key[0], *x) for x in found], columns=["hostname", "status", "at_s"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([pdf[["first_s", "at_s", "status"]] for pdf in rows], ignore_index=True).sort_values("at_s")
        at_s, status, due = self.latest.get() if self.latest.exists() else (None, None, None)
        if due is not None:
            self.handle.deleteTimer(due)
        if at_s is not None:  # what is older than the latest came too late
            new = new[new["at_s"] > at_s]
            new = new.assign(first_s=new["first_s"].clip(lower=at_s + 1))
        starts, times, states = (new[x].to_numpy() for x in ("first_s", "at_s", "status"))
        found = []
        if at_s is not None:
            starts, times = np.append(at_s, starts), np.append(at_s, times)
            states = np.append(np.array([status], object), states)
        else:
            found.append((states[0], int(starts[0])))
        found += changes(starts, times, states, self.max_age)
        newest, last = int(times[-1]), states[-1]
        # stale means strictly older than the limit
        due = (newest + self.max_age + 1) * 1000
        if due <= now_ms(timerValues, self.time_mode):
            if last != _SILENT:
                found.append((_SILENT, newest + self.max_age + 1))
            last, due = _SILENT, None
        else:
            self.handle.registerTimer(due)
        self.latest.update((newest, last, due))
        yield from self._frame(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at_s, status, _ = self.latest.get()
        self.latest.update((at_s, _SILENT, None))
        if status != _SILENT:
            yield from self._frame(key, [(_SILENT, at_s + self.max_age + 1)])


def liveness_stream(
    snapshots: DataFrame,
    *,
    heartbeat_seconds: int = C.HEARTBEAT_SECONDS,
    time_mode: str = "ProcessingTime",
) -> DataFrame:
    """Status changes per host from a stream of ``hostname, at_s, status, event_time``.

    Every silence longer than two heartbeats turns a host critical, whether it lies within a
    micro-batch, between two, or is still going on. The changes don't depend on how the stream is
    cut, as long as a host's snapshots arrive in the order of time, those of the same second together; one
    that isn't newer than the latest of an earlier micro-batch is passed over (a stretch that began before counts from the next second), and so is one without a
    time. Of the same second the worst counts. A host sends its task rows in proportion to its changes, silences and slices of time, see
    :func:`thinned`. A host never seen has no state: the batch status covers those.
    """
    rows = thinned(snapshots, 2 * heartbeat_seconds, SLICE * heartbeat_seconds)
    if time_mode == "EventTime":
        rows = rows.withWatermark("event_time", "0 seconds")
    return rows.groupBy("hostname").transformWithStateInPandas(
        statefulProcessor=LivenessProcessor(2 * heartbeat_seconds, time_mode),
        outputStructType=_OUT,
        outputMode="Append",
        timeMode=time_mode,
    )
