"""Report, heartbeat and event sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def write_reports(reports: DataFrame, path: str) -> None:
    """Report bodies as JSON lines, with their keys, by host."""
    reports.write.mode("append").partitionBy("hostname").json(path)


def write_bodies(rows: DataFrame, path: str, body: str = "body") -> None:
    """Heartbeat or event bodies, one JSON object per line."""
    rows.select(F.col(body).alias("value")).write.mode("append").text(path)


def deliver(rows: DataFrame, send: Callable[[Iterator[Row]], None]) -> None:
    """Hand the rows of each partition to the caller's transport.

    The transport must carry the idempotency key along: a task that is run again
    sends its rows again.
    """
    rows.foreachPartition(send)


def deliver_quietly(rows: DataFrame, send: Callable[[Iterator[Row]], None]) -> None:
    """For events nobody waits for: a transport error never stops the job."""

    def attempt(partition: Iterator[Row]) -> None:
        try:
            send(partition)
        except Exception:  # noqa: BLE001  the event is lost, the work goes on
            pass

    rows.foreachPartition(attempt)
