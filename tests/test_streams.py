"""Each stream, over several micro-batches and restarts, equals its batch twin."""

import datetime
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from banfleet.operators import breaker as b
from banfleet.operators import feed as f
from banfleet.operators import outbox
from banfleet.plans import streams
from banfleet.plans.streams import _finish, _rocksdb
from banfleet.sources import segments
from banfleet.streaming import breaker as sb
from banfleet.streaming.dedup import dedup_stream, kept_reports
from banfleet.streaming.ingest import ingest, read_queue
from banfleet.streaming.liveness import SEVERITY, changes, liveness_stream, thinned, worst_by_second
from tools.check import compare, duck
from banfleet.streaming.merge import applied_state, merge_stream

LINE = "2025-11-02 07:41:09,880 fail2ban.actions [771]: NOTICE  [ftp-in] Ban 10.0.0."


def put_segment(folder, host, name, lines):
    path = f"{folder}/hostname={host}"
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as out:
        out.write("\n".join(lines) + "\n")


def files(spark, folder, df, parts, order):
    """One parquet file per part, oldest first."""
    lowest, highest = df.agg(F.min(order), F.max(order)).first()
    step = (highest - lowest) // parts + 1
    for i in range(parts):
        start = lowest + i * step
        part = df.where(F.col(order).between(start, start + step - 1)).coalesce(1)
        part.write.mode("append").parquet(f"{folder}/p{i:02}")


def stream_of(spark, folder, schema):
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .parquet(f"{folder}/p*")
    )


def test_ingest_reads_each_segment_once(spark, folder, rows):
    counts = {}
    log, out, point = f"{folder}/log", f"{folder}/queue", f"{folder}/point"

    def run():
        lines = segments.stream_segments(spark, log, files_per_trigger=1)
        zones = spark.createDataFrame([("a", "Europe/Madrid")], "hostname string, tz string")
        _finish(ingest(lines, out, point, zones, on_count=lambda i, n: counts.update({i: n})))

    put_segment(log, "a", "1", [LINE + "1", "noise", LINE + "2", LINE + "2"])
    put_segment(log, "b", "1", [LINE + "9"])
    run()
    put_segment(log, "c", "1", ["nothing of interest"])
    put_segment(log, "a", "2", [LINE + "3"])  # a rotated log is a new segment
    run()
    run()
    got = read_queue(spark, out)
    assert rows(got, "hostname", "ip") == [
        ("a", "10.0.0.1"), ("a", "10.0.0.2"), ("a", "10.0.0.2"), ("a", "10.0.0.3"), ("b", "10.0.0.9")
    ]
    assert sum(counts.values()) == 5
    first = got.where("hostname = 'a'").orderBy("id").collect()
    assert [(r.id, r.ip) for r in first] == [(1, "10.0.0.1"), (2, "10.0.0.2"), (3, "10.0.0.2"), (4, "10.0.0.3")]
    at = dict(rows(got, "hostname", "banned_at"))
    assert at["a"] != at["b"] and all(r.enqueued_at > 1_700_000_000 for r in first)  # b's clock is UTC
    # the queue operators take it as it is
    head = outbox.head(got)
    assert rows(head.where("hostname = 'a'"), "id") == [(1,), (2,), (3,), (4,)]
    assert sum(r.bans for r in outbox.assemble_reports(outbox.cut_batches(got)).select(F.col("n_bans").alias("bans")).collect()) == 5


def test_ingest_replayed_batch(spark, folder, rows):
    no_zones = spark.createDataFrame([], "hostname string, tz string")
    """A batch whose commit was lost runs again and replaces its own output."""
    log, out, point = f"{folder}/log", f"{folder}/queue", f"{folder}/point"
    put_segment(log, "a", "1", [LINE + "1"])
    _finish(ingest(segments.stream_segments(spark, log), out, point, no_zones))
    for name in os.listdir(f"{point}/commits"):
        os.unlink(f"{point}/commits/{name}")
    _finish(ingest(segments.stream_segments(spark, log), out, point, no_zones))
    assert rows(read_queue(spark, out), "ip") == [("10.0.0.1",)]


@pytest.mark.parametrize("many", [4, 24])
def test_flush_query_over_many_segments(spark, folder, monkeypatch, many):
    """As many micro-batches for any number of segments, and the rows of the SQL, also when times step back."""
    began, width = datetime.datetime(2024, 1, 1), segments.CHUNK
    events = [
        (part * width + 10 * i, began + datetime.timedelta(minutes=97 * i + part % 3), host, "click", 1.0, '{"k": 1}')
        for part in range(many) for host in (1, 2, 3) for i in range(host, 30, 3)
    ]
    events += [(None, began, 3, "click", 1.0, '{"k": 1}'), (many * width, None, 3, "click", 1.0, '{"k": 1}')]
    columns = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, columns).coalesce(1).write.parquet(f"{folder}/write")
    [file] = [n for n in os.listdir(f"{folder}/write") if n.endswith(".parquet")]
    os.mkdir(f"{folder}/sf")
    os.link(f"{folder}/write/{file}", f"{folder}/sf/events.parquet")
    monkeypatch.setattr(streams, "scratch_folder", lambda spark, name: f"{folder}/{name}")
    ok, note = compare(spark, duck(f"{folder}/sf"), f"{folder}/sf", "stream_flush")
    assert ok, note
    commits = {point: len([n for n in os.listdir(f"{folder}/flush/{point}/commits") if n.isdigit()]) for point in ("checkpoint", "sent-checkpoint")}
    assert commits == {"checkpoint": 3, "sent-checkpoint": 1}


def test_ingest_query_without_line_numbers(spark, folder):
    """No event, or none with a number, makes one rotation that still keeps every line."""
    columns = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for name, events in (("empty", []), ("unnumbered", [(None, datetime.datetime(2024, 1, 1), 1, "click", 1.0, '{"k": 1}')])):
        spark.createDataFrame(events, columns).write.parquet(f"{folder}/{name}/events.parquet")
        [lines] = streams._rotations(spark, f"{folder}/{name}")
        assert lines.count() == len(events)


OPS = (
    "hostname string, ip string, page_no long, pos long, op string, source string, at_s long, "
    "enforced boolean"
)


@pytest.mark.parametrize("compact_every", [2, 100])
def test_merge_equals_batch(spark, folder, rows, compact_every):
    rnd = random.Random(6)
    ops = [
        (f"h{rnd.randrange(2)}", f"ip{rnd.randrange(12)}", i // 20, i % 20,
         rnd.choice(["add", "add", "remove", "noop"]), rnd.choice(["tenant", "global", None]),
         1000 + i, rnd.random() < 0.9)
        for i in range(200)
    ]
    df = spark.createDataFrame(ops, OPS)
    files(spark, f"{folder}/in", df, 5, "page_no")
    stream = stream_of(spark, f"{folder}/in", df.schema)
    _finish(merge_stream(stream, f"{folder}/s", f"{folder}/c", compact_every=compact_every))
    want = f.apply_ops(f.valid_ops(df).where("enforced"))
    assert rows(applied_state(spark, f"{folder}/s")) == rows(want)


def test_dedup_equals_batch(spark, folder, rows):
    rnd = random.Random(12)
    data, at = [], 0
    for seq in range(400):
        at += rnd.randrange(4)
        data.append(("h", "hot" if rnd.random() < 0.34 else f"k{rnd.randrange(30)}", seq, at))
    kept, last = [], {}
    for host, key, seq, t in data:
        if key not in last or t >= last[key] + 25:
            last[key] = t
            kept.append((key, seq, t))
    df = spark.createDataFrame(
        data, "hostname string, idempotency_key string, seq long, received_at long"
    )
    files(spark, f"{folder}/in", df, 5, "seq")
    stream = stream_of(spark, f"{folder}/in", df.schema)
    _finish(dedup_stream(stream, f"{folder}/o", f"{folder}/c", seconds=25))
    got = kept_reports(spark, f"{folder}/o")
    assert rows(got, "idempotency_key", "seq", "received_at") == sorted(kept)


def test_breaker_stream_equals_batch(spark, folder, rows):
    rnd = random.Random(8)
    data, at = [], 0
    for seq in range(300):
        at += rnd.randrange(4)
        data.append((rnd.choice(["hot", "hot", "a", "b"]), seq, at, rnd.choice([True, False, None])))
    df = spark.createDataFrame(data, "hostname string, seq long, at_s long, ok boolean")
    files(spark, f"{folder}/in", df, 4, "seq")
    rules = b.Rules(2, 5, 40)
    stream = stream_of(spark, f"{folder}/in", df.schema)
    _finish(sb.breaker_stream(stream, f"{folder}/o", f"{folder}/c", rules))
    columns = ["hostname", "seq", "allowed", "state", "failures", "cooldown", "open_until"]
    want = {tuple(r) for r in b.replay(df, rules).select(*columns).collect()}
    got = {tuple(r) for r in sb.decisions(spark, f"{folder}/o").select(*columns).collect()}
    assert got == want


def run_event_time(spark, folder, stream):
    with _rocksdb(spark):
        _finish(
            stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c")
            .trigger(availableNow=True).start(f"{folder}/out")
        )
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("cut", [1, 2, 3])
def test_liveness_reports_every_silence(spark, folder, rows, cut):
    """Whatever the cut into micro-batches, as long as time goes forward."""
    data = [
        ("a", 990, "degraded"), ("b", 1000, "healthy"), ("b", 1000, "degraded"), ("a", 1000, "healthy"), ("a", 1100, "degraded"),
        ("a", 1190, "degraded"), ("c", 1400, "healthy"), ("b", 1420, "healthy"), ("c", 5000, "healthy"),
    ]
    size = -(-len(data) // cut)
    for i in range(0, len(data), size):
        df = spark.createDataFrame(data[i : i + size], "hostname string, at_s long, status string").withColumn(
            "event_time", F.timestamp_seconds("at_s")
        )
        df.coalesce(1).write.parquet(f"{folder}/in/p{i}")
    stream = stream_of(spark, f"{folder}/in", df.schema)
    out = run_event_time(
        spark, folder, liveness_stream(stream, heartbeat_seconds=60, time_mode="EventTime")
    )
    assert rows(out, "hostname", "at_s", "status") == [
        ("a", 990, "degraded"), ("a", 1000, "healthy"), ("a", 1100, "degraded"), ("a", 1311, "critical"),
        ("b", 1000, "degraded"), ("b", 1121, "critical"), ("b", 1420, "healthy"), ("b", 1541, "critical"),
        ("c", 1400, "healthy"), ("c", 1521, "critical"), ("c", 5000, "healthy"),
    ]


def test_thinned_snapshots_give_the_same_changes(spark):
    """In whatever partitions they lie; a host with most rows sends few of them."""
    draw = np.random.default_rng(2)
    data = [("hot", int(t), "healthy") for t in range(0, 40_000, 10)]
    data += [("hot", int(t), SEVERITY[draw.integers(3)]) for t in draw.integers(0, 40_000, 20)]
    data += [(f"h{draw.integers(4)}", int(t), SEVERITY[draw.integers(3)]) for t in draw.integers(0, 9_000, 600)]
    data = [data[i] for i in draw.permutation(len(data))] + [("h1", None, "healthy")]
    every = spark.createDataFrame(data, "hostname string, at_s long, status string").withColumn("event_time", F.timestamp_seconds("at_s"))
    few = thinned(every.repartition(5), 120, 64 * 60).toPandas()
    every = worst_by_second(every.where("at_s is not null").toPandas())
    assert (few["hostname"] == "hot").sum() < 80
    assert few["event_time"].max() == every["event_time"].max()
    for host, mine in every.groupby("hostname"):
        part = few[few["hostname"] == host].sort_values("at_s")
        at_s, first, last = mine["at_s"].to_numpy(), part["first_s"].to_numpy(), part["at_s"].to_numpy()
        assert (first[0], last[-1]) == (at_s[0], at_s[-1])
        one, other = mine["status"].to_numpy(object), part["status"].to_numpy(object)
        assert (one[0], one[-1]) == (other[0], other[-1])
        assert changes(at_s, at_s, one, 120) == changes(first, last, other, 120)
    assert thinned(spark.createDataFrame([], "hostname string, at_s long, status string, event_time timestamp"), 120, 60).count() == 0


