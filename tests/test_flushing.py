"""Flushes against a queue that is looked at every second."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from banfleet.operators.flushing import plan_flushes
from banfleet.plans.streams import _finish
from banfleet.streaming import flush as sf

QUEUE = "hostname string, id long, jail string, ip string, banned_at string, enqueued_at long"
RULES = {"seconds": 6, "early_at": 5, "batch": 8}


def rows_of(host, times, first=1):
    return [(host, first + i, "ssh", "1.1.1.1", "2026-05-13T10:00:00Z", t) for i, t in enumerate(times)]


def sample(seed, hosts=5, n=60):
    draw = random.Random(seed)
    out = []
    for h in range(hosts):
        t, times = draw.randrange(5), []
        for _ in range(n):
            t += draw.choice([0, 0, 0, 1, 1, 3, 9]) if h else draw.choice([0] * 30 + [1])
            times.append(t)
        out += rows_of(f"h{h}", times)
    return out


def by_the_second(rows, seconds, early_at, batch, until=None):
    """(hostname, id) -> (flush_no, flushed_at), as a loop with a clock would give them."""
    queues, out = defaultdict(lambda: defaultdict(list)), {}
    for host, i, *_, t in rows:
        queues[host][t].append(i)
    for host, arrivals in queues.items():
        end = max(arrivals) if until is None else until
        waiting, opened, no = [], None, 0
        for t in range(min(arrivals), end):
            if arrivals.get(t):
                opened = t if not waiting else opened
                waiting += sorted(arrivals[t])
            while len(waiting) >= early_at or (waiting and t == opened + seconds):
                out |= {(host, i): (no, t) for i in waiting[:batch]}
                waiting, no, opened = waiting[batch:], no + 1, t
    return out


def got(df):
    return {(r.hostname, r.id): (r.flush_no, r.flushed_at) for r in df.collect() if r.flush_no is not None}


@pytest.mark.parametrize("seed,width", [(1, 3), (2, 1 << 18)])
def test_like_the_clock(spark, seed, width):
    data = sample(seed)
    df = spark.createDataFrame(data, QUEUE).repartition(4)
    planned = plan_flushes(df, width=width, **RULES)
    assert got(planned) == by_the_second(data, **RULES) and planned.count() == len(data)


def test_defaults_and_clocks(spark):
    data = rows_of("early", [100] * 30 + [110] * 25) + rows_of("late", [100] * 5) + rows_of("big", [100] * 1203) + rows_of("unknown", [1])
    clocks = spark.createDataFrame([("early", 111, 0), ("late", 131, 7), ("big", 101, 0)], "hostname string, clock long, next_flush long")
    flushed = defaultdict(list)
    for (host, i), (no, at) in sorted(got(plan_flushes(spark.createDataFrame(data, QUEUE), clocks)).items()):
        flushed[host, no, at].append(i)
    assert {k: len(v) for k, v in flushed.items()} == {
        ("early", 0, 110): 55, ("late", 7, 130): 5, ("big", 0, 100): 500, ("big", 1, 100): 500, ("big", 2, 100): 203,
    }
    with pytest.raises(ValueError):
        plan_flushes(spark.createDataFrame(data, QUEUE), early_at=9, batch=8)
    empty = spark.createDataFrame([], QUEUE)
    assert plan_flushes(empty).count() == 0


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, QUEUE).coalesce(1).write.parquet(f"{folder}/in/{name}")


def run(spark, folder, **rules):
    stream = spark.readStream.schema(QUEUE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/p*")
    _finish(sf.flush_stream(stream, f"{folder}/out", f"{folder}/c", **rules))


def test_the_cut_does_not_matter(spark, folder):
    data = sample(7, hosts=3, n=40)
    in_time = sorted(data, key=lambda r: (r[5], r[0], r[1]))
    for i, k in enumerate(range(0, len(in_time), 30)):
        put(spark, folder, f"p{i}", in_time[k : k + 30])
        if i == 1:
            run(spark, folder, **RULES)  # and a restart
    run(spark, folder, **RULES)
    want = by_the_second(data, **RULES)
    assert got(sf.flushed_rows(spark, f"{folder}/out")) == want
    left = {(r.hostname, r.id) for r in sf.waiting_rows(spark, f"{folder}/out").collect()}
    assert left == {(r[0], r[1]) for r in data} - want.keys()
    reports = sf.flushed_reports(spark, f"{folder}/out").collect()
    assert sum(r.n_bans for r in reports) == len(want)
    assert {(r.hostname, r.flush_no, r.flushed_at) for r in reports} == {(h, *x) for (h, _), x in want.items()}
    assert all(r.payload.startswith('{"agent_version":') and f'"hostname":"{r.hostname}"' in r.payload for r in reports)


def test_ticks_and_late_rows(spark, folder):
    tick = (None, None, None, None, None, 200)
    put(spark, folder, "p0", rows_of("a", [100, 101]))
    put(spark, folder, "p1", [tick])  # silence: a window of 6 seconds ends at 106
    put(spark, folder, "p2", rows_of("a", [150], 3) + rows_of("b", [199, 300]))  # 150 comes when it is 200
    put(spark, folder, "p3", [(None, None, None, None, None, 400)])
    run(spark, folder, **RULES)
    assert got(sf.flushed_rows(spark, f"{folder}/out")) == {
        ("a", 1): (0, 106), ("a", 2): (0, 106), ("a", 3): (1, 206), ("b", 1): (0, 206), ("b", 2): (1, 306),
    }
    assert sf.flushed_rows(spark, f"{folder}/out").where(F.col("id") == 3).first().enqueued_at == 200
