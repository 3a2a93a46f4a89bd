"""Rows that are not repeats, against a loop that remembers the last one kept."""

import random

import pytest
from pyspark.sql import functions as F

from banfleet.operators.repeats import first_within, successors

SCHEMA = "hostname string, key string, seq long, received_at long"


def sample(seed, n=600):
    draw, data, at, seq = random.Random(seed), [], draw_start(seed), 0
    for _ in range(n):
        at += draw.choice([0, 0, 1, 2, 3, 40 if draw.random() < 0.02 else 1])
        seq += draw.randrange(1, 3)
        data.append(("h", "hot" if draw.random() < 0.34 else f"k{draw.randrange(40)}", seq, at))
    return data


def draw_start(seed):
    return -50 if seed == 2 else 1_000


def by_loop(data, seconds):
    kept, last = [], {}
    for _, key, seq, t in data:
        if key not in last or t >= last[key] + seconds:
            last[key] = t
            kept.append((key, seq, t))
    return sorted(kept)


@pytest.mark.parametrize("seed,seconds", [(1, 20), (2, 7), (3, 5000)])
def test_first_within(spark, rows, seed, seconds):
    data = sample(seed)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = first_within(df, ["hostname", "key"], seconds=seconds)
    assert rows(got, "key", "seq", "received_at") == by_loop(data, seconds)


def test_successors(spark, rows):
    draw = random.Random(4)
    times = sorted({draw.randrange(400) for _ in range(60)} | {900})
    df = spark.createDataFrame([("a", t) for t in times], "key string, at long")
    want = [(t, min(x for x in times if x >= t + 30)) for t in times if t + 30 <= 900]
    assert rows(successors(df, ["key"], "at", 30), "at", "_next") == want


def test_no_rows_and_plan(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert first_within(empty, ["key"]).count() == 0
    moments = spark.range(1000).select((F.col("id") % 7).alias("key"), F.col("id").alias("at"))
    text = successors(moments, ["key"], "at", 30)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "Python" not in text and "NestedLoop" not in text
