"""Chunked running totals and top-n, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from banfleet.operators.running import (
    chunked,
    key_total,
    running,
    running_count,
    running_max,
    running_since,
    running_sum,
    running_xor,
    top_n,
)


def sample(n=600, seed=3):
    """A third of all rows belongs to one host."""
    rnd = random.Random(seed)
    out = []
    for seq in rnd.sample(range(5000), n):
        host = "hot" if rnd.random() < 0.34 else f"h{rnd.randrange(6)}"
        out.append((host, seq, rnd.choice([None, *range(-5, 20)])))
    return out


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_like_a_loop(spark, rows, width):
    data = sample()
    df = spark.createDataFrame(data, "host string, seq long, x long").repartition(5)
    got = running(
        df,
        ["host"],
        "seq",
        {
            "n": running_count(),
            "s": running_sum(F.col("x")),
            "s0": running_sum(F.col("x"), before=True),
            "m": running_max(F.col("x")),
            "m0": running_max(F.col("x"), before=True),
            "e": running_xor(F.col("x")),
        },
        width=width,
    )
    want, state = [], {}
    for host, seq, x in sorted(data, key=lambda r: (r[0], r[1])):
        n, s, m, e = state.get(host, (0, 0, None, 0))
        new_m = m if x is None else x if m is None else max(m, x)
        want.append((host, seq, x, n + 1, s + (x or 0), s, new_m, m, e ^ (x or 0)))
        state[host] = (n + 1, s + (x or 0), new_m, e ^ (x or 0))
    assert rows(got) == sorted(want, key=lambda t: (t[0], t[1]))


def test_without_keys_and_shared_chunks(spark, rows):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "seq long, x long")
    once = running(chunked(df, "seq", width=8), [], "seq", {"s": running_sum(F.col("x"))})
    twice = running(once, [], "seq", {"m": running_max(F.col("s"), before=True)})
    got = rows(twice, "seq", "s", "m")
    total, before = 0, None
    for i, (seq, s, m) in enumerate(sorted(got)):
        total += i % 3
        assert (seq, s, m) == (i, total, before)
        before = total


def test_top_n(spark, rows):
    data = sample(400, seed=5)
    df = spark.createDataFrame(data, "host string, seq long, x long").repartition(7)
    got = top_n(df, ["host"], [F.col("seq").desc()], 5, lanes=3)
    want = []
    for host in {d[0] for d in data}:
        best = sorted((d for d in data if d[0] == host), key=lambda d: -d[1])[:5]
        want += [(*d, i + 1) for i, d in enumerate(best)]
    assert sorted(rows(got, "host", "seq", "rn")) == sorted((w[0], w[1], w[3]) for w in want)


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_totals_that_start_again(spark, rows, width):
    data = sample(500, seed=9)
    df = spark.createDataFrame(data, "host string, seq long, x long").repartition(5)
    value, reset = F.coalesce("x", F.lit(0)), F.col("x") % 5 == 0
    totals = {"since": running_since(value, reset), "all": key_total(F.col("x")), "n": running_count()}
    got = running(df, ["host"], "seq", totals, width=width)
    want, state, n = [], {}, {}
    for host, seq, x in sorted(data, key=lambda r: (r[0], r[1])):
        state[host] = 0 if x is not None and x % 5 == 0 else state.get(host, 0) + (x or 0)
        n[host] = n.get(host, 0) + 1
        total = sum(y or 0 for h, _, y in data if h == host)
        want.append((host, seq, x, state[host], total, n[host]))
    assert rows(got) == sorted(want, key=lambda t: (t[0], t[1]))


def test_one_scan_and_few_exchanges(spark, folder):
    """The plan of a resettable total, before anything is run."""
    spark.range(5000).select((F.col("id") % 3).cast("string").alias("host"), F.col("id").alias("seq")).write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    since = running(df, ["host"], "seq", {"s": running_since(F.lit(1).cast("bigint"), F.col("seq") % 9 == 0)})
    text = since._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text
    since.collect()
    final = since._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 1 and final.count(" Exchange ") <= 4
