"""Delivery outcomes, and the breaker against a machine that runs row by row."""

import random

import pytest
from pyspark.sql import functions as F

from banfleet.functions import report as r
from banfleet.operators import breaker as b
from banfleet.operators import delivery as d

SCHEMA = "hostname string, seq long, at_s long, status_code int, error string"


def test_dispositions(spark):
    cases = [(None, None, "retry"), (200, None, "ack"), (202, None, "ack"), (299, None, "ack"),
             (401, None, "block"), (403, "tenant_suspended", "block"),
             (403, "plan_quota_exceeded", "hold"), (403, "forbidden", "drop"), (403, None, "drop"),
             (404, None, "drop"), (422, None, "drop"), (429, None, "hold"), (500, None, "retry"),
             (503, None, "retry"), (302, None, "retry"), (100, None, "retry")]
    df = spark.createDataFrame(cases, "status int, error string, want string")
    got = df.withColumn("got", r.disposition(F.col("status"), F.col("error"))).collect()
    assert all(x.got == x.want for x in got)


def test_waits(spark):
    df = spark.createDataFrame(
        [(0,), (1,), (3,), (6,), (9,)], "n long"
    ).select(r.backoff(F.col("n")), r.backoff(F.col("n"), 2, 1000))
    assert [tuple(x) for x in df.collect()] == [(1, 2), (2, 4), (8, 16), (60, 128), (60, 128)]
    headers = spark.createDataFrame(
        [("30",), (" 7 ",), ("-5",), ("soon",), ("",), ("1.5",), (None,)], "v string"
    ).select(r.retry_after(F.col("v")))
    assert [x[0] for x in headers.collect()] == [30, 7, 0, 60, 60, 60, 60]
    assert r.quota_hold() == 300 and r.quota_hold(1000) == 900
    low_high = spark.range(200).select(r.jittered(F.lit(10), 1).alias("j")).agg(
        F.min("j"), F.max("j")
    ).first()
    assert 5 <= low_high[0] < 6 and 14 < low_high[1] <= 15


def test_latest_flags_and_blocked(spark, rows):
    data = [("h", 1, 10, 202, None), ("h", 2, 20, 503, None), ("h", 3, 30, None, None),
            ("h", 4, 40, 422, None), ("h", 5, 50, 401, None), ("h", 6, 60, 202, None),
            ("ok", 1, 10, 500, None), ("ok", 2, 15, 200, None),
            ("s", 1, 1, 403, "tenant_suspended"), ("s", 2, 2, 429, None)]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(d.latest(df)) == [
        ("h", 202, 60, None), ("ok", 200, 15, None), ("s", 429, None, None)
    ]
    assert rows(d.latest(df.where("seq < 6"))) [0] == ("h", 401, 10, "invalid_api_key")
    assert rows(d.latest(df.where("seq < 5")))[0] == ("h", 422, 10, "network")
    assert rows(d.flags(df)) == [("h", True, False), ("ok", False, False), ("s", False, True)]
    assert rows(d.after_block(df), "hostname", "seq") == [("h", 6), ("s", 2)]


def test_streaks(spark, rows):
    rnd = random.Random(4)
    data, want = [], []
    for host in ("hot", "a"):
        count = 0
        for seq in range(200 if host == "hot" else 20):
            status = rnd.choice([202, 503, 503, 503, 422, 401, None])
            data.append((host, seq, seq, status, None))
            count = 0 if status == 202 else count + (status in (503, None))
            want.append((host, seq, count))
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = d.failure_streaks(df, width=9)
    assert rows(got, "hostname", "seq", "failures") == sorted(want)


class Machine:
    """The breaker, one attempt at a time."""

    def __init__(self, rules):
        self.rules, self.state, self.failures = rules, "closed", 0
        self.cooldown, self.until = rules.cooldown, None

    def attempt(self, at, ok):
        if self.state == "open":
            if at < self.until:
                return self.row(False)
            self.state = "half_open"
        if ok is True:
            self.state, self.failures, self.cooldown = "closed", 0, self.rules.cooldown
        elif ok is False and self.state == "half_open":
            self.cooldown = min(self.cooldown * 2, self.rules.cap)
            self.state, self.until = "open", at + self.cooldown
        elif ok is False:
            self.failures += 1
            if self.failures >= self.rules.failures_to_open:
                self.state, self.until = "open", at + self.cooldown
        return self.row(True)

    def row(self, allowed):
        until = self.until if self.state == "open" else None
        return allowed, self.state, self.failures, self.cooldown, until


def history(seed, hosts=6, n=160):
    rnd = random.Random(seed)
    out = []
    for h in range(hosts):
        at, fail, none = 0, rnd.random(), rnd.choice([0, 0.3])
        step = rnd.choice([0, 1, 5, 30])
        for seq in sorted(rnd.sample(range(10 * n), n if h else 3 * n)):
            at += rnd.randrange(step + 1)
            ok = None if rnd.random() < none else rnd.random() >= fail
            out.append((f"h{h}", seq, at, ok))
    return out


RULES = [
    b.Rules(3, 4, 20), b.Rules(1, 4, 5), b.Rules(2, 0, 10), b.Rules(5, 60, 30), b.Rules(1, 50, 50)
]


@pytest.mark.parametrize("seed,width", [(0, 1), (1, 7), (2, 40), (3, 13), (4, 100_000)])
def test_replay_like_the_machine(spark, rows, seed, width):
    data, rules = history(seed), RULES[seed]
    machines = {}
    want = [
        (h, seq, *machines.setdefault(h, Machine(rules)).attempt(at, ok))
        for h, seq, at, ok in data
    ]
    df = spark.createDataFrame(data, "hostname string, seq long, at_s long, ok boolean")
    got = b.replay(df.repartition(4), rules, width=width, stretch=(4, 10, 1000, 3, 1000)[seed])
    columns = ["hostname", "seq", "allowed", "state", "failures", "cooldown", "open_until"]
    result = sorted((tuple(x) for x in got.select(*columns).collect()), key=lambda t: t[:2])
    wanted = sorted(want, key=lambda t: t[:2])
    # while closed the machine keeps the first cooldown, whatever it is
    assert result == wanted


def test_replay_continues_from_states(spark):
    data, rules = history(9), RULES[0]
    schema = "hostname string, seq long, at_s long, ok boolean"
    columns = ["hostname", "seq", "allowed", "state", "failures", "cooldown", "open_until"]

    def as_set(df):
        return {tuple(x) for x in df.select(*columns).collect()}

    whole = as_set(b.replay(spark.createDataFrame(data, schema), rules, width=50))
    old = spark.createDataFrame([x for x in data if x[1] < 777], schema)
    new = spark.createDataFrame([x for x in data if x[1] >= 777], schema)
    before = b.replay(old, rules, width=31)
    start = b.final_states(before, rules)
    for width in (31, 100_000):
        after = b.replay(new, rules, start=start, width=width, stretch=3)
        assert as_set(before) | as_set(after) == whole


def test_clock_that_steps_back_stands_still(spark):
    data = [("h", 1, 100, False), ("h", 2, 90, True), ("h", 3, 109, True), ("h", 4, 110, True)]
    df = spark.createDataFrame(data, "hostname string, seq long, at_s long, ok boolean")
    for width in (1, 2, 100):
        got = b.replay(df, b.Rules(1, 10, 10), width=width).orderBy("seq")
        assert [x.allowed for x in got.collect()] == [True, False, False, True]
