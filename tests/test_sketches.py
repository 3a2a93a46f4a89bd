"""Distinct sketches: within their error, and the same however they were put together."""

import random

from banfleet.operators import sketches as sk


def test_parts_and_whole_agree(spark, rows):
    draw = random.Random(3)
    data = [(f"h{draw.randrange(2)}", f"v{draw.randrange(30_000)}", draw.randrange(10 * sk.DAY)) for _ in range(60_000)]
    data += [("h0", None, 5), ("empty", None, 5)]
    df = spark.createDataFrame(data, "host string, v string, at_s long").repartition(6)
    days = sk.distinct_sketches(df, ["host"], "v")
    at_once = sk.distinct_sketches(df, ["host"], "v", window=1 << 40)
    assert days.where("host = 'h0'").count() == 10
    by_day = rows(sk.estimates(days, ["host"]))
    assert by_day == rows(sk.estimates(at_once, ["host"])) == rows(sk.estimates(sk.merged(days, ["host", "window_start"]), ["host"]))
    for host, n in by_day:
        true = len({v for h, v, _ in data if h == host and v is not None})
        assert abs(n - true) <= 3 * sk.standard_error() * true
    whole = sk.estimates(days).first()[0]
    assert abs(whole - len({v for _, v, _ in data if v})) <= 3 * sk.standard_error() * whole


def test_stored_and_carried_on(spark, folder):
    for day in range(3):
        df = spark.createDataFrame([("h", f"v{i}", day * sk.DAY) for i in range(day * 50, day * 50 + 100)], "host string, v string, at_s long")
        sk.distinct_sketches(df, ["host"], "v").write.mode("append").parquet(f"{folder}/days")
    assert sk.estimates(spark.read.parquet(f"{folder}/days"), ["host"]).first()["distinct"] == 200
