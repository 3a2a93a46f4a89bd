import datetime
import os
import time

from pyspark.sql import functions as F

from banfleet.sources import segments, sinks

LINE = "2025-11-02 07:41:09,880 fail2ban.actions [771]: NOTICE  [ftp-in] Ban 192.0.2."


def put(folder, host, name, data: bytes):
    path = f"{folder}/hostname={host}"
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "wb") as out:
        out.write(data)
    return f"{path}/{name}"


def test_lossy_text_and_line_breaks(spark, folder, rows):
    put(folder, "a", "1.log", "one\ntwo\r\nthree\rfour\x0bfive\x0csix\x1cseven eight\u0085nine".encode())
    put(folder, "a", "2.log", b"bad \xff byte\n\nlast")
    lines = segments.read_lines(spark, folder)
    ordered = [r.line for r in lines.orderBy("file", "block", "line_no", "piece").collect()]
    assert ordered == [
        "one", "two", "three", "four", "five", "six", "seven", "eight", "nine",
        "bad � byte", "last",
    ]


def test_numbers_follow_files_and_lines(spark, folder, rows):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        text = "".join(f"{LINE}{i}\nnoise\n" for i in range(40))
        put(folder, "a", "2.log", text.encode())
        put(folder, "a", "1.log", (LINE + "200\n").encode())
        put(folder, "b", "1.log", (LINE + "201\n").encode())
        bans = segments.bans_of_segments(segments.read_lines(spark, folder))
        assert bans.rdd.getNumPartitions() >= 1
        got = rows(bans, "hostname", "id", "ip")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [
        ("a", 1, "192.0.2.200"), *[("a", i + 2, f"192.0.2.{i}") for i in range(40)],
        ("b", 1, "192.0.2.201"),
    ]


def test_cold_start_skips_old_segments(spark, folder, rows):
    old = put(folder, "a", "1.log", b"old")
    put(folder, "a", "2.log", b"new")
    os.utime(old, (1_000_000, 1_000_000))
    after = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(2_000_000))
    assert rows(segments.read_lines(spark, folder, modified_after=after), "line") == [("new",)]


def test_written_segments_keep_order(spark, folder, rows):
    data = [(f"h{i % 2}", i, f"{LINE}{i}") for i in range(200)]
    df = spark.createDataFrame(data, "hostname string, seq long, line string").repartition(5)
    segments.write_segments(df, f"{folder}/log", width=30)
    bans = segments.bans_of_segments(segments.read_lines(spark, f"{folder}/log"))
    assert rows(bans, "hostname", "id", "ip") == sorted(
        (f"h{i % 2}", i // 2 + 1, f"192.0.2.{i}") for i in range(200)
    )


def test_sinks(spark, folder):
    df = spark.createDataFrame([("h", "k", "{}")], "hostname string, idempotency_key string, payload string")
    sinks.write_reports(df, f"{folder}/reports")
    back = spark.read.json(f"{folder}/reports").first()
    assert (back.hostname, back.idempotency_key, back.payload) == ("h", "k", "{}")
    sinks.write_bodies(df.select(F.col("payload").alias("body")), f"{folder}/bodies")
    assert spark.read.text(f"{folder}/bodies").first().value == "{}"

    def send(partition):
        for row in partition:
            with open(f"{folder}/sent-{row.idempotency_key}", "w") as out:
                out.write(row.payload)

    def broken(partition):
        raise OSError("no route")

    sinks.deliver(df, send)
    assert os.path.exists(f"{folder}/sent-k")
    sinks.deliver_quietly(df, broken)


def test_cold_start_is_kept(spark, folder, rows):
    """What lay there before the first start is never read; what comes while the stream is down is."""
    from banfleet.plans.streams import _finish
    from banfleet.streaming.ingest import ingest, read_queue

    line = "2025-11-02 07:41:09,880 fail2ban.actions [771]: NOTICE  [ftp-in] Ban 10.0.0."
    began = datetime.datetime(2026, 1, 1, 12, tzinfo=datetime.UTC)

    def put(name, address, at):
        os.makedirs(f"{folder}/log/hostname=a", exist_ok=True)
        with open(f"{folder}/log/hostname=a/{name}", "w") as out:
            out.write(line + address + "\n")
        os.utime(f"{folder}/log/hostname=a/{name}", (at, at))

    def run(now):
        start = segments.cold_start(spark, f"{folder}/point", now)
        lines = segments.stream_segments(spark, f"{folder}/log", start=start)
        zones = spark.createDataFrame([], "hostname string, tz string")
        _finish(ingest(lines, f"{folder}/queue", f"{folder}/point", zones))

    put("s1", "1", began.timestamp() - 1)
    put("s2", "2", began.timestamp())
    run(began)
    put("s1.rotated", "3", began.timestamp() + 5)
    run(began + datetime.timedelta(hours=1))  # a restart starts where the first one did
    assert rows(read_queue(spark, f"{folder}/queue"), "id", "ip") == [(1, "10.0.0.2"), (2, "10.0.0.3")]
