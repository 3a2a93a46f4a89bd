"""Parsing of ban lines, against Python's own regex and calendar."""

import re
from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from banfleet.functions import banlog

HEAD = "2025-11-02 07:41:09,880 fail2ban.actions [771]: NOTICE  [ftp-in] "
PATTERN = re.compile(banlog.BAN_LINE, re.ASCII)


def parsed(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, line string")
    got = banlog.parse_bans(df).select("seq", "jail", "ip", F.col("local_ts").cast("string"))
    return {r[0]: tuple(r[1:]) for r in got.collect()}


def expected(line):
    m = PATTERN.match(line)
    if not m:
        return None
    try:
        datetime.strptime(m[1], "%Y-%m-%d %H:%M:%S")
    except ValueError:
        return None
    return m[2], m[3], m[1]


def test_good_lines(spark):
    ips = ["192.0.2.77", "198.51.100.9", "2001:db8:a::f00", "64:ff9b::c000:201", "::", "abcd::", "::9",
           "a:b:c:d:e:f:0:1", "1::2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::1:2:3:4:5:6:7", "009.08.7.006",
           "1:2:3:4:5:6::7:8:9:a:b:c", "250.199.249.99"]
    got = parsed(spark, [HEAD + "Ban " + ip for ip in ips])
    assert [got[i] for i in range(len(ips))] == [
        ("ftp-in", ip, "2025-11-02 07:41:09") for ip in ips
    ]


def test_other_forms(spark):
    lines = [
        "2025-11-02 22:10:01 fail2ban.filter [9]: DEBUG [imap_tls] Ban 203.0.113.5",
        "2025-11-02 22:10:01,7\tfail2ban.q\t[9]:\tX\t[a_B-9]\tBan\t203.0.113.5  ",
    ]
    assert parsed(spark, lines) == {
        0: ("imap_tls", "203.0.113.5", "2025-11-02 22:10:01"),
        1: ("a_B-9", "203.0.113.5", "2025-11-02 22:10:01"),
    }


def test_rejected_lines(spark):
    lines = [
        "",
        "nothing of interest",
        "2025-11-02 22:10:01,004 fail2ban.database [9]: INFO  Connected",
        HEAD + "Unban 192.0.2.77",
        HEAD + "Restore Ban 192.0.2.77",
        HEAD + "Found 192.0.2.77",
        HEAD + "Ban 192.0.2.256",
        HEAD + "Ban 1::2:3:4:5:6:7:8",
        HEAD + "Ban ::5.5.5.5",
        HEAD + "Ban 192.0.2.77 twice",
        HEAD.replace("ftp-in", "ftp.in") + "Ban 192.0.2.77",
        HEAD.replace("11-02", "11-31") + "Ban 192.0.2.77",
        HEAD.replace("07:41", "25:41") + "Ban 192.0.2.77",
        HEAD.replace(":09", ":61") + "Ban 192.0.2.77",
        HEAD.replace("2025", "0000") + "Ban 192.0.2.77",
        "> " + HEAD + "Ban 192.0.2.77",
        "a\nb\nBan",
    ]
    assert parsed(spark, lines) == {}
    df = spark.createDataFrame([(x,) for x in [*lines, HEAD + "Ban 192.0.2.77"]], "line string")
    kept = {r[0] for r in banlog.rejected_lines(df).collect()}
    assert kept == set(lines)


_TOKEN = st.sampled_from(
    ["Ban", "Unban", " ", "  ", "\t", "192.0.2.7", "::", "ab:", ":cd", "12345:", "c0de::5", "[sshd]",
     "[a.b]", "NOTICE", "fail2ban.actions", "fail2ban.", "[12]:", "2024-02-29 23:59:59", "300.1.1.1",
     "2023-02-29 01:00:00", ",123", "x", "0:" * 7 + "0"]
)
_GOOD = st.builds(
    lambda ts, ip: f"{ts},1 fail2ban.actions [1]: NOTICE [sshd] Ban {ip}",
    st.sampled_from(["2024-02-29 23:59:59", "2023-02-29 00:00:00", "2024-12-31 07:08:09"]),
    st.lists(st.sampled_from(["0", "9a", "f", ":", "::", ".", "255", "256", "1"]), max_size=12).map(
        "".join
    ),
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(lines=st.lists(st.one_of(_GOOD, st.lists(_TOKEN, max_size=12).map("".join)),
                      min_size=150, max_size=200))
def test_same_as_python(spark, lines):
    got = parsed(spark, lines)
    assert [got.get(i) for i in range(len(lines))] == [expected(x) for x in lines]


def test_zones(spark):
    cases = [
        ("2024-07-01 12:00:00", "Europe/Madrid", "2024-07-01 10:00:00"),
        ("2024-03-31 02:30:00", "Europe/Madrid", "2024-03-31 01:30:00"),  # skipped hour
        ("2024-10-27 02:30:00", "Europe/Madrid", "2024-10-27 00:30:00"),  # repeated hour
        ("2024-01-01 20:00:00", "America/New_York", "2024-01-02 01:00:00"),
        ("2024-01-01 20:00:00", "UTC", "2024-01-01 20:00:00"),
    ]
    df = spark.createDataFrame(cases, "ts string, tz string, want string").withColumn(
        "got", banlog.local_to_utc(F.col("ts").cast("timestamp_ntz"), "tz").cast("string")
    )
    assert all(r.got == r.want for r in df.collect())


def test_iso_text_and_back(spark):
    df = spark.createDataFrame([("2025-11-02 18:30:00",)], "t string")
    ntz = F.col("t").cast("timestamp_ntz")
    row = df.select(banlog.report_row(F.lit("ftp-in"), F.lit("192.0.2.77"), ntz).alias("r")).first()
    assert row.r.asDict() == {"jail": "ftp-in", "ip": "192.0.2.77", "banned_at": "2025-11-02T18:30:00Z"}
    texts = ["2025-11-02T18:30:00Z", "2025-1-9T4:5:6Z", "2025-11-02 18:30:00", "2025-14-01T00:00:00Z",
             "12025-11-02T18:30:00Z", "x", "2025-11-02T18:30:00Zx", None]
    back = spark.createDataFrame([(t,) for t in texts], "t string").select(
        banlog.iso_time("t").cast("string")
    )
    assert [r[0] for r in back.collect()] == [
        "2025-11-02 18:30:00", "2025-01-09 04:05:06", *[None] * 6
    ]
