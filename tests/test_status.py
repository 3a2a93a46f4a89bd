import json
from decimal import Decimal

from pyspark.sql import functions as F

from banfleet.functions import health as h
from banfleet.functions import jsontext as j
from banfleet.operators import inventory as inv
from banfleet.operators import status as st


def column(spark, data, schema, expr):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_health(spark):
    cases = [("healthy", 10, "healthy"), ("degraded", 120, "degraded"), ("healthy", 4000, "critical"),
             ("healthy", None, "critical"), ("sleepy", 1, "unknown"), (None, 1, "unknown"),
             ("critical", 1, "critical"), ("healthy", 121, "critical")]
    got = column(spark, cases, "raw string, age long, want string",
                 h.effective_status(F.col("raw"), F.col("age"), 120))
    assert got == [c[2] for c in cases]
    codes = column(spark, [("healthy",), ("degraded",), ("critical",), ("unknown",), (None,)],
                   "s string", h.exit_code(F.col("s")))
    assert codes == [0, 1, 2, 2, 2]


def test_raw_status(spark):
    cases = [({"reader": True, "puller": True}, False), ({"reader": True}, True),
             ({"reader": False}, False), ({"reader": False}, True)]
    got = column(spark, cases, "t map<string, boolean>, d boolean",
                 h.raw_status(F.col("t"), F.col("d")))
    assert got == ["healthy", "degraded", "critical", "critical"]


def test_ages(spark):
    assert column(spark, [(5.9,), (12.0,), (None,)], "t double",
                  h.age_seconds(10, F.col("t"))) == [4, 0, None]
    ages = [(None,), (0,), (59,), (60,), (3599,), (3600,), (12_000,), (100_000,)]
    assert column(spark, ages, "s long", h.age_text(F.col("s"))) == [
        "—", "0s", "59s", "1m", "59m", "1h 0m", "3h 20m", "27h 46m"
    ]
    assert column(spark, [(1714564800, "Europe/Madrid"), (0, "UTC"), (None, "UTC")],
                  "t long, z string", h.clock_text(F.col("t"), F.col("z"))) == ["14:00:00", "—", "—"]


def test_coverage(spark):
    cases = [(3990, 4000), (5, 4), (1, 0), (1, None), (0, 10)]
    pct = h.coverage_percent(F.col("a"), F.col("g"))
    assert column(spark, cases, "a long, g long", pct) == [99, 100, None, None, 0]
    bars = column(spark, cases, "a long, g long", h.coverage_bar(pct))
    assert bars == ["▓" * 19 + "░", "▓" * 20, None, None, "░" * 20]


def test_jail_count(spark):
    text = "Jail mail-out\n * Currently failed: 3\n * Currently banned: 1907\n * Total banned: 5511"
    cases = [(0, text), (0, "no such jail"), (0, "Currently banned: many"),
             (2, text), (0, "Currently banned 5"), (0, "a: Currently banned: 7\nCurrently banned: 8")]
    assert column(spark, cases, "rc int, out string", h.jail_count(F.col("rc"), F.col("out"))) == [
        1907, None, None, None, None, 7
    ]


def test_json(spark):
    good = json.dumps({"status": "healthy", "snapshot_at": 1990.5, "hb_ok": True,
                       "threads": {"reader": True}, "last_pull_at": None})
    df = spark.createDataFrame([(good,), ("[1, {",), (None,)], "v string").select(
        j.decode(F.col("v"), j.SNAPSHOT).alias("s")
    )
    first, second, third = (r.s for r in df.collect())
    assert first.status == "healthy" and first.snapshot_at == Decimal("1990.5")
    assert first.threads == {"reader": True} and first.last_pull_at is None
    assert second is None and third is None
    text = spark.range(1).select(j.encode(F.struct(F.lit(None).cast("int").alias("a")))).first()[0]
    assert text == '{"a":null}'


def test_latest_value_wins(spark, rows):
    log = spark.createDataFrame(
        [("h", "a", "1", 1, 1), ("h", "a", "2", 2, 1), ("h", "a", "3", 2, 2), ("h", "b", "x", 1, 9)],
        "hostname string, k string, v string, at_s long, seq long",
    )
    assert rows(st.latest_values(log), "k", "v") == [("a", "3"), ("b", "x")]


def applied(spark, data):
    return spark.createDataFrame(data, "hostname string, ip string, applied_at long, source string")


def test_recent(spark, rows):
    df = applied(spark, [("h", "a", 31, "tenant"), ("h", "b", 77, "global"), ("h", "c", 52, "tenant")])
    assert [r[0] for r in st.recent(df, 2).orderBy("rn").select("ip").collect()] == ["b", "c"]
    many = [("h", f"g{i:02}", 1000 + i, "global") for i in range(49)] + [
        ("h", "t1", 5000, "tenant"), ("h", "t0", 1, "tenant")
    ]
    # the filter comes after the newest 50, so the old tenant row is not found
    got = st.recent_filtered(applied(spark, many), "tenant", rows=10)
    assert rows(got, "ip", "rn") == [("t1", 1)]
    assert st.recent_filtered(applied(spark, many), "all", rows=10).count() == 10


def test_hosts_without_anything_stay(spark, rows):
    hosts = spark.createDataFrame([("h",), ("idle",)], "hostname string")
    counts = st.applied_counts(applied(spark, [("h", "a", 1, "tenant")]), hosts)
    assert rows(counts) == [("h", 1, 1, 0), ("idle", 0, 0, 0)]
    jails = spark.createDataFrame([("h", 4), ("full", 9)], "hostname string, jail_banned long")
    assert rows(st.jail_drift(counts, jails)) == [("full", 0, 9, -9), ("h", 1, 4, -3), ("idle", 0, None, None)]


def test_gather(spark, rows):
    snap = {"snapshot_at": 1990.0, "started_at": 1000.0, "hb_last_at": 1990.0, "hb_ok": True,
            "status": "healthy", "threads": {t: True for t in ("reader", "sender", "puller")},
            "last_pull_at": 1980.0, "last_flush_at": 1995.0}
    hosts = spark.createDataFrame([("h",), ("silent",)], "hostname string")
    log = spark.createDataFrame(
        [("h", "status_snapshot", json.dumps(snap)), ("h", "global_cursor", "8123"),
         ("h", "blocklist_cursor", "640"),
         ("h", "feed_stats", '{"tenant_active": 17, "global_active": 4211}')],
        "hostname string, k string, v string",
    ).withColumns({"at_s": F.lit(1), "seq": F.lit(1)})
    rows_applied = applied(spark, [("h", "1.1.1.1", 5, "tenant"), ("h", "2.2.2.2", 6, "global")])
    queue = spark.createDataFrame([("h", 3, 4)], "hostname string, pending long, oldest_seconds long")
    jails = spark.createDataFrame([("h", 4300)], "hostname string, jail_banned long")
    got = st.gather(hosts, st.latest_by_host(log), st.applied_counts(rows_applied), queue, jails,
                    st.recent(rows_applied), as_of=2000, backend_url="u", jail_name="j")
    by_host = {r.hostname: r for r in got.collect()}
    up, silent = by_host["h"], by_host["silent"]
    assert (up.status, up.uptime_seconds, up.hb_age_seconds) == ("healthy", 1000, 10)
    assert (up.applied_total, up.applied_tenant, up.applied_global) == (2, 1, 1)
    assert (up.global_cursor, up.tenant_cursor, up.feed_global_active) == (8123, 640, 4211)
    assert (up.jail_banned, up.outbox_pending, up.outbox_oldest_seconds) == (4300, 3, 4)
    assert up.threads["puller"] and [r.ip for r in up.recent] == ["2.2.2.2", "1.1.1.1"]
    assert (silent.status, silent.snapshot_age_seconds, silent.outbox_pending) == ("critical", None, 0)
    assert silent.threads == {} and silent.recent == [] and silent.hb_ok is False
    assert len(got.columns) == 26


def test_inventory(spark, rows):
    agents = spark.createDataFrame(
        [("h", 1, "ab_live_" + "a" * 16, "Fail2Ban v0.9.3"), ("h", 2, "ab_test_" + "a" * 15, "v0.10"),
         ("h", 3, "key_" + "a" * 20, "no version")],
        "hostname string, agent_id long, api_key string, version_text string",
    )
    assert rows(inv.agent_keys(agents), "agent_id", "key_valid", "key_masked") == [
        (1, True, "ab_live_aaaaaa...aaaa"), (2, False, "ab_test_aaaaaa...aaaa"),
        (3, False, "key_aaaaaaaaaa...aaaa"),
    ]
    assert rows(inv.agent_versions(agents), "agent_id", "version", "too_old") == [
        (1, "0.9.3", True), (2, "0.10", False), (3, "", False)
    ]


def test_settings(spark, rows):
    lines = [
        ("a", "conf", 1, "logtarget", "SYSLOG"), ("a", "local", 2, "logtarget", "/x.log"),
        ("a", "local", 3, "logtarget", " /y.log "), ("a", "conf", 4, "include_global", "off"),
        ("b", "conf", 1, "logtarget", "SYSTEMD-JOURNAL"), ("b", "conf", 2, "include_global", " "),
        ("c", "local", 1, "logtarget", ""), ("c", "conf", 1, "logtarget", "AUTO"),
        ("c", "conf", 2, "include_global", "\tYes\n"), ("d", "conf", 1, "include_global", "\n\t"),
    ]
    df = spark.createDataFrame(
        lines, "hostname string, file string, line_no long, key string, value string"
    )
    assert rows(inv.settings_effective(df)) == [
        ("a", "/y.log", True, "/y.log", False),
        ("b", "SYSTEMD-JOURNAL", False, None, True),
        ("c", "AUTO", True, "/var/log/fail2ban.log", True),
        ("d", None, True, "/var/log/fail2ban.log", True),
    ]


def test_checksums_of_files(spark, folder, rows):
    import hashlib

    contents = {"a.tar": b"one", "b.tar": b"two", "c.tar": b"three"}
    for name, content in contents.items():
        with open(f"{folder}/{name}", "wb") as out:
            out.write(content)
    good = hashlib.sha256(b"one").hexdigest()
    with open(f"{folder}/a.tar.sha256", "w") as out:
        out.write(f"  {good}  a.tar\nmore\n")
    with open(f"{folder}/b.tar.sha256", "w") as out:
        out.write(f"{good}  b.tar\n")
    got = inv.verify_files(spark, folder).withColumn("name", F.substring_index("path", "/", -1))
    assert rows(got, "name", "verified") == [("a.tar", True), ("b.tar", False), ("c.tar", None)]


def test_checksum_files_are_read_once(spark, folder, rows):
    """Right, wrong, missing and lonely checksum files; one scan."""
    import hashlib

    from banfleet.operators.inventory import verify_files

    def put(name, content):
        with open(f"{folder}/{name}", "wb") as out:
            out.write(content)

    good = hashlib.sha256(b"one").hexdigest()
    put("a.tar", b"one")
    put("a.tar.sha256", f" {good}  a.tar\n".encode())
    put("b.tar", b"two")
    put("b.tar.sha256", good.encode())
    put("c.tar", b"three")
    put("d.tar", b"four")
    put("d.tar.sha256", b"\n")
    put("e.tar.sha256", good.encode())
    found = verify_files(spark, folder)
    got = {r["path"][-5:]: (r["expected"], r["verified"]) for r in found.collect()}
    assert got == {"a.tar": (good, True), "b.tar": (good, False), "c.tar": (None, None), "d.tar": (None, None)}
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan binaryFile") <= 2  # initial and final plan
