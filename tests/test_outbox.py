import hashlib
import json

from pyspark.sql import functions as F

from banfleet.functions.report import idempotency_key
from banfleet.operators import outbox as q

SCHEMA = "hostname string, id long, jail string, ip string, banned_at string, enqueued_at long"


def queue(spark, n=5, host="h", start=1):
    data = [(host, i, "sshd", f"10.0.0.{i % 250}", "2026-05-13T10:00:00Z", 1000 + i)
            for i in range(start, start + n)]
    return spark.createDataFrame(data, SCHEMA)


def key_of(ids):
    d = hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return f"{d[:8]}-{d[8:12]}-{d[12:16]}-{d[16:20]}-{d[20:32]}"


def test_head_is_first_in_first_out(spark, rows):
    assert rows(q.head(queue(spark), 3), "id") == [(1,), (2,), (3,)]


def test_ids_start_at_one_per_host_and_repeats_are_kept(spark, rows):
    df = spark.createDataFrame(
        [("a", 9, "x"), ("a", 4, "x"), ("b", 7, "x"), ("a", 30, "x")],
        "hostname string, seq long, ip string",
    )
    assert rows(q.number_rows(df, width=5), "hostname", "seq", "id") == [
        ("a", 4, 1), ("a", 9, 2), ("a", 30, 3), ("b", 7, 1)
    ]


def test_batches_and_reports(spark):
    batched = q.cut_batches(queue(spark, 1203), width=100)
    got = {r.batch_no: r for r in q.assemble_reports(batched, agent_version="9").collect()}
    assert [got[i].n_bans for i in range(3)] == [500, 500, 203]
    assert got[1].first_id == 501 and got[1].last_id == 1000
    assert got[1].idempotency_key == key_of(range(501, 1001))
    body = json.loads(got[2].payload)
    assert body["agent_version"] == "9" and body["hostname"] == "h"
    assert body["bans"][0] == {
        "jail": "sshd", "ip": f"10.0.0.{1001 % 250}", "banned_at": "2026-05-13T10:00:00Z"
    }


def test_key_sorts_ids_as_numbers_and_is_stable(spark):
    df = spark.createDataFrame([([10, 9, 100],), ([100, 10, 9],)], "ids array<long>")
    keys = {r[0] for r in df.select(idempotency_key(F.col("ids"))).collect()}
    assert keys == {key_of([9, 10, 100])}


def test_pending_rows_move_up_after_delete(spark, rows):
    left = q.delete_rows(queue(spark, 6), queue(spark, 2))
    assert rows(left, "id") == [(3,), (4,), (5,), (6,)]
    assert rows(q.cut_batches(left, size=2, width=3), "id", "batch_no") == [
        (3, 0), (4, 0), (5, 1), (6, 1)
    ]
    nothing = queue(spark, 1).where("false")
    assert q.delete_rows(queue(spark, 3), nothing).count() == 3


def test_depth_and_age(spark, rows):
    hosts = spark.createDataFrame([("h",), ("idle",)], "hostname string")
    assert rows(q.depth_and_age(queue(spark), hosts, 1011)) == [("h", 5, 10), ("idle", 0, 0)]
    assert rows(q.depth_and_age(queue(spark), hosts, 0))[0] == ("h", 5, 0)


def test_expiry_is_strict(spark, rows):
    assert rows(q.drop_expired(queue(spark), as_of=1103, ttl=100), "id") == [(3,), (4,), (5,)]


def test_quota_drops_oldest_in_steps(spark, rows):
    data = queue(spark, 35)
    size = data.select(F.max(q.row_bytes())).first()[0]
    for quota in (0, size * 3, size * 10, size * 12, size * 36):
        kept = {r[0] for r in rows(q.drop_over_quota(data, quota, step=10, width=7), "id")}
        left = {r.id: r.b for r in data.select("id", q.row_bytes().alias("b")).collect()}
        while left and sum(left.values()) > quota:
            for i in sorted(left)[:10]:
                del left[i]
        assert kept == set(left)


def test_unreadable_times_are_set_aside(spark, rows):
    bad = queue(spark, 2).withColumn("banned_at", F.when(F.col("id") == 2, "bad").otherwise(F.col("banned_at")))
    assert rows(q.decodable(bad), "id") == [(1,)]
    assert rows(q.quarantine(bad), "id") == [(2,)]
