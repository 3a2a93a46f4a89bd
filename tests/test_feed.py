"""Feed operators, against a sequential model of the pull loop."""

import json
import random

import pytest

from banfleet.operators import feed as f
from banfleet.sources import pages as p

PAGES = "page_no long, status_code int, cursor long, next_cursor long, global_cursor long"
ITEMS = (
    "hostname string, ip string, page_no long, pos long, op string, source string, at_s long, "
    "enforced boolean"
)


def pull(pages, cursor=0, global_cursor=0, cap=50):
    """One page after the other, as an agent would: cycle, consumed and cursors per page."""
    out, i, cycle = [], 0, 0
    while i < len(pages):
        cycle += 1
        for n in range(cap):
            if i == len(pages):
                break
            page_no, status, c, following, g = pages[i]
            i += 1
            if status != 200:
                out.append((page_no, cycle, False, cursor, global_cursor, "error"))
                break
            advanced = g is not None and g > global_cursor
            cursor = max(cursor, c if c is not None else cursor)
            global_cursor = max(global_cursor, g if g is not None else global_cursor)
            ends = following is None and not advanced
            why = "drained" if ends else "cap" if n == cap - 1 else None
            out.append((page_no, cycle, True, cursor, global_cursor, why))
            if ends:
                break
    return out


def feed_of(seed, n):
    rnd = random.Random(seed)
    rise, err, more = rnd.random(), rnd.choice([0, 0, 0.05, 0.3]), rnd.random()
    g, pages = 0, []
    for i in range(1, n + 1):
        g += rnd.randrange(3) if rnd.random() < rise else 0
        pages.append((
            i,
            500 if rnd.random() < err else 200,
            rnd.choice([None, rnd.randrange(40)]),
            i if rnd.random() < more else None,
            rnd.choice([None, g, g, g, max(0, g - 2)]),
        ))
    return pages


@pytest.mark.parametrize("width,cap", [(7, 3), (64, 5)])
def test_cycles_like_the_loop(spark, rows, width, cap):
    feeds = {s: feed_of(s, 90) for s in range(25)}
    data = [(f"f{s}", *page) for s, pages in feeds.items() for page in pages]
    df = spark.createDataFrame(data, f"feed string, {PAGES}").repartition(3)
    got = f.pull_cycles(df, ["feed"], stored_global=2, cap=cap, width=width)
    want = [
        (f"f{s}", *row)
        for s, pages in feeds.items()
        for row in pull(pages, global_cursor=2, cap=cap)
    ]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want, key=lambda t: (t[0], t[1]))


def test_drain_cases(spark, rows):
    """Global pages that advance, one that does not; then a later cycle."""
    pages = [(1, 200, 0, None, 4), (2, 200, 0, None, 31), (3, 200, 0, None, 88),
             (4, 200, 0, None, 88), (5, 200, 7, None, 88)]
    got = f.pull_cycles(spark.createDataFrame(pages, PAGES))
    assert rows(got, "page_no", "cycle_no", "global_after", "end_reason") == [
        (1, 1, 4, None), (2, 1, 31, None), (3, 1, 88, None), (4, 1, 88, "drained"),
        (5, 2, 88, "drained"),
    ]
    assert f.pull_cycles(spark.createDataFrame([(1, 500, 9, 9, 9)], PAGES)).first().end_reason == "error"


def test_pages_from_json(spark, folder, rows):
    bodies = [
        {"page_no": 1, "status_code": 200, "cursor": 5, "global_cursor": 7,
         "items": [{"ip": "1.1.1.1", "op": "add"}, {"ip": "", "op": "add"}, {"op": "remove"},
                   {"ip": "2.2.2.2", "op": "add", "source": None},
                   {"ip": "3.3.3.3", "op": "zap", "source": "global"}],
         "stats": {"tenant_active": 17, "global_active": 4211}},
        {"page_no": 2, "status_code": 200, "cursor": 5, "next_cursor": None, "items": []},
    ]
    for i, body in enumerate(bodies):
        with open(f"{folder}/{i}.json", "w") as out:
            out.write(json.dumps(body))
    pages = p.read_delta_pages(spark, folder)
    items = p.page_items(pages)
    assert rows(items, "page_no", "pos") == [(1, i) for i in range(5)]
    assert rows(f.valid_ops(items), "ip", "op", "source") == [
        ("1.1.1.1", "add", "tenant"), ("2.2.2.2", "add", "tenant")
    ]
    headers = p.page_headers(pages)
    assert rows(headers, "page_no", "cursor", "has_stats", "global_active") == [
        (1, 5, True, 4211), (2, 5, False, None)
    ]
    assert rows(f.latest_stats(headers)) == [(1, 17, 4211)]
    # a page whose totals are there but empty counts as 0 and is the latest
    later = spark.createDataFrame([(3, '{"status_code": 200, "stats": {}}')], "page_no long, body string")
    later = p.page_headers(p.parse_pages(later, "body", p.DELTA_PAGE.removeprefix("page_no bigint, ")))
    assert rows(f.latest_stats(headers.unionByName(later))) == [(3, 0, 0)]
    texts = spark.createDataFrame([(1, "{broken")], "page_no long, body string")
    broken = p.parse_pages(texts, "body", "status_code int, cursor long")
    assert rows(broken) == [(1, None, None)]


def state_model(ops, start=()):
    state = dict(start)
    for host, ip, _, _, op, source, at_s, enforced in sorted(ops, key=lambda o: (o[2], o[3])):
        if not enforced:
            continue
        if op == "add":
            state[host, ip] = (at_s, source)
        else:
            state.pop((host, ip), None)
    return sorted((*k, *v) for k, v in state.items())


def test_merge_like_applying_in_order(spark, rows):
    rnd = random.Random(11)
    ops = [
        (f"h{rnd.randrange(2)}", "hot" if rnd.random() < 0.34 else f"ip{rnd.randrange(30)}",
         i // 20, i % 20, rnd.choice(["add", "add", "remove"]),
         rnd.choice(["tenant", "global", "other"]), 1000 + i, rnd.random() < 0.9)
        for i in range(400)
    ]
    start = {(f"h{h}", f"ip{i}"): (5, "tenant") for h in range(2) for i in range(0, 40, 3)}
    df = spark.createDataFrame(ops, ITEMS).repartition(4).where("enforced")
    current = spark.createDataFrame(
        [(*k, *v) for k, v in start.items()],
        "hostname string, ip string, applied_at long, source string",
    )
    assert rows(f.apply_ops(df)) == state_model(ops)
    assert rows(f.merge_ops(current, df)) == state_model(ops, start.items())


def applied(spark, data):
    return spark.createDataFrame(data, "hostname string, ip string, applied_at long, source string")


def test_full_sync_never_removes(spark, rows):
    current = applied(spark, [("h", "a", 1, "tenant"), ("h", "b", 1, "global")])
    items = spark.createDataFrame(
        [("h", "b", 1, 0, None), ("h", "c", 1, 1, "tenant"), ("h", "c", 2, 0, "global"),
         ("h", "", 2, 1, "tenant")],
        "hostname string, ip string, page_no long, pos long, source string",
    )
    snapshot = f.snapshot_rows(items, 99)
    assert rows(f.merge_snapshot(current, snapshot)) == [
        ("h", "a", 1, "tenant"), ("h", "b", 99, "tenant"), ("h", "c", 99, "global")
    ]
    assert rows(f.drift(current, snapshot)) == [("h", "a", "applied_only"), ("h", "c", "feed_only")]


def test_full_sync_pages(spark, rows):
    def pages(n, bad=(), last=None):
        data = [(i, 500 if i in bad else 200, None if i == last else i + 1) for i in range(1, n + 1)]
        return spark.createDataFrame(data, "page_no long, status_code int, next_page long")

    def applied_pages(df, **kw):
        return [r[0] for r in rows(f.full_sync_pages(df, **kw).where("applied"), "page_no")]

    assert applied_pages(pages(3, last=3)) == [1, 2, 3]
    assert applied_pages(pages(4, bad=(2,))) == [1]
    assert applied_pages(pages(6, last=4)) == [1, 2, 3, 4]
    assert len(applied_pages(pages(150))) == 150
    capped = f.full_sync_pages(pages(150, bad=(140,)), cap=90)
    assert len(rows(capped.where("applied"))) == 90 and len(rows(capped.where("over_cap"))) == 49
    # a page that isn't there ends it like one that failed
    assert applied_pages(pages(6).where("page_no <> 3")) == [1, 2]
    assert applied_pages(pages(6).where("page_no <> 1")) == []
    items = spark.createDataFrame([(i, f"ip{i}") for i in range(1, 6)], "page_no long, ip string")
    assert rows(f.of_applied_pages(items, pages(5, bad=(4,))), "page_no") == [(1,), (2,), (3,)]


def test_feed_off_leaves_tenant_rows(spark, rows):
    current = applied(
        spark, [("h", "a", 1, "global"), ("h", "b", 1, "global"), ("h", "c", 1, "tenant")]
    )
    done = spark.createDataFrame(
        [("h", "a", True), ("h", "b", False), ("h", "c", True)],
        "hostname string, ip string, enforced boolean",
    )
    assert rows(f.feed_off(current, done), "ip") == [("b",), ("c",)]


def test_active_and_sources(spark, rows):
    current = applied(spark, [("h", "a", 100, "global"), ("h", "b", 101, "tenant")])
    assert rows(f.active(current, as_of=110, ban_seconds=10), "ip") == [("b",)]


def test_full_sync_decision(spark):
    cases = [
        (0, None, None, "first_boot_no_applied_ips"),
        (0, 5, 5, "first_boot_no_applied_ips"),
        (3, None, 5, "first_pid_snapshot"),
        (3, 5, 6, "pid_changed_old_5_new_6"),
        (3, 5, 5, None),
        (3, 5, None, None),
        (3, None, None, None),
    ]
    df = spark.createDataFrame(
        cases, "applied_total long, stored_pid long, current_pid long, want string"
    ).withColumn("got", f.full_sync_decision())
    assert all(r.got == r.want for r in df.collect())
