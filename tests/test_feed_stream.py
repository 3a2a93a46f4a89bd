"""The page reader: any order of landing, any cut into micro-batches, any stop gives one result."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from banfleet.operators import feed as f
from banfleet.plans.streams import _finish
from banfleet.sources import pages as p
from banfleet.streaming import feed as sf
from banfleet.streaming import versions as sv
from banfleet.streaming.merge import applied_state

ITEMS = "array<struct<ip: string, op: string, source: string, hostname: string, at_s: bigint, enforced: boolean>>"


def some_pages(seed, n):
    """Pages as an agent gets them, with errors, empty pages and unknown operations."""
    draw = random.Random(seed)
    out, g = [], 0
    for i in range(1, n + 1):
        g += draw.randrange(3)
        items = [
            {"ip": draw.choice([f"ip{draw.randrange(15)}", None, ""]), "op": draw.choice(["add", "add", "remove", "noop"]),
             "source": draw.choice(["tenant", "global", None]), "hostname": f"h{draw.randrange(2)}", "at_s": 1000 * i + k, "enforced": draw.random() < 0.8}
            for k in range(draw.randrange(6))
        ]
        out.append({
            "page_no": i, "status_code": 500 if draw.random() < 0.1 else 200, "cursor": draw.choice([None, draw.randrange(60)]),
            "next_cursor": i if draw.random() < 0.7 else None, "global_cursor": draw.choice([None, g, max(0, g - 2)]), "items": items,
            "stats": draw.choice([None, {"tenant_active": i, "global_active": None}]),
        })
    return out


def land(folder, files):
    """One file per list of pages, oldest first."""
    os.makedirs(folder, exist_ok=True)
    for pages in files:
        n = len(os.listdir(folder))
        with open(f"{folder}/f{n:03}.json", "w") as out:
            out.writelines(json.dumps(x) + "\n" for x in pages)
        os.utime(f"{folder}/f{n:03}.json", (1_700_000_000 + n, 1_700_000_000 + n))


def shuffled(pages, size, seed):
    mixed = random.Random(seed).sample(pages, len(pages))
    return [mixed[i : i + size] for i in range(0, len(mixed), size)]


def read(spark, folder, a_trigger, **options):
    stream = p.stream_delta_pages(spark, f"{folder}/landed", a_trigger, p.LOGGED_PAGE)
    options.setdefault("cap", 4)
    _finish(sf.read_feed(stream, f"{folder}/out", f"{folder}/point", **options))


def want(spark, pages, cap=4):
    table = spark.createDataFrame([json.dumps(x) for x in pages], "string").select(F.from_json("value", p.LOGGED_PAGE).alias("x")).select("x.*")
    headers = p.page_headers(table)
    ops = f.valid_ops(f.of_consumed_pages(p.page_items(table), headers)).where("enforced")
    return f.pull_cycles(headers, cap=cap), f.cursor_progress(headers), f.apply_ops(ops)


def check(spark, rows, folder, pages):
    cycles, progress, state = want(spark, pages)
    log = sf.page_log(spark, f"{folder}/out")
    assert rows(log, *cycles.columns) == rows(cycles)
    cursors = ["page_no", "cursor_before", "cursor_after", "global_before", "global_after"]
    assert rows(log, *cursors) == rows(progress, *cursors)
    assert rows(applied_state(spark, f"{folder}/out")) == rows(state)


@pytest.mark.parametrize("a_trigger", [1, 3])
def test_order_and_cut_do_not_matter(spark, rows, folder, a_trigger):
    pages = some_pages(a_trigger, 30)
    land(f"{folder}/landed", shuffled(pages, 8, a_trigger))
    read(spark, folder, a_trigger, compact_every=2)
    check(spark, rows, folder, pages)
    reader = sf.feed_readers(spark, f"{folder}/out").first()
    assert reader["next_page"] == 31 and reader["cycle_no"] >= 7
    assert rows(f.latest_stats(sf.page_log(spark, f"{folder}/out"))) == rows(
        f.latest_stats(spark.createDataFrame([
            (x["page_no"], x["status_code"], x["stats"] is not None, *((x["stats"] or {}).get(k) for k in ("tenant_active", "global_active")))
            for x in pages
        ], "page_no long, status_code int, has_stats boolean, tenant_active long, global_active long"))
    )


def test_pages_beyond_a_gap_wait(spark, rows, folder):
    pages = some_pages(5, 12)
    late = pages.pop(3)
    land(f"{folder}/landed", [pages[:5], [{"page_no": None, "items": []}, pages[0]], pages[5:]])
    read(spark, folder, 1)
    assert sf.feed_readers(spark, f"{folder}/out").first()["next_page"] == 4
    schema = spark.createDataFrame([], p.LOGGED_PAGE).schema
    assert [r[0] for r in rows(sf.waiting_pages(spark, f"{folder}/out", schema), "page_no")] == list(range(5, 13))
    check(spark, rows, folder, pages[:3])
    land(f"{folder}/landed", [[late], [late]])
    read(spark, folder, 1)
    assert sf.waiting_pages(spark, f"{folder}/out", schema).count() == 0
    check(spark, rows, folder, pages[:3] + [late] + pages[3:])


def test_each_feed_has_its_own_reader(spark, rows, folder):
    both = {"a": some_pages(1, 9), "b": some_pages(2, 14)}
    tagged = [x | {"feed": k} for k, pages in both.items() for x in pages]
    land(f"{folder}/landed", shuffled(tagged, 5, 3))
    stream = p.stream_delta_pages(spark, f"{folder}/landed", 2, f"feed string, {p.LOGGED_PAGE}")
    _finish(sf.read_feed(stream, f"{folder}/out", f"{folder}/point", feed_keys=["feed"], cap=4))
    log = sf.page_log(spark, f"{folder}/out")
    for k, pages in both.items():
        cycles, _, _ = want(spark, pages)
        assert rows(log.where(F.col("feed") == k), *cycles.columns) == rows(cycles)
    assert rows(sf.feed_readers(spark, f"{folder}/out"), "feed", "next_page") == [("a", 10), ("b", 15)]


class Killed(Exception):
    pass


@pytest.mark.parametrize("where", ["before the pointer", "before the commit"])
def test_killed_half_way(spark, rows, folder, monkeypatch, where):
    """Readers see whole versions only, and the restart leaves the same state."""
    pages = some_pages(9, 16)
    land(f"{folder}/landed", [pages[i : i + 4] for i in range(0, 16, 4)])
    publish = sv.Versions.publish

    def killed(self, version):
        if version.number == 2 and where == "before the commit":
            publish(self, version)
        if version.number == 2:
            raise Killed
        publish(self, version)

    monkeypatch.setattr(sv.Versions, "publish", killed)
    with pytest.raises(Exception):
        read(spark, folder, 1)
    monkeypatch.undo()
    whole = 8 if where == "before the pointer" else 12
    check(spark, rows, folder, pages[:whole])
    read(spark, folder, 1)
    check(spark, rows, folder, pages)


def test_old_folders_and_removals_go(spark, rows, folder):
    """What is kept does not grow with the number of batches."""
    pages = [
        {"page_no": i, "status_code": 200, "cursor": i, "next_cursor": i, "global_cursor": None, "stats": None,
         "items": [{"ip": f"ip{i}", "op": "add", "hostname": "h", "at_s": i, "enforced": True}]
         + [{"ip": f"ip{i - 1}", "op": "remove", "hostname": "h", "at_s": i, "enforced": True}]}
        for i in range(1, 8)
    ]
    land(f"{folder}/landed", [[x] for x in pages])
    read(spark, folder, 1, compact_every=2)
    versions = sv.Versions(spark, f"{folder}/out")
    assert versions.numbers() == [5, 6]
    left = {t: sorted(os.listdir(f"{folder}/out/{t}")) for t in ("arrived", "reader", "base", "changes")}
    assert left["arrived"] == left["reader"] == ["batch_id=5", "batch_id=6"]
    assert left["base"] == ["batch_id=5"] and left["changes"] == ["batch_id=6"]
    # a base holds no removals; the version before can still be read
    assert spark.read.parquet(f"{folder}/out/base/batch_id=5").where("op = 'remove'").count() == 0
    assert rows(applied_state(spark, f"{folder}/out"), "ip") == [("ip7",)]
    assert rows(applied_state(spark, f"{folder}/out", version=5), "ip") == [("ip6",)]


def test_nothing_read_yet(spark, rows, folder):
    assert rows(applied_state(spark, f"{folder}/out")) == [] == rows(sf.feed_readers(spark, f"{folder}/out"))
    with pytest.raises(ValueError):
        sf.page_log(spark, f"{folder}/out")
