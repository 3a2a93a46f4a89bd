"""Repairs against a search of all edit strings, cheapest first."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from banfleet.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\f\r"
NOTHING = hashlib.sha256(b"").hexdigest()


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        body = text.rstrip(BLANKS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Uniform-cost search over (row, initials so far by their last one), strings as tie-break."""
    found = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)
        if (i, last) in done:
            continue
        done.add((i, last))
        want = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[want]
        heapq.heappush(heap, (cost + 2, audit + "I", i, want, (*lines, (name, ""))))
        if i < len(rows):
            (role, text), fault = rows[i], found[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, want, (*lines, (name, text))))
                if role[:1] == want or (role[:1] == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, (role, text))))


def report_of(turns):
    rows = [(r, t) for _, r, t in sorted(turns, key=lambda x: ((x[0] is not None, x[0] or 0), x[1], x[2]))]
    found = faults(rows)
    cost, audit, text = cheapest(rows)
    known = {t for t, _, _ in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *[found.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def by_conv(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        out[c].append((turn, " " if role is None else role, " " if text is None else text))
    return out


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
TEXTS = ["a.", "b!", "c?", "d", "e", " \x0b", "", None, "f.\n", "g "]


def conversations(n, longest, seed):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(draw.randint(1, longest)):
            turn = draw.choice([t, t, t, t + 1, None])
            rows.append((c, turn, draw.choice(ROLES), draw.choice(TEXTS) if draw.random() < 0.6 else f"own {draw.random()}."))
    return rows


def collected(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("block", [1, 3, 128])
def test_reports(spark, block, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "_ROWS", 2)
    rows = conversations(120, 9, block) + conversations(1, 60, 4)
    rows += [(None, 3, "user", "x."), (None, 1, "system", "y.")]
    got = collected(repair.report(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    assert got == {c: report_of(turns) for c, turns in by_conv(rows).items()}


def test_auction_and_blocks_of_long_rows():
    draw = random.Random(8)
    for _ in range(60):
        rows = "".join(draw.choice("ABCDEFGHIJKL" if draw.random() < 0.4 else "DG") for _ in range(draw.randint(1, 90)))
        whole = repair.Lattice(rows, repair._FINAL, True)
        cost = whole.auction(0)
        least = [0, 2 + 2, 2, 0]  # from the end backward: S needs two more rows, U one
        for x in reversed(rows):
            initial, kind = divmod(ord(x) - 65, 3)
            after, least = least, []
            for s in range(4):
                grown = repair._NEXT[s, 1 if repair._WANTED[s] == "u" else 2]
                options = [3 + after[s]]
                if kind < 2:
                    options.append(2 + kind + after[grown])
                    if (s, initial) in repair._NEXT:
                        options.append(kind + after[repair._NEXT[s, initial]])
                least.append(min(options))
            for _ in range(2):
                least = [min(least[s], 2 + least[repair._NEXT[s, 1 if repair._WANTED[s] == "u" else 2]]) for s in range(4)]
        assert cost == least[0]
        spent = {"u": 2, "a": 2, "K": 0, "D": 3, "U": 2, "A": 2}
        text, state = whole.trace(0)
        assert sum(map(str.isupper, text)) == len(rows) and state in (0, 3)
        extra = sum((ord(x) - 65) % 3 == 1 for x, e in zip(rows, re.findall("[A-Z]", text), strict=True) if e != "D")
        assert sum(spent[e] for e in text) + extra == cost


def test_damage(spark):
    rows = conversations(150, 6, 9)
    got = collected(repair.damaged_report(spark.createDataFrame(rows, SCHEMA)))
    left = defaultdict(list)
    for c, turn, role, text in rows:
        how = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        left[c] += [(turn, "user" if how == 4 else role, text)] * ((how != 0) + (how == 3))
    assert got == {c: report_of(t) if t else (0,) * 6 + ("", NOTHING) for c, t in left.items()}


def test_edges(spark):
    schema = f"{SCHEMA}, conv string, pos int, fault string, block int, parts string, cost int"
    more = ["x", 1, "x", 1, "x", 1]
    big = 2**63 - 1
    rows = [(1, -big, "user", "a" * 1_000_000 + ".", *more), (1, big, "assistant", "b.", *more), (2, None, None, None, *more)]
    table = spark.createDataFrame(rows[2:], schema)
    assert collected(repair.report(table)) == {2: (0, 1, 0, 0, 0, 3, "D", NOTHING)}
    assert repair.report(table.limit(0)).count() == 0 == repair.damaged_report(table.limit(0)).count()
    got = collected(repair.report(spark.createDataFrame([(1, 0, *rows[0][2:]), (1, 2, *rows[1][2:])], schema)))
    assert got[1][:7] == (1, 0, 0, 0, 0, 0, "KK")
    got = collected(repair.report(spark.createDataFrame(rows[:2], schema)))
    assert got[1][:7] == (None, 0, 0, 0, 0, 0, "KK")  # more turns are missing than a long counts
