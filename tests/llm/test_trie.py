"""The trie of conversation prefixes against one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from banfleet.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, heads=6, family=100):
    own = defaultdict(list)
    low = lambda x: (x is not None, x or 0)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((low(turn), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plainly(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(own) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        above = min(members[path[:-1]]) if path else None
        out.append((min(own), len(path), above, len(own), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def conversations(n, seed):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        i = draw.choice([c, c * 50, -c])
        for t in range(draw.randrange(1, 9)):
            rows.append((i, draw.choice([t, t, None]), draw.choice(["user", "assistant", None, ""]), draw.choice(["a", "b", "é" * 5, None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = conversations(60, seed) + [(700, t, "user", f"t{t}") for t in range(90)] + [(None, 0, "user", "a")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in prefix_trie.branched_trie(table).collect()), key=lambda r: r[:2])
    assert got == plainly(rebuilt(rows))


def test_hot_conversation_and_hot_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_ROWS", 2)
    monkeypatch.setattr(prefix_trie, "_IDS", 3)
    rows = [(0, t, "user", "x" * (t % 3)) for t in range(70)] + [(c, t, "user", "same") for c in range(1, 90) for t in range(3)]
    got = sorted((tuple(r) for r in prefix_trie.branched_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=lambda r: r[:2])
    assert got == plainly(rebuilt(rows))


def test_totals_of_any_forest(spark):
    draw = random.Random(5)
    above = {i: (draw.randrange(max(0, i - 3), i) if i % 40 else None) for i in range(200)}
    n = defaultdict(int)
    for i, p in above.items():
        n[p] += p is not None
    rows = [(i, 0, p, None if p is None else 0, n[i], i) for i, p in above.items()]
    table = spark.createDataFrame(rows, "conv_id long, depth long, parent_0 long, parent_1 long, n long, x long")
    want = defaultdict(int)
    for i in above:
        at = i
        while at is not None:
            want[at] += i
            at = above[at]
    got = prefix_trie.subtree_totals(table, ["x"]).collect()
    assert {r["conv_id"]: r["x"] for r in got} == want and len(got) == len(rows)


def test_edges(spark):
    schema = f"{SCHEMA}, depth string, pos string, digest int, p1 int, n int, parent_0 int"
    one = spark.createDataFrame([(105, None, None, None, *["x"] * 2, *[1] * 4)], schema)
    h = zlib.crc32(b"105") % 6
    assert h > 0  # its only turn goes, and conversation 100 isn't there: turnless
    ends = hashlib.sha256(b"105").hexdigest()
    assert [tuple(r) for r in prefix_trie.branched_trie(one).collect()] == [(105, 0, None, 1, 0, 1, 0, ends)]
    assert prefix_trie.branched_trie(one.limit(0)).count() == 0
