"""Repeated lines against a plain count of all keys."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from banfleet.llm import line_dedup
from banfleet.llm.textbytes import chunks

ENDS = " \t\n\x0b\x0c\r"


def key_of(line: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(ENDS))


def plainly(docs, min_docs, least=1, keep_first=False):
    found, first = defaultdict(set), {}
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        for n, line in enumerate((text or "").split("\n")):
            key = key_of(line)
            if len(key) >= least:
                found[key].add(i)
                first.setdefault(key, (i, n))
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        gone = {n for n, x in enumerate(lines) if len(found.get(key_of(x), ())) >= min_docs}
        if keep_first:
            gone = {n for n in gone if first[key_of(lines[n])] != (i, n)}
        out.append((i, len(lines), len(gone), "\n".join(x for n, x in enumerate(lines) if n not in gone).encode()))
    return sorted(out, key=str)


def corpus(n=120):
    draw = random.Random(13)
    common = ["Share this", "  share THIS\r", "©2024 Ähnlich", "©2024 ähnlich", "x", " x", "SHARE\tthis", ""]
    docs = []
    for i in range(n):
        lines = [draw.choice(common) if draw.random() < 0.6 else f"own {draw.randrange(300)} line" for _ in range(draw.randrange(12))]
        docs.append((i, "\n".join(lines)))
    return docs + [(n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "share this\n" * 400), (n + 4, "y" * 3_000_000 + "\nx")]


@pytest.mark.parametrize("options", [{"min_docs": 10}, {"min_docs": 2, "keep_first": True}, {"min_docs": 3, "least_chars": 7}])
def test_lines(spark, options):
    docs = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = line_dedup.drop_repeated_lines(table, **options).collect()
    want = plainly(docs, options["min_docs"], options.get("least_chars", 1), options.get("keep_first", False))
    assert sorted(((r[0], r[1], r[2], bytes(r[3])) for r in got), key=str) == want


def test_a_full_filter_changes_nothing(spark):
    docs = corpus(60)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = line_dedup.drop_repeated_lines(table, min_docs=4, most_bits=64).collect()
    assert sorted(((r[0], r[1], r[2], bytes(r[3])) for r in got), key=str) == plainly(docs, 4)


def test_filters_hold_all_repeats_and_little_else(spark):
    docs = [(i, f"line {i}\nline {i // 2 + 100_000}") for i in range(20_000)]
    filters = line_dedup.suspects(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), 1)

    def held(lines):
        texts = next(chunks(pa.array(lines)))
        _, first, stop, _ = line_dedup.lines_of(texts)
        return filters.holds(line_dedup.key_hashes(texts, first, stop))

    assert held([f"line {i + 100_000}" for i in range(10_000)]).all()
    assert np.mean(held([f"line {i}" for i in range(20_000)])) < 0.03


def test_edges(spark):
    schema = "doc_id string, text string, line string, key string, id int, version int, lines int, n_lines int"
    rows = [("a", "t\nu", *[None] * 2, *[1] * 4), ("a", "t\nv", *[None] * 2, *[1] * 4), (None, "t", *[None] * 2, *[1] * 4), (None, None, *[None] * 2, *[1] * 4)]
    table = spark.createDataFrame(rows, schema)
    got = sorted((tuple(r) for r in line_dedup.drop_repeated_lines(table, min_docs=2).collect()), key=str)
    # two rows of one id are one document, null is another
    assert got == sorted([("a", 2, 1, b"u"), ("a", 2, 1, b"v"), (None, 1, 1, b""), (None, 1, 0, b"")], key=str)
    assert line_dedup.drop_repeated_lines(table.limit(0)).count() == 0
    assert line_dedup.drop_repeated_lines(table, min_docs=3).agg({"n_dropped": "sum"}).first()[0] == 0
