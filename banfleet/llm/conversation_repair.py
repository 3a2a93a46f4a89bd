"""Cheapest repair of a conversation's structure, by shortest paths in a lattice.

A lattice node is a place between two rows and a state of the grammar ``(s?(ua)+)?`` of role
initials; arcs are edits with small integer costs. An auction finds the shortest path: a path grows
from its start along the arc that keeps its end's price, and where no arc does, the price rises to
the least that one asks for and the path gives up its end. When the path arrives, the arcs whose cost
is the difference of their ends' prices (tight ones) hold every shortest path, and a walk along them,
least letter first, gives the least edit string.

A long conversation is cut into blocks. A block's costs from each state to each state are found
apart, chained backward in one light pass, then each block is solved with the true cost of what
follows it, and one pass forward picks the state that each block is entered in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banfleet.llm.workers import written
from banfleet.operators.running import running, running_count

#: Rows of a block, and of a stretch that one task numbers (2 to this power).
BLOCK, _ROWS = 128, 14
#: White space of texts, and what may end one.
BLANKS, ENDS = " \t\n\x0b\f\r", (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
# States: nothing yet, after s, after u, after a. Initials: s, u, a, any other.
_START, _S, _U, _A = range(4)
_NEXT = {(_START, 0): _S, (_START, 1): _U, (_S, 1): _U, (_U, 2): _A, (_A, 1): _U}
_WANTED = {_START: "u", _S: "u", _U: "a", _A: "u"}
_LEGAL = ("su", "ua", "au")
_FINAL = (0, None, None, 0)
# Whatever follows, one state costs at most 7 more than another: an end in the wrong state may
# stand in for the right one at a higher cost, and never wins.
_STAND_IN = 16


class Lattice:
    """Arcs of a block: for each node (letter, what it does, head, cost), in order of the letters.

    ``rows`` has a letter for each row, see :func:`row_letter`. ``ends`` are the costs after the last row in each
    state, None where none leads on. In the ``last`` block rows may be inserted after the last one.
    """

    def __init__(self, rows: str, ends, last: bool):
        n = len(rows)
        self.end = 4 * (n + 1)
        self.arcs: list[list[tuple[str, str, int, int]]] = []
        for i in range(n + 1):
            for state in range(4):
                arcs, wanted = [], _WANTED[state]
                grown = _NEXT[state, 1 if wanted == "u" else 2]
                insert = ("I", wanted, 4 * i + grown, INSERT)
                if i == n:
                    if last:
                        arcs.append(insert)
                    if ends[state] is not None:
                        arcs.append(("", "", self.end, ends[state]))
                else:
                    initial, kind = divmod(ord(rows[i]) - 65, 3)
                    arcs += [("D", "D", 4 * (i + 1) + state, DELETE), insert]
                    if kind < 2:
                        if (state, initial) in _NEXT:
                            arcs.append(("K", "K", 4 * (i + 1) + _NEXT[state, initial], KEEP + kind * TRUNCATED))
                        arcs.append(("R", wanted.upper(), 4 * (i + 1) + grown, REROLE + kind * TRUNCATED))
                self.arcs.append(arcs)
        self.arcs.append([])
        self.price = [0] * len(self.arcs)

    def auction(self, start: int) -> int:
        """Prices until the path from ``start`` reaches the end; the cost of a shortest one.

        Prices start at zero and only rise, and stay valid for other starts.
        """
        path, price, arcs, end = [start], self.price, self.arcs, self.end
        while (at := path[-1]) != end:
            least, head = min((cost + price[head], head) for _, _, head, cost in arcs[at])
            if price[at] < least:
                price[at] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
        return price[start]

    def trace(self, start: int) -> tuple[str, int]:
        """The least walk of tight arcs from ``start`` to the end, and the state it ends in.

        What each edit does is a letter: u, a insert a row; K, D keep and delete the next one, U, A
        rerole it. Nodes that no tight walk to the end leaves are tried once.
        """
        dead, walk, price = set(), [], self.price
        at, left = start, iter(self.arcs[start])
        while True:
            for _, does, head, cost in left:
                if price[at] == cost + price[head] and head not in dead:
                    if head == self.end:
                        return "".join(w[2] for w in walk) + does, at % 4
                    walk.append((at, left, does))
                    at, left = head, iter(self.arcs[head])
                    break
            else:
                dead.add(at)
                at, left, _ = walk.pop()


def row_letter(initial: Column, kind: Column) -> Column:
    """One letter for a role's initial and a row's kind: 0 as it should be, 1 truncated, 2 to be deleted."""
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(F.lit(65) + 3 * number + kind)


@lru_cache(1 << 14)
def _costs(rows: str, last: bool) -> list[int]:
    """Of the last block the cost from each state; of another from each state to each, the start's first."""
    if last:
        lattice = Lattice(rows, _FINAL, True)
        return [lattice.auction(s) for s in range(4)]
    to = []
    for t in range(4):
        lattice = Lattice(rows, [0 if t == s else _STAND_IN for s in range(4)], False)
        to.append([lattice.auction(s) for s in range(4)])
    return [to[t][s] for s in range(4) for t in range(4)]


@lru_cache(1 << 14)
def _solved(rows: str, ends: tuple | None, first: bool) -> tuple[list[str], list[int], int]:
    """Edits and end state from each state (of a conversation's first block the first state), and the first one's cost."""
    lattice = Lattice(rows, ends or _FINAL, ends is None)
    texts, states, cost = [], [], 0
    for s in range(1 if first else 4):
        spent = lattice.auction(s)
        cost = cost if s else spent
        text, state = lattice.trace(s)
        texts.append(text)
        states.append(state)
    return texts, states, cost


def _with_costs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.assign(costs=[_costs(rows, last) for rows, last in zip(f["rows"], f["last"], strict=True)])


def _chained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a conversation come last block first; each gets what follows it costs."""
    now: list[int] = []
    for f in frames:
        out = []
        for last, costs in zip(f["last"], f["costs"], strict=True):
            out.append(None if last else now)
            costs = [int(x) for x in costs]
            now = costs if last else [min(costs[4 * s + t] + now[t] for t in range(4)) for s in range(4)]
        yield f.assign(ends=out).drop(columns="costs")


def _with_edits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        ends = [None if x is None else tuple(int(v) for v in x) for x in f["ends"]]
        found = [_solved(r, e, b == 0) for r, e, b in zip(f["rows"], ends, f["block"], strict=True)]
        own = {"edits": [x[0] for x in found], "states": [x[1] for x in found], "cost": [x[2] if b == 0 else 0 for x, b in zip(found, f["block"], strict=True)]}
        yield f[["conv", "block", "rows", "last"]].assign(**own)


def _entered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a conversation come first block first; each block's edits from the state it is entered in."""
    state, before = _START, ""
    for f in frames:
        out = []
        for conv, block, rows, last, edits, states, cost in f.itertuples(index=False, name=None):
            if block == 0:
                state, before = _START, ""
            text, state = edits[state], int(states[state])
            initials = before + "".join("sua?"[(ord(x) - 65) // 3] for x in rows)
            illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
            before = initials[-1]
            parts, at = [], 0
            for i, x in enumerate(text, 1):
                if x.isupper():
                    parts.append(text[at:i])
                    at = i
            parts.append(text[at:])
            out.append((conv, block, last, parts, text.translate(_LETTERS), cost, illegal))
        yield pd.DataFrame(out, columns=["conv", "block", "last", "parts", "audit", "cost", "illegal"])


_LETTERS = str.maketrans("uaKDUA", "IIKDRR")


def with_faults(conversations: DataFrame) -> DataFrame:
    """Rows in order with their first fault: ``blank``, ``duplicate``, ``truncated`` or null.

    Columns: conv (conv_id as text, empty if null), pos from 1, turn, role, text, fault. Rows are in
    the order of turn, nulls first, then role and text; null roles and texts are one space. Blank
    is a text of ASCII white space alone; duplicate one whose role and text an earlier row of the
    conversation has; truncated one whose last other character is none of ``.!?``.
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
    )
    stretch = F.coalesce(F.shiftright("turn", _ROWS), F.lit(-(1 << 62)))
    placed = running(rows, ["conv"], ["turn", "role", "text"], {"pos": running_count()}, chunk=stretch)
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    placed = written(placed.withColumn("digest", F.sha2(content, 256)), "turns")
    firsts = placed.groupBy("conv", "digest").agg(F.min("pos").alias("first"))
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(body == "", "blank")
        .when(F.col("pos") > F.col("first"), "duplicate")
        .when(~F.right(body, F.lit(1)).isin(*ENDS), "truncated")
    )
    return placed.join(firsts, ["conv", "digest"]).select("conv", "pos", "turn", "role", "text", fault.alias("fault"))


def _block() -> Column:
    return F.floor((F.col("pos") - 1) / BLOCK).cast("long").alias("block")


def edits(rows: DataFrame) -> DataFrame:
    """Cheapest edits of each block of rows as :func:`with_faults` gives them; of equal ones the least.

    Columns: conv, block, last, parts (what happens before and to each row, see
    :meth:`Lattice.trace`, and after the last), audit (initials of the edits), cost (of the whole conversation, in its
    first block), illegal (neighbours that may not stand together, those before the block's first
    row included).
    """
    kind = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    letters = rows.select("conv", _block(), "pos", row_letter(F.substring("role", 1, 1), kind).alias("letter"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"])
    blocks = letters.groupBy("conv", "block").agg(F.array_join(ordered, "").alias("rows"))
    lasts = letters.groupBy("conv").agg(F.max("block").alias("_last"))
    blocks = blocks.join(lasts, "conv").select("conv", "block", "rows", (F.col("block") == F.col("_last")).alias("last"))
    head = "conv string, block long, rows string, last boolean"
    costs = blocks.mapInPandas(_with_costs, f"{head}, costs array<int>")
    backward = costs.repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    ends = backward.mapInPandas(_chained, f"{head}, ends array<int>").repartition("conv", "block")
    solved = ends.mapInPandas(_with_edits, f"{head}, edits array<string>, states array<int>, cost long")
    forward = solved.repartition("conv").sortWithinPartitions("conv", "block")
    return forward.mapInPandas(_entered, "conv string, block long, last boolean, parts array<string>, audit string, cost long, illegal long")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows after the edits: conv, pos, seq, role, text; in the order of pos and seq in a conversation.

    An inserted row has an empty text and stands before the row at its pos, or after the last one.
    """
    name = lambda x: F.when(F.lower(x) == "u", "user").otherwise("assistant")
    inserted = lambda part: F.transform(F.filter(F.split(part, ""), lambda x: x.isin("u", "a")), lambda x: F.struct(name(x).alias("role"), F.lit("").alias("text")))
    own = F.right("part", F.lit(1))
    role = F.when(own == "K", F.col("role")).otherwise(name(own))
    kept = F.when(own == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(role.alias("role"), "text")))
    joined = rows.withColumn("block", _block()).join(found.select("conv", "block", "parts"), ["conv", "block"])
    at = (F.col("pos") - F.col("block") * BLOCK).cast("int")
    each = joined.withColumn("part", F.element_at("parts", at)).select("conv", "pos", F.concat(inserted(F.col("part")), kept).alias("_rows"))
    n = F.col("block") * BLOCK + F.size("parts")
    tail = found.where("last").select("conv", n.alias("pos"), inserted(F.element_at("parts", -1)).alias("_rows"))
    every = each.unionByName(tail).select("conv", "pos", F.posexplode("_rows").alias("seq", "_row"))
    return every.select("conv", "pos", "seq", "_row.role", "_row.text")


def _line_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, digest = None, None
    for batch in batches:
        out = []
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            line = f"{role}:{text}".encode()
            if conv == at:
                digest.update(b"\n" + line)
                continue
            if at is not None:
                out.append((at, digest.hexdigest()))
            at, digest = conv, hashlib.sha256(line)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], names=["conv", "repaired_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (at, digest.hexdigest())], names=["conv", "repaired_sha256"])


def report(conversations: DataFrame) -> DataFrame:
    """One row per conversation: faults, the cheapest repair and a digest of the repaired rows.

    Columns: conv_id; gaps (turns missing between the least and the greatest, nulls aside; null beyond a long); blank,
    duplicate, truncated, illegal (counts); cost and audit of the cheapest edits that give role initials
    ``(s?(ua)+)?``, of equal ones the least string; repaired_sha256 (``role:text``, joined by newlines).
    Edits: K keeps a row (0), R gives it role user or assistant (2), D deletes it (3, a must for blank and
    duplicate ones), I inserts a row without text (2); a truncated row that stays costs 1 more. An
    empty role has no initial, and like other initials than s, u and a can't stay. Rows with a null conv_id are
    one conversation. Other columns aren't read, and an empty table gives no rows.
    """
    rows = written(with_faults(conversations), "faults")
    found = written(edits(rows), "edits")
    turns = F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = F.when(F.count("turn") > 0, turns.try_cast("long")).otherwise(F.lit(0).cast("long"))
    faults = rows.groupBy("conv").agg(
        gaps.alias("gaps"),
        *[F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")],
    )
    audit = F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"])
    edited = found.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(audit, "").alias("audit"))
    lines = repaired(rows, found).repartition("conv").sortWithinPartitions("conv", "pos", "seq").select("conv", "role", "text")
    digests = lines.mapInArrow(_line_digests, "conv string, repaired_sha256 string")
    every = faults.join(edited, "conv").join(digests, "conv", "left")
    return every.select(
        F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id"), "gaps", "blank", "duplicate", "truncated",
        "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(_NOTHING)).alias("repaired_sha256"),
    )


_NOTHING = hashlib.sha256(b"").hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as a careless collection leaves them, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes all ``.!?`` from it, 3 repeats it, 4 makes its role
    user. Nulls, those of conv_id and turn in the hashed text too, are one space.
    """
    space = F.lit(" ")
    told = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(told) % 20).alias("_how")
    ).where("_how <> 0")
    how, text = F.col("_how"), F.col("text")
    copies = F.explode(F.when(how == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select(
        "conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(how == 1, "").when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), copies.alias("_copy"),
    ).drop("_copy")


def damaged_report(conversations: DataFrame) -> DataFrame:
    """:func:`report` on :func:`damaged` rows, for every conversation there was.

    One that has lost all rows has zeros, an empty audit and the digest of no text.
    """
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("i")
    found = report(damaged(conversations)).alias("r")
    every = ids.join(found, F.col("i.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(f"r.{c}", zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    audit, digest = F.coalesce("r.audit", F.lit("")), F.coalesce("r.repaired_sha256", F.lit(_NOTHING))
    return every.select("i.conv_id", *counts, audit.alias("audit"), digest.alias("repaired_sha256"))
