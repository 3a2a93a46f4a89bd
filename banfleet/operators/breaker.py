"""Circuit breaker replay, for hosts with any number of attempts.

The breaker is a sequential machine: every attempt depends on the state the one
before left. To replay a host in parallel its attempts are cut into chunks:

1. each chunk works out where it would end from every state it could start in;
2. these small tables are walked through per host, which gives each chunk its
   true starting state; of a host with very many chunks, stretches of tables are
   first composed into one table each, in parallel;
3. each chunk is replayed from there.

Hosts that fit into one chunk, nearly all of a fleet, need the third step only.

States are ``closed`` with a failure count, ``open`` until a time with a
cooldown level, and ``half_open`` with a cooldown level.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banfleet import constants as C
from banfleet.operators.running import CHUNK_COLUMN, chunked
from banfleet.session import written

CLOSED, OPEN, HALF_OPEN = 0, 1, 2
STATE_NAMES = ("closed", "open", "half_open")
BREAKER_CHUNK = 1 << 20
STRETCH = 1024
_LONG_AGO = -(1 << 62)


@dataclass(frozen=True)
class Rules:
    failures_to_open: int = C.BREAKER_FAILURES_TO_OPEN
    cooldown: int = C.BREAKER_COOLDOWN_SECONDS
    cap: int = C.BREAKER_COOLDOWN_CAP

    def cooldowns(self) -> list[int]:
        """Cooldown of level 0, 1, ...: doubled each time, up to the cap."""
        levels = [self.cooldown]
        while (longer := min(levels[-1] * 2, self.cap)) != levels[-1]:
            levels.append(longer)
        return levels


class Chunk:
    """Attempts of one chunk in order, indexed for jumps between state changes.

    ``outcome`` is 1 for success, 0 for failure, -1 where nothing is recorded;
    ``clock`` never falls.
    """

    def __init__(self, clock: np.ndarray, outcome: np.ndarray, rules: Rules):
        self.rules, self.levels = rules, np.array(rules.cooldowns(), dtype=np.int64)
        self.clock, self.outcome, self.n = clock, outcome, len(clock)
        index = np.arange(self.n)
        self.failures = np.flatnonzero(outcome == 0)
        successes = np.flatnonzero(outcome == 1)
        self.first_success = int(successes[0]) if len(successes) else self.n
        # failures since the last success of this chunk
        total = np.cumsum(outcome == 0)
        last = np.maximum.accumulate(np.where(outcome == 1, index, -1))
        self.streak = total - np.where(last >= 0, total[last], 0)
        # where a breaker opens that was closed by a success of this chunk
        self.opens = np.flatnonzero(
            (outcome == 0) & (last >= 0) & (self.streak == rules.failures_to_open)
        )
        # next recorded attempt at or after each position
        recorded = np.where(outcome >= 0, index, self.n)
        self.next_recorded = np.append(np.minimum.accumulate(recorded[::-1])[::-1], self.n)

    def first_opening(self, count: int) -> int | None:
        """Where a breaker opens that enters closed after ``count`` failures."""
        needed = self.rules.failures_to_open - count
        if len(self.failures) >= needed and self.failures[needed - 1] < self.first_success:
            return int(self.failures[needed - 1])
        return int(self.opens[0]) if len(self.opens) else None

    def trailing(self, count: int = 0) -> int:
        """Failures counted at the end, if the breaker stays closed from the start."""
        return int(self.streak[-1]) + (count if self.first_success == self.n else 0)

    # A probe is a recorded attempt of a half-open breaker. Probes and their
    # cooldown levels are nodes of a graph: each leads to the next probe, or out
    # of the chunk. All steps below work on arrays of nodes.

    def _probe(self, at: np.ndarray, level: np.ndarray):
        """Half open before ``at``: the node probed next, or -1 and the end state."""
        probe = self.next_recorded[at]
        inside = probe < self.n
        node = np.where(inside, probe * len(self.levels) + level, -1)
        return node, _ends_of(HALF_OPEN, level, np.zeros_like(level))

    def _wait(self, origin: np.ndarray, level: np.ndarray):
        """Opened by attempt ``origin``: the node probed after the cooldown, or the end."""
        until = self.clock[origin] + self.levels[level]
        at = np.maximum(origin + 1, np.searchsorted(self.clock, until, side="left"))
        node, ends = self._probe(at, level)
        waiting = at >= self.n
        ends[waiting] = _ends_of(OPEN, level[waiting], until[waiting])
        return node, ends

    def _follow(self, nodes: np.ndarray):
        """One probe on: a failure waits longer, a success stays closed until it opens."""
        probe, level = np.divmod(nodes, len(self.levels))
        success = self.outcome[probe] == 1
        i = np.searchsorted(self.opens, probe)
        opens_again = i < len(self.opens)
        opening = np.append(self.opens, 0)[i]
        origin = np.where(success, opening, probe)
        level = np.where(success, 0, np.minimum(level + 1, len(self.levels) - 1))
        node, ends = self._wait(origin, level)
        closed = success & ~opens_again
        node[closed] = -1
        ends[closed] = (CLOSED, self.trailing(), 0)
        return node, ends

    def _resolve(self, nodes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """End states of starts that lead to ``nodes`` (-1: ``ends`` is final already)."""
        size = self.n * len(self.levels)
        onward = np.full(size, -1, dtype=np.int64)
        known = np.zeros(size, dtype=bool)
        last = np.zeros((size, 3), dtype=np.int64)
        fresh = np.unique(nodes[nodes >= 0])
        reached = []
        while len(fresh):
            known[fresh] = True
            reached.append(fresh)
            onward[fresh], last[fresh] = self._follow(fresh)
            found = np.unique(onward[fresh])
            found = found[found >= 0]
            fresh = found[~known[found]]
        if not reached:
            return ends
        reached = np.concatenate(reached)
        # double the length of each jump until all lead to a last node
        jump = onward
        jump[reached] = np.where(onward[reached] < 0, reached, onward[reached])
        while True:
            further = jump[jump[reached]]
            if np.array_equal(further, jump[reached]):
                break
            jump[reached] = further
        leads = nodes >= 0
        ends[leads] = last[jump[nodes[leads]]]
        return ends

    def ends(self, clock_before: int) -> np.ndarray:
        """Rows ``kind, count, latest open_until`` and end state, for every possible start.

        An open breaker's wait ends at the first attempt at or after its time, so
        starts that end their wait at the same attempt share a row; and so do
        neighbours with the same end.
        """
        counts = range(self.rules.failures_to_open)
        openings = [self.first_opening(c) for c in counts]
        starts = [(CLOSED, c, 0) for c in counts]
        nodes = np.full(len(starts), -1, dtype=np.int64)
        ends = np.array([(CLOSED, self.trailing(c), 0) for c in counts], dtype=np.int64)
        opened = np.array([o is not None for o in openings])
        if opened.any():
            origin = np.array([o for o in openings if o is not None], dtype=np.int64)
            nodes[opened], ends[opened] = self._wait(origin, np.zeros_like(origin))
        starts = np.array(starts, dtype=np.int64)
        if clock_before != _LONG_AGO:  # else it is the first chunk of a key, which starts closed
            level = np.arange(len(self.levels))
            waits = self._wait_ends(clock_before + int(self.levels.max()))
            wait_level, wait_at = np.repeat(level, len(waits)), np.tile(waits, len(level))
            half_nodes, half_ends = self._probe(np.zeros_like(level), level)
            open_nodes, open_ends = self._probe(wait_at, wait_level)
            starts = np.concatenate(
                [
                    starts,
                    _ends_of(HALF_OPEN, level, np.zeros_like(level)),
                    _ends_of(OPEN, wait_level, self.clock[wait_at]),
                ]
            )
            nodes = np.concatenate([nodes, half_nodes, open_nodes])
            ends = np.concatenate([ends, half_ends, open_ends])
        table = np.hstack([starts, self._resolve(nodes, ends)])
        return _merged(table)

    def _wait_ends(self, reach: int) -> np.ndarray:
        """Attempts that can end a wait up to time ``reach``: the first of each second."""
        first = np.flatnonzero(np.diff(self.clock, prepend=self.clock[0] - 1) > 0)
        return first[: int(np.searchsorted(self.clock[first], reach, side="left")) + 1]

    def replay(self, kind: int, count: int, until: int) -> dict[str, np.ndarray]:
        """What the breaker does at each attempt, from a starting state."""
        clock, opens, recorded = self.clock.tolist(), self.opens.tolist(), self.next_recorded.tolist()
        outcome, levels, n = self.outcome.tolist(), self.levels.tolist(), self.n
        carried = count if kind == CLOSED else 0
        runs, at = [], 0  # (first row, state, level, open until, passes)
        while at < n:
            if kind == CLOSED:
                runs.append((at, CLOSED, 0, 0, True))
                i = bisect_left(opens, at)
                later = opens[i] if i < len(opens) else None
                opened = later if at else self.first_opening(carried)
                if opened is None:
                    break
                kind, count, until = OPEN, 0, clock[opened] + levels[0]
                runs.append((opened, OPEN, 0, until, True))
                at = opened + 1
            elif kind == OPEN:
                probe = max(at, bisect_left(clock, until))
                if probe > at:
                    runs.append((at, OPEN, count, until, False))
                at, kind = probe, HALF_OPEN
            else:
                probe = recorded[at]
                if probe > at:
                    runs.append((at, HALF_OPEN, count, 0, True))
                if probe < n and outcome[probe] == 1:
                    # the probe's row belongs to the closed stretch it starts
                    kind, count = CLOSED, 0
                    runs.append((probe, CLOSED, 0, 0, True))
                elif probe < n:
                    kind, count = OPEN, min(count + 1, len(levels) - 1)
                    until = clock[probe] + levels[count]
                    runs.append((probe, OPEN, count, until, True))
                at = probe + 1
        first, *columns = (np.array(c) for c in zip(*runs, strict=True))
        lengths = np.diff(np.append(first, n))
        kinds, level, untils, passes = (np.repeat(c, lengths) for c in columns)
        counted = self.streak.copy()
        counted[: self.first_success] += carried
        return {
            "kind": kinds,
            "level": level,
            "until": untils,
            "allowed": passes,
            "failures": np.where(kinds == CLOSED, counted, self.rules.failures_to_open),
        }


def _ends_of(kind: int, count: np.ndarray, until: np.ndarray) -> np.ndarray:
    return np.stack([np.full_like(count, kind), count, until], axis=-1)


_STATE = ["kind", "count", "until"]
_TABLE = [*_STATE, "end_kind", "end_count", "end_until"]


def _ints(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(table.column(name))


def _matrix(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([_ints(table, name) for name in names], axis=-1)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no group is cut; each starts with a lead row."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        leads = np.flatnonzero(_ints(batch, "_lead"))
        if len(leads):
            whole = [*pending, batch.slice(0, int(leads[-1]))]
            if sum(b.num_rows for b in whole):
                yield pa.Table.from_batches(whole)
            pending = [batch.slice(int(leads[-1]))]
        else:
            pending.append(batch)
    if pending:
        yield pa.Table.from_batches(pending)


def _groups(table: pa.Table) -> Iterator[tuple[int, int]]:
    """``(lead row, end)`` of each group."""
    leads = np.flatnonzero(_ints(table, "_lead")).tolist()
    return zip(leads, [*leads[1:], table.num_rows], strict=True)


def _chunks(table: pa.Table, rules: Rules) -> Iterator[tuple[int, Chunk]]:
    """``(lead row, chunk)`` of each group of attempts; the clock never runs backwards."""
    at, outcome = _ints(table, "_at"), _ints(table, "_outcome")
    before = _ints(table, "_clock_before")
    for lead, end in _groups(table):
        clock = np.maximum(np.maximum.accumulate(at[lead + 1 : end]), before[lead])
        yield lead, Chunk(clock, outcome[lead + 1 : end], rules)


def _owned(table: pa.Table, names: list[str], parts: list[tuple[int, np.ndarray]], columns):
    """Batches of ``parts``, each with the ``names`` of its lead row."""
    owner = np.concatenate([np.full(len(rows), lead) for lead, rows in parts])
    values = np.concatenate([rows for _, rows in parts]).T
    out = table.select(names).take(pa.array(owner))
    for name, column in zip(columns, values, strict=True):
        out = out.append_column(name, pa.array(column))
    return out.combine_chunks().to_batches()


def _end_tables(keys: list[str], rules: Rules):
    """Attempts, by chunk, to the end tables of the chunks."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            before = _ints(table, "_clock_before")
            parts = [(at, chunk.ends(int(before[at]))) for at, chunk in _chunks(table, rules)]
            yield from _owned(table, [*keys, CHUNK_COLUMN], parts, _TABLE)

    return tables


def _after(states: np.ndarray, table: np.ndarray) -> np.ndarray:
    """States after a chunk, from those before it and its end table."""
    out = states.copy()
    for kind, count in {tuple(x) for x in states[:, :2].tolist()}:
        mine = (states[:, 0] == kind) & (states[:, 1] == count)
        rows = table[(table[:, 0] == kind) & (table[:, 1] == count)]
        if kind != OPEN:
            out[mine] = rows[0, 3:]
            continue
        # a wait beyond the last attempt that could end it goes on unchanged
        i = np.searchsorted(rows[:, 2], states[mine, 2], side="left")
        ended = i < len(rows)
        out[np.flatnonzero(mine)[ended]] = rows[i[ended], 3:]
    return out


def _stretch_tables(keys: list[str]):
    """End tables, in order, to one end table per stretch of chunks."""
    names = [*keys, "_stretch"]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, so_far, group = None, None, None
        for frame in _whole_groups(batches):
            matrix = _matrix(frame, _TABLE)
            owners = list(zip(*(frame.column(n).to_pylist() for n in names), strict=True))
            for lead, end in _groups(frame):
                rows = matrix[lead + 1 : end]
                if owners[lead] != group:
                    if so_far is not None:
                        yield from _owned(owner, names, [(0, so_far)], _TABLE)
                    owner, so_far, group = frame.slice(lead, 1), rows, owners[lead]
                    continue
                so_far = _and_then(so_far, rows)
        if so_far is not None:
            yield from _owned(owner, names, [(0, so_far)], _TABLE)

    return compose


def _and_then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """End table of two neighbouring stretches.

    Starts are those of the first; and waits that outlast it and end in the second.
    """
    both = np.hstack([first[:, :3], _after(first[:, 3:], second)])
    waits = []
    for level in np.unique(first[first[:, 0] == OPEN, 1]):
        longest = first[(first[:, 0] == OPEN) & (first[:, 1] == level), 2].max()
        beyond = (second[:, 0] == OPEN) & (second[:, 1] == level) & (second[:, 2] > longest)
        waits.append(second[beyond])
    both = np.concatenate([both, *waits])
    both = both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))]
    return _merged(both)


def _merged(table: np.ndarray) -> np.ndarray:
    """Of neighbouring waits with the same level and end, the latest stands for all."""
    same = np.all(table[1:, [0, 1, 3, 4, 5]] == table[:-1, [0, 1, 3, 4, 5]], axis=1)
    return table[np.append(~same | (table[:-1, 0] != OPEN), True)]


_IS_STATE = 2


def _walk(keys: list[str], number: str):
    """State before each chunk (or stretch) from a state row and the tables in order."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for frame in _whole_groups(batches):
            lead_kind, matrix, parts = _ints(frame, "_lead"), _matrix(frame, _TABLE), []
            for lead, end in _groups(frame):
                if lead_kind[lead] == _IS_STATE:
                    state = matrix[lead : lead + 1, :3]
                    continue
                parts.append((lead, state))
                if end > lead + 1:
                    state = _after(state, matrix[lead + 1 : end])
            if parts:
                yield from _owned(frame, [*keys, number], parts, _STATE)

    return walk


def _replayer(columns: list[str], rules: Rules):
    levels = np.array(rules.cooldowns())

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            start = _matrix(table, ["_kind", "_count", "_until"]).tolist()
            parts = [chunk.replay(*start[lead]) for lead, chunk in _chunks(table, rules)]
            done = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
            rows = table.select(columns).filter(pa.array(_ints(table, "_lead") == 0))
            computed = {
                "allowed": pa.array(done["allowed"]),
                "state": pa.array(np.array(STATE_NAMES)[done["kind"]]),
                "failures": pa.array(done["failures"]),
                "cooldown": pa.array(levels[done["level"]]),
                "open_until": pa.array(done["until"], mask=done["kind"] != OPEN),
            }
            for name, values in computed.items():
                rows = rows.append_column(name, values)
            yield from rows.combine_chunks().to_batches()

    return replay


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _ddl(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names]


class _Replay:
    """The steps over one set of attempts."""

    def __init__(self, attempts, rules, keys, order, clock, ok, start, width, stretch):
        self.attempts, self.rules, self.keys, self.order = attempts, rules, list(keys), order
        self.start, self.stretch = start, stretch
        self.by_chunk = [*self.keys, CHUNK_COLUMN]
        self.coded = chunked(attempts, order, width=width).withColumns(
            {
                "_at": F.col(clock).cast("bigint"),
                "_outcome": F.coalesce(F.col(ok).cast("bigint"), _long(-1)),
            }
        )
        # one row per chunk, read by every step
        self.chunks = written(self._chunk_list(), "chunks")

    def _chunk_list(self) -> DataFrame:
        """Chunks with the latest time before them, and their place among a key's."""
        latest = self.coded.groupBy(*self.by_chunk).agg(F.max("_at").alias("_latest"))
        by_key = Window.partitionBy(*self.keys).orderBy(CHUNK_COLUMN)
        before = by_key.rowsBetween(Window.unboundedPreceding, -1)
        clock_before = F.max("_latest").over(before)
        chunks = latest.select(
            *self.by_chunk,
            clock_before.alias("_clock_before"),
            clock_before.isNull().alias("_first"),
            F.lead(CHUNK_COLUMN).over(by_key).isNotNull().alias("_followed"),
        )
        if self.start is None:
            states = {c: _long(0) for c in ("_kind", "_count", "_until")}
            return chunks.withColumns(
                {"_clock_before": F.coalesce("_clock_before", _long(_LONG_AGO)), **states}
            )
        start = self.start.select(
            *self.keys,
            *[F.col(c).cast("bigint").alias(f"_{c}") for c in (*_STATE, "clock")],
        )
        states = {c: F.coalesce(c, _long(0)) for c in ("_kind", "_count", "_until")}
        clock = F.coalesce(F.greatest("_clock_before", "_clock"), _long(_LONG_AGO))
        return (
            chunks.join(start, self.keys, "left")
            .withColumns({"_clock_before": clock, **states})
            .drop("_clock")
        )

    def _led(self, rows: DataFrame, leads: DataFrame) -> DataFrame:
        """Attempts of each chunk behind its lead row, in order, in one partition.

        One shuffle, and no join: what a chunk has to know travels in its lead row.
        """
        numbers = [c for c in leads.columns if c not in self.by_chunk]
        rows = rows.withColumns({"_lead": _long(0), **{c: _long(0) for c in numbers}})
        leads = leads.withColumns({"_lead": _long(1), "_at": _long(0), "_outcome": _long(0)})
        return (
            rows.unionByName(leads, allowMissingColumns=True)
            .repartition(*self.by_chunk)
            .sortWithinPartitions(*self.by_chunk, F.col("_lead").desc(), self.order)
        )

    def _end_tables(self) -> DataFrame:
        """End tables of all chunks that another one of the same key follows."""
        followed = self.chunks.where("_followed").select(*self.by_chunk, "_clock_before")
        rows = self.coded.select(*self.by_chunk, self.order, "_at", "_outcome").join(
            followed.select(*self.by_chunk), self.by_chunk, "left_semi"
        )
        ends = self._led(rows, followed).mapInArrow(
            _end_tables(self.keys, self.rules),
            ", ".join([*_ddl(self.coded, self.by_chunk), *[f"{c} bigint" for c in _TABLE]]),
        )
        return written(ends, "ends")

    def _walked(self, by: list[str], number: str, states, leads, tables) -> DataFrame:
        """State before each of ``leads`` (chunks or stretches), starting from ``states``."""
        empty = {c: _long(0) for c in _TABLE}
        rows = (
            states.withColumns({**{c: _long(0) for c in _TABLE[3:]}, "_lead": _long(_IS_STATE)})
            .unionByName(leads.withColumns({**empty, "_lead": _long(1)}), allowMissingColumns=True)
            .unionByName(tables.withColumn("_lead", _long(0)))
        )
        return (
            rows.repartition(*by)
            .sortWithinPartitions(*by, F.col(number).asc_nulls_first(), F.col("_lead").desc(), *_STATE)
            .mapInArrow(
                _walk(self.keys, number),
                ", ".join([*_ddl(rows, [*self.keys, number]), *[f"{c} bigint" for c in _STATE]]),
            )
        )

    def _states(self) -> DataFrame:
        """State before each chunk: ``keys, chunk, kind, count, until``."""
        named = {"_kind": "kind", "_count": "count", "_until": "until"}
        first = self.chunks.where("_first").withColumnsRenamed(named).select(*self.by_chunk, *_STATE)
        most = self.chunks.groupBy(*self.keys).count().agg(F.max("count")).first()[0]
        if most is None or most == 1:
            return first
        tables, leads = self._end_tables(), self.chunks.select(*self.by_chunk)
        first = first.drop(CHUNK_COLUMN)
        if most <= self.stretch:
            return self._walked(self.keys, CHUNK_COLUMN, first, leads, tables)

        stretch = {"_stretch": F.floor(F.col(CHUNK_COLUMN) / self.stretch).cast("bigint")}
        tables, leads = tables.withColumns(stretch), leads.withColumns(stretch)
        by_stretch = [*self.keys, "_stretch"]
        followed = (
            leads.select(*by_stretch)
            .distinct()
            .withColumn("_next", F.lead("_stretch").over(
                Window.partitionBy(*self.keys).orderBy("_stretch")))
        )
        composed = (
            leads.withColumns({**{c: _long(0) for c in _TABLE}, "_lead": _long(1)})
            .unionByName(tables.withColumn("_lead", _long(0)))
            .join(followed.where("_next IS NOT NULL").drop("_next"), by_stretch, "left_semi")
            .repartition(*by_stretch)
            .sortWithinPartitions(*by_stretch, CHUNK_COLUMN, F.col("_lead").desc(), *_STATE)
            .mapInArrow(
                _stretch_tables(self.keys),
                ", ".join([*_ddl(leads, by_stretch), *[f"{c} bigint" for c in _TABLE]]),
            )
        )
        states = self._walked(
            self.keys, "_stretch", first, followed.select(*by_stretch), composed
        )
        return self._walked(by_stretch, CHUNK_COLUMN, states, leads, tables)

    def replayed(self) -> DataFrame:
        states = self._states().withColumnsRenamed({c: f"_{c}" for c in _STATE})
        leads = self.chunks.select(*self.by_chunk, "_clock_before").join(states, self.by_chunk)
        columns = self.attempts.columns
        return self._led(self.coded, leads).mapInArrow(
            _replayer(columns, self.rules),
            ", ".join(
                [
                    *_ddl(self.attempts, columns),
                    "allowed boolean, state string, failures bigint, cooldown bigint",
                    "open_until bigint",
                ]
            ),
        )


def replay(
    attempts: DataFrame,
    rules: Rules = Rules(),
    *,
    keys: Sequence[str] = ("hostname",),
    order: str = "seq",
    clock: str = "at_s",
    ok: str = "ok",
    start: DataFrame | None = None,
    width: int = BREAKER_CHUNK,
    stretch: int = STRETCH,
) -> DataFrame:
    """Add what the breaker did at every attempt.

    ``allowed`` tells whether it let the attempt pass, ``state`` is the state
    after it, with ``failures``, ``cooldown`` and, while open, ``open_until``.
    ``ok`` NULL means that neither success nor failure was recorded. ``order`` is
    an integer, unique per key; a clock that steps back counts as standing still.
    ``start`` holds states to continue from, as :func:`final_states` gives them.
    """
    return _Replay(attempts, rules, keys, order, clock, ok, start, width, stretch).replayed()


def final_states(
    decisions: DataFrame,
    rules: Rules = Rules(),
    *,
    keys: Sequence[str] = ("hostname",),
    order: str = "seq",
    clock: str = "at_s",
) -> DataFrame:
    """State after the last attempt per key, from a replay: ``kind, count, until, clock``."""
    levels = F.array(*[_long(c) for c in rules.cooldowns()])
    names = F.array(*[F.lit(n) for n in STATE_NAMES])
    after = F.struct(order, "state", "failures", "cooldown", "open_until")
    last = F.col("_last")
    return (
        decisions.groupBy(*keys)
        .agg(F.max(after).alias("_last"), F.max(clock).alias("clock"))
        .select(
            *keys,
            (F.array_position(names, last["state"]) - 1).alias("kind"),
            F.when(last["state"] == "closed", last["failures"])
            .otherwise(F.array_position(levels, last["cooldown"]) - 1)
            .alias("count"),
            F.coalesce(last["open_until"], _long(0)).alias("until"),
            F.col("clock").cast("bigint").alias("clock"),
        )
    )
