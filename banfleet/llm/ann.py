"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Nearness in the graph is the inner product itself, so that the long vectors, which are the answers to
most queries, are linked with each other and listed by the short ones. Equal vectors are one place of
the graph. A first graph joins what random planes leave together; then rounds of joins let the neighbours
of each vector meet, of which one at least is new there, and each keeps the best it has met. A query walks
the graph from its own place: it opens the best of its list, and ends when all of them are open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from banfleet.llm.tiles import stretches
from banfleet.llm.vectors import rows_of
from banfleet.llm.workers import discard, partitions, written

#: Neighbours kept for each vector, and others that list it, drawn by hash, that a round lets in.
NEIGHBOURS = 32
LISTED = 32
#: Random cuts of the whole table, and rows of a part, at most, that are compared with each other.
CUTS, PART = 6, 1024
#: Rounds of neighbours of neighbours go on until so small a share of all list entries is new, better than the worst by
#: more than rounding.
SETTLED, ROUNDING = 0.01, 1e-6
#: Best partners that a meeting names to each of its members.
NAMED = 12
#: Length of a query's list, and how many of it are opened at once.
BEAM, OPENED = 160, 40

#: Lists, best first: partners, scores, and which entries are new since the last round.
_LIST = "id long, near binary, score binary, fresh binary"
_NAMES = ["id", "near", "score", "fresh"]


def _lists(ids: np.ndarray, *parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(x, pa.binary()) for x in parts]], names=_NAMES)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def _prepare(most: float, dim: int):
    """Valid vectors as single-precision rows, scaled by the largest length; all have ``dim`` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, _, good = rows_of(batch.column("v"))
            rows = (flat.reshape(-1, dim)[good] / most).astype(np.float32)
            ids = batch.column("id").take(pa.array(np.flatnonzero(good)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in rows], pa.binary())], names=["id", "v"])

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, starts, good = rows_of(batch.column("v"))
        size = [float(np.sqrt(flat[a:b] @ flat[a:b])) for a, b in zip(starts[:-1][good], starts[1:][good])]
        dim = np.diff(starts)[good]
        yield pa.RecordBatch.from_arrays([pa.array(dim), pa.array(size, pa.float64())], names=["dim", "size"])


def _codes(width: int, bits: int, seed: int):
    """Rows to (cut, code): the side of each of a cut's random planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).normal(size=(CUTS, width, bits)).astype(np.float32)
        for batch in batches:
            if not len(batch):
                continue
            rows = _matrix(batch.column("v"), width)
            for cut in range(CUTS):
                code = ((rows @ planes[cut] > 0) * (1 << np.arange(bits))).sum(1)
                columns = [*batch.columns, pa.array(np.full(len(rows), cut, np.int32)), pa.array(code.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "cut", "code"])

    return run


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's ``k`` largest scores, in no order."""
    if k >= score.shape[1]:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape)
    return np.argpartition(-score, k - 1, axis=1)[:, :k]


def _first(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in stretches(batches, ["cut", "code", "part"]):
            ids = table.column("id").to_numpy()
            rows = _matrix(table.column("v"), width)
            for at in range(0, len(ids), 512):
                score = rows[at : at + 512] @ rows.T
                score[np.arange(len(score)), np.arange(at, at + len(score))] = -4
                best = _best(score, NEIGHBOURS)
                own = np.take_along_axis(score, best, 1)
                fresh = [b"\1" * best.shape[1]] * len(best)
                yield _lists(ids[at : at + 512], [x.tobytes() for x in ids[best]], [x.tobytes() for x in own], fresh)

    return run


def _keep_best(ids: np.ndarray, near: np.ndarray, score: np.ndarray, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The best different partners of each id, best first; a row per id. What was there already isn't new."""
    order = np.lexsort((-score, fresh, near, ids))
    ids, near, score, fresh = ids[order], near[order], score[order], fresh[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (near[1:] != near[:-1])) & (near != ids) if len(ids) else np.zeros(0, bool)
    ids, near, score, fresh = ids[new], near[new], score[new], fresh[new]
    order = np.lexsort((near, -score, ids))
    ids, near, score, fresh = ids[order], near[order], score[order], fresh[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, int)
    for at in range(0, len(first), 5000):
        starts = first[at : at + 5000]
        ends = np.minimum(np.append(first[at + 1 : at + 1 + len(starts)], len(ids))[: len(starts)], starts + NEIGHBOURS)
        spans = list(zip(starts.tolist(), ends.tolist()))
        yield _lists(ids[starts], *[[x[a:b].tobytes() for a, b in spans] for x in (near, score, fresh)])


def _unpacked(ids: np.ndarray, near: list[bytes], score: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    near = [np.frombuffer(x, np.int64) for x in near]
    score = np.frombuffer(b"".join(score), np.float32)
    if not near:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), score
    return np.repeat(ids, [len(x) for x in near]), np.concatenate(near), score


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All lists of an id to one."""
    for batch in batches:
        near, score, fresh = (batch.column(x) for x in ("near", "score", "fresh"))
        ids = np.repeat(batch.column("id").to_numpy(), near.value_lengths().to_numpy())
        marks = np.frombuffer(b"".join(fresh.flatten().to_pylist()), bool)
        yield from _keep_best(*_unpacked(ids, near.flatten().to_pylist(), score.flatten().to_pylist()), marks)


def _merged(lists: DataFrame) -> DataFrame:
    of_id = lists.groupBy("id").agg(*[F.collect_list(x).alias(x) for x in _NAMES[1:]])
    return of_id.mapInArrow(_merge, _LIST)


def _met_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists without a new entry."""
    for batch in batches:
        old = [bytes(len(x)) for x in batch.column("fresh").to_pylist()]
        yield _lists(batch.column("id"), batch.column("near").to_pylist(), batch.column("score").to_pylist(), old)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, near, _ = _unpacked(batch.column("id").to_numpy(), batch.column("near").to_pylist(), batch.column("score").to_pylist())
        fresh = np.frombuffer(b"".join(batch.column("fresh").to_pylist()), bool)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near), pa.array(fresh)], names=["a", "b", "fresh"])


def _worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The score that a partner has to pass to enter each list."""
    for batch in batches:
        worst = []
        for x in batch.column("score").to_pylist():
            had = np.frombuffer(x, np.float32)
            worst.append(had[-1] + ROUNDING * abs(had[0]) if len(had) >= NEIGHBOURS else -4.0)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(worst, pa.float32())], names=["member", "worst"])


def _news(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the lists, and how many of them are new."""
    for batch in batches:
        fresh = batch.column("fresh").to_pylist()
        n, new = sum(len(x) for x in fresh), sum(x.count(1) for x in fresh)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([new])], names=["n", "new"])


def both_ways(lists: DataFrame) -> DataFrame:
    """Links (a, b, fresh) of the graph in both directions.

    An id listed very often keeps about :data:`LISTED` of them, drawn by a hash, so that a link stays drawn from
    round to round.
    """
    edges = lists.mapInArrow(_edges, "a long, b long, fresh boolean")
    often = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    drawn = edges.join(often, "b").where(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30)) * F.col("n") < LISTED << 30)
    back = drawn.select(F.col("b").alias("a"), F.col("a").alias("b"), "fresh")
    return edges.unionByName(back).groupBy("a", "b").agg(F.max("fresh").alias("fresh"))


def _meet(width: int):
    """Members by meeting to lists of better partners, joined for the whole task.

    Of two that were both there in the round before nothing is said again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for member, rows, worst, fresh in _meetings(batches, width):
            if not fresh.any():
                continue
            score = rows @ rows.T
            score[np.ix_(~fresh, ~fresh)] = -4
            np.fill_diagonal(score, -4)
            best = _best(score, NAMED)
            own = np.take_along_axis(score, best, 1)
            a, b = np.nonzero(own > np.maximum(worst, -3)[:, None])
            found.append((member[a], member[best[a, b]], own[a, b]))
            size += len(a)
            if size > 4_000_000:
                yield from _told(found)
                found, size = [], 0
        if found:
            yield from _told(found)

    return run


def _told(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    ids, near, score = (np.concatenate(x) for x in zip(*found))
    yield from _keep_best(ids, near, score, np.ones(len(ids), bool))


def _meetings(batches: Iterator[pa.RecordBatch], width: int):
    """Members of each meeting, from rows sorted by it."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        part = (
            batch.column("at").to_numpy(), batch.column("member").to_numpy(), _matrix(batch.column("v"), width),
            batch.column("worst").to_numpy(), batch.column("fresh").to_numpy(zero_copy_only=False),
        )
        if held is not None:
            part = tuple(np.concatenate(x) for x in zip(held, part))
        cuts = np.flatnonzero(np.append(True, part[0][1:] != part[0][:-1])).tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield tuple(x[a:b] for x in part[1:])
        held = tuple(x[cuts[-1] :] for x in part)
    if held is not None:
        yield held[1:]


def graph(base: DataFrame, width: int, n: int, seed: int = 11) -> DataFrame:
    """Lists (id, near, score, fresh) of every vector in ``base`` (id, v)."""
    bits = max(0, math.ceil(math.log2(max(1, n) / PART)))
    coded = written(base.mapInArrow(_codes(width, bits, seed), "id long, v binary, cut int, code long"), "codes")
    sizes = coded.groupBy("cut", "code").agg(F.count(F.lit(1)).alias("size"))
    parts = coded.join(sizes, ["cut", "code"]).withColumn("part", F.pmod(F.xxhash64("id", "cut"), F.ceil(F.col("size") / PART)))
    keys = ["cut", "code", "part"]
    first = parts.select("id", "v", *keys).repartition(*keys).sortWithinPartitions(*keys)
    lists = written(_merged(first.mapInArrow(_first(width), _LIST)), "lists")
    discard(coded)
    tasks = partitions(base.sparkSession)  # what is compared is far more than the bytes tell
    going = True
    while going:
        members = both_ways(lists).select(F.col("a").alias("at"), F.col("b").alias("member"), "fresh")
        live = members.where("fresh").select("at").distinct()
        members = members.unionByName(lists.select(F.col("id").alias("at"), F.col("id").alias("member"), F.lit(False).alias("fresh")))
        members = members.join(live, "at", "left_semi")
        worst = lists.mapInArrow(_worst, "member long, worst float")
        known = base.select(F.col("id").alias("member"), "v").join(worst, "member")
        met = members.join(known, "member").select("at", "member", "v", "worst", "fresh").repartition(tasks, "at").sortWithinPartitions("at")
        told = lists.mapInArrow(_met_once, _LIST).unionByName(met.mapInArrow(_meet(width), _LIST))
        before, lists = lists, written(_merged(told), "lists")
        found = lists.mapInArrow(_news, "n long, new long").agg(F.sum("n").alias("n"), F.sum("new").alias("new")).first()
        going = (found["new"] or 0) > SETTLED * (found["n"] or 0)
        discard(before)
    return lists


_STATE = "q long, qv binary, seen binary, near binary, score binary, open binary, todo array<long>"


def _opened(near: np.ndarray, score: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The list cut to its length, and what is to be opened next."""
    order = np.lexsort((near, -score))[:BEAM]
    near, score, done = near[order], score[order], done[order].copy()
    todo = np.flatnonzero(~done)[:OPENED]
    done[todo] = True
    return near, score, done, near[todo].tolist()


def _state(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64())]
    names = ["q", "qv", "seen", "near", "score", "open", "todo"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _start(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, v, near, score in zip(*(batch.column(x).to_pylist() for x in ("id", "v", "near", "score"))):
                near, score = np.frombuffer(near, np.int64), np.frombuffer(score, np.float32)
                near, score = np.append(near, q), np.append(score, np.float32(4))  # its own place is opened first
                near, score, done, todo = _opened(near, score, np.zeros(len(near), bool))
                rows.append((q, v, near.tobytes(), near.tobytes(), score.tobytes(), done.tobytes(), todo))
            if rows:
                yield _state(rows)

    return run


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        qs, ids = [], []
        for q, seen, found in zip(*(batch.column(x).to_pylist() for x in ("q", "seen", "found"))):
            new = np.setdiff1d(np.frombuffer(b"".join(found), np.int64), np.frombuffer(seen, np.int64))
            qs.append(np.full(len(new), q))
            ids.append(new)
        if qs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(qs)), pa.array(np.concatenate(ids))], names=["q", "id"])


def _advance(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = ("q", "qv", "seen", "near", "score", "open", "ids", "vs")
            for q, qv, seen, near, score, done, ids, vs in zip(*(batch.column(x).to_pylist() for x in columns)):
                near, score, done = np.frombuffer(near, np.int64), np.frombuffer(score, np.float32), np.frombuffer(done, bool)
                if ids:
                    new = np.array(ids, np.int64)
                    got = np.frombuffer(b"".join(vs), np.float32).reshape(len(new), width) @ np.frombuffer(qv, np.float32)
                    near, score, done = np.append(near, new), np.append(score, got), np.append(done, np.zeros(len(new), bool))
                    seen = seen + new.tobytes()
                near, score, done, todo = _opened(near, score, done)
                rows.append((q, qv, seen, near.tobytes(), score.tobytes(), done.tobytes(), todo))
            if rows:
                yield _state(rows)

    return run


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links sorted by their first end to one row per end."""
    for table in stretches(batches, ["a"]):
        yield pa.RecordBatch.from_arrays(
            [pa.array([table.column("a")[0].as_py()]), pa.array([table.column("b").to_numpy().tobytes()], pa.binary())], names=["node", "around"]
        )


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (x, xs, _), (y, ys, _) = rows_of(batch.column("x")), rows_of(batch.column("y"))
        score = [float(x[a:b] @ y[c:d]) for a, b, c, d in zip(xs, xs[1:], ys, ys[1:])]
        yield pa.RecordBatch.from_arrays([*batch.select(["q", "id"]).columns, pa.array(score, pa.float64())], names=["q", "id", "score"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        q, near, _ = _unpacked(batch.column("q").to_numpy(), batch.column("near").to_pylist(), batch.column("score").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(near)], names=["q", "id"])


def search(base: DataFrame, lists: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """Candidates (q, id) for every query id: itself and the best that a greedy walk from its own place meets."""
    links = both_ways(lists).repartition("a").sortWithinPartitions("a")
    around = written(links.mapInArrow(_around, "node long, around binary"), "around")
    state = written(queries.join(lists, "id").join(base, "id").mapInArrow(_start(width), _STATE), "walk")
    ended = []
    while True:
        going = state.where("size(todo) > 0")
        ended.append(state.where("size(todo) = 0").select("q", "near", "score"))
        if going.isEmpty():
            break
        opened = going.select("q", F.explode("todo").alias("node")).join(around, "node")
        found = opened.groupBy("q").agg(F.collect_list("around").alias("found"))
        new = going.select("q", "seen").join(found, "q").mapInArrow(_unseen, "q long, id long")
        met = new.join(base, "id").groupBy("q").agg(F.collect_list(F.struct("id", "v")).alias("met"))
        met = met.select("q", F.col("met.id").alias("ids"), F.col("met.v").alias("vs"))
        state = written(going.drop("todo").join(met, "q", "left").mapInArrow(_advance(width), _STATE), "walk")
    every = ended[0]
    for x in ended[1:]:
        every = every.unionByName(x)
    return every.mapInArrow(_candidates, "q long, id long")


def nearest(
    vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Each query's ``k`` largest inner products: query_id, rank (from 1), vec_id, score.

    Queries are rows of the table, given by a condition on the id; candidates are all rows but the query's own. Scores
    are exact products of the original vectors in double precision, ties go to the smaller id. Vectors that
    are null, empty or zero, or hold a null, NaN or infinity, take no part, nor do those of another
    dimension than the commonest, or with a null id. Ids are meant to be unique; of rows with an equal id one takes part. Equal
    vectors count as one in the graph, and take their places in the result by id. The graph is approximate, in the
    same way for tables of every size. Other columns are not read; an empty table gives no rows.
    """
    light = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    sizes = light.mapInArrow(_lengths, "dim long, size double").groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most"))
    top = sizes.orderBy(F.desc("n"), "dim").first()
    dim, most = (top["dim"], top["most"]) if top else (1, 1.0)
    light = light.where(F.size("v") == dim).dropDuplicates(["id"])
    # of equal vectors no more than the first k, and the query's own, can be among its nearest
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    alike = light.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v")
    places = written(alike.agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")), "places")
    base = written(places.mapInArrow(_prepare(most, dim), "id long, v binary"), "vectors")
    lists = graph(base, dim, base.count())
    asked = light.where(is_query(F.col("id"))).join(places.select(F.col("id").alias("q"), "v"), "v").select("q", F.col("id").alias("query_id"))
    asked = written(asked, "asked")
    alone = base.join(lists, "id", "left_anti")  # a place without another to link with
    lists = lists.unionByName(alone.select("id", *[F.lit(b"").alias(x) for x in _NAMES[1:]]))
    found = search(base, lists, asked.select(F.col("q").alias("id")).distinct(), dim)
    pairs = found.join(places.select("id", F.col("v").alias("y"), "ids"), "id").join(places.select(F.col("id").alias("q"), F.col("v").alias("x")), "q")
    scored = pairs.select("q", "id", "x", "y").mapInArrow(_exact, "q long, id long, score double")

    def first(column):
        return F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(column).alias("id")))), 1, k + 1)

    best = scored.groupBy("q").agg(first("id").alias("all")).select("q", F.explode("all").alias("x"))
    best = best.select("q", F.col("x.id").alias("id"), (-F.col("x.s")).alias("score")).join(places.select("id", "ids"), "id")
    best = best.select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q").agg(first("vec_id").alias("all"))
    listed = asked.join(best, "q").select("query_id", F.slice(F.filter("all", lambda x: x["id"] != F.col("query_id")), 1, k).alias("all"))
    rows = listed.select("query_id", F.posexplode("all").alias("place", "x"))
    return rows.select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score")
    )
