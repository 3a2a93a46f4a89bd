"""Near-duplicate embeddings: spherical k-means cells, packed in blocks that are compared two by two.

For two vectors on either side of the plane between two centres, one is at most half their distance
away from it. So of two cells only those vectors are compared with the other one that are nearer to
the plane than half the distance that the threshold allows, and no link is lost to the cut into cells.

A vector is stored in one block only, and blocks meet in pairs that are read straight from their table:
what is on disk doesn't grow with the number of comparisons.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banfleet.llm.components import components
from banfleet.llm.tiles import stretches
from banfleet.llm.vectors import rows_of, sampled, spherical_kmeans, unit
from banfleet.llm.workers import discard, partitions, small_batches, written

#: Vectors that the centres are fitted on, at most.
SAMPLE = 20_000
#: Rows a cell would have if there were as many cells: their number is the root of rows by this.
SPREAD = 200
#: Vectors of a block, about, and those of them that are multiplied with all others at once.
BLOCK, SLAB = 2048, 256
#: Bytes of a block's vectors as doubles, about: long vectors have smaller blocks.
WIDE = 4 << 20
#: Bytes of vectors that a task reads of either side of the pairs, about.
SIDE = 32 << 20
#: Bytes of blocks that go to a Python worker at once, about.
BATCH = 8 << 20
#: Rows of links that a task holds before it adds up those of an id.
HELD = 1 << 18
#: Blocks are rows of about a megabyte: small row groups, so that neither writer nor reader holds many.
FILES = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
KEY = ["label", "dim", "part", "sub"]


def cells_of(rows: np.ndarray, centres: np.ndarray, margin: float, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each unit row's own cell (``home`` if given), and a mask of the cells that it is compared with."""
    near = rows @ centres.T
    home = near.argmax(1) if home is None else home
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    own = near[np.arange(len(rows)), home]
    inside = own[:, None] - near <= margin * apart[home] + 1e-9
    inside[np.arange(len(rows)), home] = True
    return home, inside


def _homes(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cells of unit rows, -1 if they have another dimension than the centres."""
    if units.shape[1] != centres.shape[1]:
        return np.full(len(units), -1, np.int32)
    # not by BLAS, whose last digits depend on where a row stands: equal vectors must get equal cells
    return np.einsum("ij,kj->ik", units, centres).argmax(1).astype(np.int32)


def _keys(units: np.ndarray) -> pa.Array:
    data, n = np.ascontiguousarray(units).tobytes(), units.shape[1] * 8
    return pa.array([hashlib.blake2b(data[i : i + n], digest_size=16).digest() for i in range(0, len(data), n)], pa.binary())


def _keyed(centres: np.ndarray):
    """Rows that take part, with a digest of the unit vector in the vector's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, rows in _by_dimension(batches):
            units = unit(rows)
            dim = pa.array(np.full(len(units), units.shape[1], np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, dim, pa.array(_homes(units, centres)), _keys(units)], names=["id", "label", "dim", "home", "key"]
            )

    return run


def _by_dimension(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Ids and labels of rows that take part and have one dimension, their vectors as stored and as doubles."""
    for whole in batches:
        for at in range(0, len(whole), 2000):
            batch = whole.slice(at, 2000)
            column = batch.column("v")
            flat, starts, good = rows_of(column)
            sizes = np.diff(starts)
            kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
            for dim in np.unique(sizes[good]).tolist():
                keep = np.flatnonzero(good & (sizes == dim))
                rows = flat[starts[keep][:, None] + np.arange(dim)]
                yield batch.select(["id", "label"]).take(pa.array(keep)), rows.astype(kind), rows


def _distinct(centres: np.ndarray):
    """Vectors as bytes, with their cells; equal ones of a batch once, with the least id and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, stored, rows in _by_dimension(batches):
            units = unit(rows)
            table = pa.table({
                "id": batch.column("id"), "label": batch.column("label"), "key": _keys(units), "at": pa.array(np.arange(len(rows))),
            })
            sets = table.group_by(["label", "key"]).aggregate([("id", "min"), ("id", "count"), ("at", "min")])
            at = sets.column("at_min").to_numpy()
            data, n = stored.tobytes(), stored.itemsize * stored.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    sets.column("id_min").combine_chunks(), sets.column("id_count").combine_chunks(), sets.column("label").combine_chunks(),
                    pa.array(np.full(len(at), rows.shape[1], np.int32)), pa.array(_homes(units, centres)[at]),
                    sets.column("key").combine_chunks(), pa.array([data[i * n : (i + 1) * n] for i in at.tolist()], pa.binary()),
                ],
                names=["id", "copies", "label", "dim", "home", "key", "vector"],
            )

    return run


def _packed(centres: np.ndarray, margin: float, kind: type):
    """One row for each block: its cells, the cells that its vectors are compared with, and its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in stretches(batches, KEY):
            key = np.frombuffer(b"".join(block.column("key").to_pylist()), np.int64).reshape(-1, 2)
            first = np.append(0, 1 + np.flatnonzero((key[1:] != key[:-1]).any(1)))
            ids = np.minimum.reduceat(block.column("id").to_numpy(), first)
            copies = np.add.reduceat(block.column("copies").to_numpy(), first)
            home = block.column("home").to_numpy()[first]
            data = b"".join(block.column("vector").take(pa.array(first)).to_pylist())
            cells = reach = np.unique(home)
            if cells[0] >= 0:
                rows = np.frombuffer(data, kind).reshape(len(ids), -1)
                reach = np.flatnonzero(cells_of(unit(rows.astype(np.float64)), centres, margin, home)[1].any(0)).astype(np.int32)
            lists = [pa.array([x], pa.list_(pa.int32())) for x in (cells, reach)]
            bytes_ = [pa.array([x], pa.binary()) for x in (home.tobytes(), ids.tobytes(), copies.tobytes(), data)]
            keys = [block.column(k).chunk(0).slice(0, 1) for k in [*KEY, "alone"]]
            yield pa.RecordBatch.from_arrays(
                [*keys, *lists, *bytes_, pa.array([len(data)])],
                names=[*KEY, "alone", "cells", "reach", "home", "ids", "copies", "vectors", "size"],
            )

    return run


class _Block:
    """A block's vectors as unit rows."""

    def __init__(self, batch: pa.RecordBatch, at: int, side: str, kind: type):
        home, self.ids, self.copies, rows = (
            np.frombuffer(batch.column(side + name)[at].as_buffer(), k)
            for name, k in (("home", np.int32), ("ids", np.int64), ("copies", np.int64), ("vectors", kind))
        )
        self.home, self.cells = home, np.unique(home)
        self.rows = unit(rows.reshape(len(home), -1).astype(np.float64))
        self.light = self.rows.astype(np.float32)

    def near(self, cells: np.ndarray, centres: np.ndarray, margin: float) -> np.ndarray:
        """Places of the rows that are compared with some of the cells."""
        if self.home[0] < 0:
            return np.arange(len(self.home))
        return np.flatnonzero(cells_of(self.rows, centres, margin, self.home)[1][:, cells].any(1))


def _linked(x: _Block, a: np.ndarray, y: _Block, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked rows of two blocks, among ``a`` of the one and ``b`` of the other.

    Products in single precision decide where they are further from the threshold than their error.
    """
    error = (x.rows.shape[1] + 8) * 2.0**-23
    others = y.light[b].T
    for at in range(0, len(a), SLAB):
        slab = a[at : at + SLAB]
        near = x.light[slab] @ others
        i, j = np.nonzero(near >= threshold - error)
        if not len(i):
            continue
        sure = near[i, j] >= threshold + error
        i, j = slab[i], b[j]
        unsure = np.flatnonzero(~sure)
        for k in range(0, len(unsure), 1 << 14):
            part = unsure[k : k + (1 << 14)]
            sure[part] = np.einsum("ij,ij->i", x.rows[i[part]], y.rows[j[part]]) >= threshold
        yield i[sure], j[sure]


def _join(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let the trees of places ``a`` and ``b`` hang on one root each; ``up`` names every place's root."""
    while True:
        a, b = up[a], up[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while ((over := up[up]) != up).any():
            up[:] = over


class _Links:
    """What a task finds: the number of links of an id, and an id that it hangs together with."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, ids: np.ndarray, copies: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        up = links = None
        for a, b in pairs:
            if not len(a):
                continue
            if up is None:
                up, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
            links += np.bincount(a, copies[b], len(ids)).astype(np.int64) + np.bincount(b, copies[a], len(ids)).astype(np.int64)
            _join(up, a, b)
        if up is not None:
            some = np.flatnonzero(links)
            self.held.append((ids[some], links[some], ids[up[some]]))
            self.size += len(some)
            if self.size > HELD:
                self.add_up()

    def add_up(self) -> None:
        ids, links, roots = (np.concatenate(x) for x in zip(*self.held))
        every, at = np.unique(np.append(ids, roots), return_inverse=True)
        own, root = at[: len(ids)], at[len(ids) :]
        up, total = np.arange(len(every)), np.zeros(len(every), np.int64)
        np.add.at(total, own, links)
        _join(up, own, root)
        self.held, self.size = [(every, total, every[up])], 0  # ids that were added up don't count again

    def batch(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.add_up()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in self.held[0]], names=["id", "links", "root"])


def _within(threshold: float, kind: type):
    """Links between the vectors of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links()
        for batch in batches:
            for at in range(len(batch)):
                x = _Block(batch, at, "", kind)
                every = np.arange(len(x.ids))
                if len(every) > 1:
                    pairs = ((i[i < j], j[i < j]) for i, j in _linked(x, every, x, every, threshold))
                    links.add(x.ids, x.copies, pairs)
        yield from links.batch()

    return run


def _between(threshold: float, kind: type, centres: np.ndarray, margin: float):
    """Links between the vectors of two blocks."""

    def pairs(x: _Block, y: _Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = x.near(y.cells, centres, margin), y.near(x.cells, centres, margin)
        rest = np.setdiff1d(np.arange(len(x.ids)), a)
        for some, others in ((a, np.arange(len(y.ids))), (rest, b)):
            if len(some) and len(others):
                for i, j in _linked(x, some, y, others, threshold):
                    yield i, len(x.ids) + j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, last, x = _Links(), None, None
        for batch in batches:
            names = [batch.column("a_" + k).to_pylist() for k in KEY]
            for at, name in enumerate(zip(*names)):
                if name != last:
                    x, last = _Block(batch, at, "a_", kind), name
                y = _Block(batch, at, "b_", kind)
                links.add(np.append(x.ids, y.ids), np.append(x.copies, y.copies), pairs(x, y))
        yield from links.batch()

    return run


def _parts(keyed: DataFrame) -> DataFrame:
    """Blocks of the cells of labels that need several: (label, dim, blocks), a map of cell to (part, parts).

    A small cell shares a block with its neighbours in number, a large one is dealt to ``parts`` of its
    own. Sizes are estimates; they shape the blocks and nothing else.
    """
    sizes = keyed.groupBy("label", "dim", "home").agg(F.approx_count_distinct("key").alias("size"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(WIDE // 8) / F.col("dim"))))
    whole = Window.partitionBy("label", "dim")
    before = F.coalesce(F.sum("size").over(whole.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("size") / block)).cast("int"))
    shared = F.floor(before / block).cast("int")
    sizes = sizes.withColumn("part", F.when(F.col("parts") == 1, shared).otherwise(-2 - F.col("home")).cast("int"))
    several = sizes.withColumn("_all", F.sum("size").over(whole)).where(F.col("_all") > block)
    return several.groupBy("label", "dim").agg(F.map_from_entries(F.collect_list(F.struct("home", F.struct("part", "parts")))).alias("blocks"))


def _pairs(blocks: DataFrame, size: int) -> DataFrame:
    """Every two blocks that may hold linked vectors, read from their table: nothing is shuffled."""
    some = blocks.where("not alone")
    tasks = blocks.sparkSession.sparkContext.defaultParallelism
    side = max(math.ceil(math.sqrt(3 * tasks)), math.ceil(size / SIDE))

    def named(letter: str) -> DataFrame:
        return some.select([F.col(c).alias(letter + c) for c in some.columns]).coalesce(side)

    def ordered() -> Column:
        return (F.col("a_part") < F.col("b_part")) | ((F.col("a_part") == F.col("b_part")) & (F.col("a_sub") < F.col("b_sub")))

    same = (F.col("a_label") == F.col("b_label")) & (F.col("a_dim") == F.col("b_dim"))
    meet = F.arrays_overlap("a_reach", "b_cells") | F.arrays_overlap("a_cells", "b_reach")
    return named("a_").join(named("b_").hint("shuffle_replicate_nl"), same & ordered() & meet)


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` and ``kept``.

    Vectors with equal labels, not null, are linked if their cosine in double precision is at least
    ``threshold``; vectors of different dimension never are. Vectors that are null, empty or zero, or hold
    a null, NaN or infinity, and those with a null label, are linked with nothing and kept. Equal
    vectors of a label are compared once, however many there are. Ids are meant to be unique: rows with an equal id
    are linked like others, and share a component; rows with a null id are dropped. Other columns are not
    read; an empty table gives no rows.

    The centres are fitted on at most :data:`SAMPLE` vectors; all vectors are compared, whatever
    the centres. Their number grows with the root of the number of vectors, and they are sent
    with the tasks. On disk are, at most, a shuffle of the distinct vectors and their blocks, once each, ids
    and digests of all rows, and for each vector that has links a row from each task that found some.
    """
    light = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")
    ).where("id is not null")
    of = light.schema["label"].dataType.simpleString()
    kind = np.float32 if light.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    labelled = light.where("label is not null")
    _, sample = sampled(light, "id", "v", SAMPLE)
    sample = unit(sample) if len(sample) else np.zeros((1, 1))
    centres = spherical_kmeans(sample, max(1, min(len(sample), round(math.sqrt(labelled.count() / SPREAD)))))
    margin = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2
    keyed = written(labelled.mapInArrow(_keyed(centres), f"id long, label {of}, dim int, home int, key binary"), "keyed")
    parts = written(_parts(keyed), "parts")
    found = labelled.mapInArrow(_distinct(centres), f"id long, copies long, label {of}, dim int, home int, key binary, vector binary")
    block = F.try_element_at("blocks", F.col("home"))
    sub = F.pmod(F.xxhash64("key"), F.coalesce(block["parts"], F.lit(1))).cast("int")
    placed = found.join(parts, ["label", "dim"], "left").select(
        "label", "dim", F.coalesce(block["part"], F.lit(0)).alias("part"), sub.alias("sub"), F.isnull("blocks").alias("alone"),
        "home", "key", "id", "copies", "vector",
    )
    blocks = written(
        placed.repartition(partitions(light.sparkSession), *KEY)
        .sortWithinPartitions(*KEY, "key")
        .mapInArrow(
            _packed(centres, margin, kind),
            f"label {of}, dim int, part int, sub int, alone boolean, cells array<int>, reach array<int>, "
            "home binary, ids binary, copies binary, vectors binary, size long",
        ),
        "blocks",
        FILES,
    )
    size = blocks.where("not alone").agg(F.sum("size")).first()[0] or 0
    schema = "id long, links long, root long"
    within = blocks.mapInArrow(_within(threshold, kind), schema)
    between = _pairs(blocks, size).mapInArrow(_between(threshold, kind, centres, margin), schema)
    with small_batches(light.sparkSession, BATCH):
        compared = written(within.unionByName(between), "compared")
    discard(blocks, parts)
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(compared.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_set = (
        keyed.groupBy("label", "key")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
        .join(links, "id", "left")
        .join(classes, "id", "left")
        .select(
            "label", "key", F.coalesce("component", "id").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    found = keyed.join(of_set, ["label", "key"]).select("id", "component_id", "n_links")
    every = light.select("id").join(found.groupBy("id").agg(F.min("component_id").alias("component_id"), F.max("n_links").alias("n_links")), "id", "left")
    return every.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        (F.coalesce("component_id", "id") == F.col("id")).alias("kept"),
    )
