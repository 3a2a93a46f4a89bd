"""Jaccard join of documents on word shingles, with Bayesian pruning of candidates.

Candidates collide in a band of MinHash values. Their values are compared step by step, and a pair
is dropped once the posterior probability of reaching the threshold falls below a tolerance; the
rest is verified exactly on the shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banfleet.llm.components import components
from banfleet.llm.textbytes import Words, chunks, mixed, words
from banfleet.llm.tiles import compare_tile, stretches, tiled
from banfleet.llm.workers import discard, release, worker_cache, written

BANDS, ROWS = 32, 5
VALUES = BANDS * ROWS
#: MinHash values compared before each look at the posterior.
STEP = 32
#: Rows of a block, and of one where only values are compared.
BLOCK, SKETCHES = 512, 4096


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's different runs of ``size`` words, ascending, and where each text's begin.

    A text of fewer words has one run, of all of them; a text without words has none.
    """
    n = np.diff(w.starts)
    odd = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    padded = np.concatenate([w.hashes, np.zeros(size, np.uint64)])
    at = np.arange(len(w.hashes))
    own = np.repeat(np.arange(len(n)), n)
    left = w.starts[1:][own] - at  # words up to the text's end
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total += np.where(left > k, padded[k : k + len(at)] * odd[k], np.uint64(0))
    keep = (left >= size) | ((n[own] < size) & (at == w.starts[:-1][own]))
    h, own = mixed(total[keep]), own[keep]
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], np.searchsorted(own[new], np.arange(len(n) + 1))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values, a row per text that has shingles."""
    full = starts[:-1] < starts[1:]
    out = np.empty((int(full.sum()), VALUES), np.uint32)
    if len(out):
        first = starts[:-1][full]
        for j, m in enumerate(worker_cache("multipliers", _multipliers)):
            out[:, j] = np.minimum.reduceat(h * m, first) >> np.uint64(32)
    return out


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped).

    With a uniform prior the similarity's posterior after m matches of n is Beta(m + 1, n - m + 1);
    its mass from the threshold on is the chance of at most m successes in n + 1 draws.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


class _Settings(NamedTuple):
    size: int
    threshold: float
    steps: list[tuple[int, int]]


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                h, starts = shingles(words(c.data, c.starts), size)
                full = np.flatnonzero(starts[:-1] < starts[1:])
                if not len(full):
                    continue
                one, two = (per_sum(mixed(h + np.uint64(x)), starts)[full] for x in (1, 2))
                columns = [
                    batch.column("id").take(pa.array(full + c.first)),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pa.array(np.diff(starts)[full]),
                    pa.array([x.tobytes() for x in signatures(h, starts)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "one", "two", "n", "values"])

    return run


def per_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum modulo 2^64 of each text's values."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[starts[1:]] - sums[starts[:-1]]


def _alike(least: float):
    """Keeps links (a, b) whose values agree in that share of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, VALUES) for k in ("va", "vb"))
                keep = pa.array((x == y).mean(1) >= least)
                yield batch.select(["a", "b"]).filter(keep)

    return run


def _alive(settings: _Settings, n: np.ndarray, values: np.ndarray, a: int, others: np.ndarray) -> np.ndarray:
    """Positions in ``others`` of what sizes and values leave as candidates of ``a``."""
    few, many = np.minimum(n[a], n[others]), np.maximum(n[a], n[others])
    alive = np.flatnonzero(few >= settings.threshold * many)
    matches = np.zeros(len(alive), np.int64)
    for upto, least in settings.steps:
        part = slice(upto - STEP, upto)
        matches = matches + (values[others[alive], part] == values[a, part]).sum(1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def _between(settings: _Settings):
    """Tiles of bands to links (a, b) that span the candidates of different groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in stretches(batches, ["band", "_i", "_j"]):
            ids, group = tile.column("id").to_numpy(), tile.column("component").to_numpy()
            n = tile.column("n").to_numpy().astype(np.int64)
            values = np.frombuffer(b"".join(tile.column("values").to_pylist()), np.uint32).reshape(-1, VALUES)

            def linked(a: int, others: np.ndarray) -> np.ndarray:
                out = np.zeros(len(others), bool)
                apart = np.flatnonzero(group[others] != group[a])
                out[apart[_alive(settings, n, values, a, others[apart])]] = True
                return out

            _, root = compare_tile(tile, np.argsort(ids, kind="stable"), linked, np.ones(len(ids), np.int64))
            hung = np.flatnonzero(ids[root] != ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hung]), pa.array(ids[root][hung])], names=["a", "b"])

    return run


def _with_shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                h, starts = shingles(words(c.data, c.starts), size)
                own = per_sum(mixed(h + np.uint64(1)), starts).view(np.int64)
                runs = pa.array([h[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary())
                rest = batch.drop_columns(["text"]).slice(c.first, len(runs))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(own), runs], names=[*rest.schema.names, "own", "runs"])

    return run


def _compare(settings: _Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in stretches(batches, ["component", "_i", "_j"]):
            ids = tile.column("id").to_numpy()
            n = tile.column("n").to_numpy().astype(np.int64)
            values = np.frombuffer(b"".join(tile.column("values").to_pylist()), np.uint32).reshape(-1, VALUES)
            runs = [np.frombuffer(x, np.uint64) for x in tile.column("runs").to_pylist()]
            vocabulary, number = np.unique(np.concatenate(runs), return_inverse=True)
            ends = np.append(0, np.cumsum([len(x) for x in runs]))
            flag = np.zeros(len(vocabulary), bool)

            def linked(a: int, others: np.ndarray) -> np.ndarray:
                alive = _alive(settings, n, values, a, others)
                out = np.zeros(len(others), bool)
                if len(alive):
                    own = number[ends[a] : ends[a + 1]]
                    flag[own] = True
                    b = others[alive]
                    joined = np.concatenate([number[ends[x] : ends[x + 1]] for x in b.tolist()])
                    cuts = np.cumsum(n[b]) - n[b]
                    common = np.add.reduceat(flag[joined].astype(np.int64), cuts)
                    flag[own] = False
                    out[alive] = common >= settings.threshold * (n[a] + n[b] - common) - 1e-9
                return out

            order = np.argsort(ids, kind="stable")
            count, root = compare_tile(tile, order, linked, tile.column("copies").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count), pa.array(ids[root])], names=["id", "links", "root"])

    return run


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    threshold: float = 0.8,
    tolerance: float = 1e-6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``class_id`` and ``n_links``.

    Documents are linked if the Jaccard similarity of their sets of ``size``-word shingles (between ASCII
    white space, as written) is at least ``threshold``. ``n_links`` counts the other documents linked directly,
    copies included; ``class_id`` is the least id reachable. Texts of fewer words have one shingle, of
    all words; texts without a word, null ones too, are linked with nothing. Ids are meant to be unique: rows with an
    equal id are one document, of different texts the one with the least digest, and each gives
    its row. Rows with a null id take no part and have 0 links. Other columns are not read; an empty table gives no rows.

    Equal shingle sets are one candidate, however many copies there are. Bands that two or more share
    give a link to the band's least id; such stars of not too different ones (half their values) make
    first groups. Where a band holds members of several groups, these are compared by their values, in tiles, and
    what they leave as candidates joins its groups: every pair that shares a band is judged by its own values. All of
    a group are compared in tiles, so that no pair is a row.
    """
    light = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    drawn = light.mapInArrow(_sketch(size), "id long, one long, two long, n long, values binary")
    single = drawn.groupBy("id").agg(F.min(F.struct("one", "two", "n", "values")).alias("x")).select("id", "x.*")
    sketches = written(single, "sketches")
    sets = written(
        sketches.groupBy("one", "two").agg(
            F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.any_value("values").alias("values")
        ),
        "sets",
    )
    members_of = written(sketches.select("id", "one", "two"), "members")
    discard(sketches)
    width = 4 * ROWS
    bands = F.expr(f"transform(sequence(0, {BANDS - 1}), j -> xxhash64(substring(values, j * {width} + 1, {width}), j))")
    keyed = sets.select("id", F.explode(bands).alias("band"))
    hubs = keyed.groupBy("band").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ends = written(keyed.join(hubs, "band").where("id <> hub").select("id", "band", "hub", "n"), "stars")
    stars = ends.select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    values = sets.select("id", "values")
    pairs = (
        stars.join(values.select(F.col("id").alias("a"), F.col("values").alias("va")), "a")
        .join(values.select(F.col("id").alias("b"), F.col("values").alias("vb")), "b")
        .select("a", "b", "va", "vb")
    )
    settings = _Settings(size, threshold, least_matches(threshold, tolerance))
    half = min(0.5, settings.steps[-1][1] / VALUES)
    near = written(components(pairs.mapInArrow(_alike(half), "a long, b long")), "near")
    # the hub has met all; of two others of different groups neither has met the other yet
    placed = ends.where("n > 2").join(near, "id", "left").select("id", "band", F.coalesce("component", "id").alias("component"))
    several = placed.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    apart = placed.join(several.where("low <> high").select("band", "size"), "band").join(sets.select("id", "n", "values"), "id")
    between = tiled(apart, ["band"], F.col("size"), ["id"], SKETCHES).mapInArrow(_between(settings), "a long, b long")
    links = near.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(between)
    groups = written(components(links), "groups")
    discard(ends, near)
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = groups.join(sizes, "component").join(sets, "id")
    texts = members.join(light, "id").select("id", "component", "size", "copies", "n", "values", "one", "two", "text")
    fields = "id long, component long, size long, copies long, n long, values binary, one long, two long"
    found = texts.mapInArrow(_with_shingles(size), f"{fields}, own long, runs binary")
    found = found.where("one = own").drop("one", "two", "own").dropDuplicates(["id"])
    compared = written(
        tiled(found, ["component"], F.col("size"), ["id"], BLOCK).mapInArrow(
            _compare(settings), "id long, links long, root long"
        ),
        "compared",
    )
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(compared.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_set = (
        sets.select("one", "two", "id", "copies")
        .join(links, "id", "left")
        .join(classes, "id", "left")
        .select(
            "one", "two", F.coalesce("component", "id").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    placed = members_of.join(of_set, ["one", "two"]).select("id", "class_id", "n_links")
    every = docs.select(F.col(id_col).alias("id")).join(placed.dropDuplicates(["id"]), "id", "left")
    result = written(
        every.select(
            F.col("id").alias(id_col),
            F.coalesce("class_id", "id").cast("long").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        ),
        "classes",
    )
    discard(sets, members_of, groups, compared)
    release(docs.sparkSession)
    return result
