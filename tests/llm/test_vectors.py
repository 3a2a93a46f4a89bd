"""Vector operators and components against brute force."""

import contextlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from banfleet.llm import ann, embedding_dedup, workers
from banfleet.llm.components import components
from banfleet.session import shared_folder

SCHEMA = "vec_id long, embedding array<float>, label int, id int, n int, score float, size int, cell int, home int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 2, 3.0, 4, 5, 6) for i, v, lab in rows], SCHEMA)


def clustered(draw, n, dim, spread):
    centres = draw.normal(size=(6, dim))
    return (centres[draw.integers(0, 6, n)] + spread * draw.normal(size=(n, dim))).astype(np.float32)


ODD = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [float("nan")] + [1.0] * 7, 1), (904, [None] + [1.0] * 7, 1),
    (905, [float("inf")] + [1.0] * 7, 1), (906, [1.0] * 5, 1), (907, [1.0] * 5, 1),
]


def brute(rows, threshold):
    """{id: (links, component)} over the rows that take part."""
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None]
    taking = {i: (v / np.linalg.norm(v), lab) for i, v, lab in good if lab is not None and v.ndim and v.size and np.isfinite(v).all() and v.any()}
    up, links = {i: i for i, _, _ in good}, {i: 0 for i, _, _ in good}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(taking)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            (x, la), (y, lb) = taking[a], taking[b]
            if la == lb and len(x) == len(y) and x @ y >= threshold:
                links[a], links[b] = links[a] + 1, links[b] + 1
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (links[i], root(i)) for i in up}


@pytest.mark.parametrize("block,spread", [(2048, 200), (40, 5)])
def test_linked_vectors_by_brute_force(spark, monkeypatch, block, spread):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "SPREAD", spread)
    draw = np.random.default_rng(1)
    v = clustered(draw, 400, 8, 0.35)
    rows = [(int(i), v[i].tolist(), [None, 1, 2][int(draw.integers(0, 12)) % 3]) for i in range(400)]
    rows += [(500 + k, v[3].tolist(), 1) for k in range(30)] + [(600, (v[5] * 100).tolist(), 1)] + ODD
    got = embedding_dedup.near_duplicates(frame(spark, [*rows, (None, v[0].tolist(), 1)]), threshold=0.93).collect()
    want = brute(rows, 0.93)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want and len(got) == len(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert sum(n for n, _ in want.values()) > 1000


def test_linked_vectors_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 12)
    monkeypatch.setattr(embedding_dedup, "SPREAD", 10)
    draw = np.random.default_rng(5)
    rows = []
    for dim, n in ((8, 260), (3, 60)):  # few of the second dimension, far from any centre's
        v = clustered(draw, n, dim, 0.3).astype(float)
        rows += [(1000 * dim + i, v[i].tolist(), i % 2) for i in range(n)]
        rows += [(1000 * dim + 400 + i, v[i].tolist(), i % 2) for i in range(0, n, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, threshold=0.93).collect()}
    assert got == brute(rows, 0.93) and sum(n for n, _ in got.values()) > 1000


def bytes_in(*folders):
    return sum(os.path.getsize(os.path.join(at, f)) for top in folders for at, _, names in os.walk(top) for f in names)


@contextlib.contextmanager
def shuffles_kept(spark):
    """So that all of them are seen afterwards."""
    before = spark.conf.get(workers._CLEANUP)
    spark.conf.set(workers._CLEANUP, "false")
    yield
    spark.conf.set(workers._CLEANUP, before)


def test_disk_does_not_grow_with_comparisons(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 200)
    monkeypatch.setattr(embedding_dedup, "SPREAD", 20)
    monkeypatch.setattr(workers, "shuffles_removed", shuffles_kept)
    draw = np.random.default_rng(6)
    v = draw.normal(size=(2000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>, label int").repartition(4)
    folders = [*spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString(), shared_folder(spark).removeprefix("file://")]
    before = bytes_in(*folders)
    assert embedding_dedup.near_duplicates(df).where("n_links = 0 and kept").count() == 2000
    assert bytes_in(*folders) - before < 5 * v.nbytes


def test_links_of_a_task_are_added_up(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "HELD", 20)
    draw = np.random.default_rng(7)
    ids = draw.permutation(90).astype(np.int64) * 3
    copies = draw.integers(1, 4, 90)
    links, want, edges = embedding_dedup._Links(), dict.fromkeys(ids.tolist(), 0), []
    for _ in range(25):
        some = draw.choice(90, 12, replace=False)
        a, b = np.triu_indices(12, 1)
        pick = draw.random(len(a)) < 0.03
        links.add(ids[some], copies[some], iter([(a[pick][:2], b[pick][:2]), (a[pick][2:], b[pick][2:])]))
        for x, y in zip(some[a[pick]].tolist(), some[b[pick]].tolist()):
            want[int(ids[x])] += int(copies[y])
            want[int(ids[y])] += int(copies[x])
            edges.append((int(ids[x]), int(ids[y])))

    def classes(pairs):
        up = {i: i for i in ids.tolist()}
        for a, b in pairs:
            old, new = up[a], up[b]
            up = {k: new if x == old else x for k, x in up.items()}
        return {frozenset(k for k in up if up[k] == x) for x in up.values()}

    got = [r for batch in links.batch() for r in batch.to_pylist()]
    assert {r["id"]: r["links"] for r in got if r["links"]} == {k: n for k, n in want.items() if n} and len(got) <= 90
    assert classes([(r["id"], r["root"]) for r in got]) == classes(edges)


def test_cells_keep_every_pair_in_reach():
    draw = np.random.default_rng(2)
    rows = draw.normal(size=(300, 6))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    centres = rows[:9]
    home, inside = embedding_dedup.cells_of(rows, centres, np.sqrt(2 - 2 * 0.9) / 2)
    a, b = np.nonzero(rows @ rows.T >= 0.9)
    assert (inside[a, home[b]] | inside[b, home[a]]).all()


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(frame(spark, ODD).limit(0)).count() == 0
    got = embedding_dedup.near_duplicates(frame(spark, ODD[:3])).collect()
    assert [(r["n_links"], r["kept"]) for r in got] == [(0, True)] * 3


def test_components_by_brute_force(spark):
    draw = random.Random(1)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    links += [(5000, 5000 + i) for i in range(1, 80)] + [(7, 7), (None, 4)]
    up = {x: x for e in links if None not in e and e[0] != e[1] for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a in up and b in up:
            up[max(root(a), root(b))] = min(root(a), root(b))
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {x: root(x) for x in up} and len(got) == len(up)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and None not in v]
    good = {i: v for i, v in good if len(v) == 8 and np.isfinite(v).all() and v.any()}
    return {q: sorted((-float(x @ y), i) for i, y in good.items() if i != q)[:k] for q, x in good.items() if q % 20 == 0}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_small_tables_are_exact(spark):
    draw = np.random.default_rng(3)
    v = clustered(draw, 90, 8, 1.0) * draw.uniform(0.2, 3, (90, 1)).astype(np.float32)
    rows = [(int(i), v[i].tolist(), 0) for i in range(90)] + [(100, v[7].tolist(), 0)] + ODD
    got = found(ann.nearest(frame(spark, [*rows, (None, v[0].tolist(), 0)]), lambda i: i % 20 == 0))
    want = nearest(rows, 20)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert all(s == pytest.approx(t) for q in want for (s, _), (t, _) in zip(got[q], want[q]))
    few = found(ann.nearest(frame(spark, rows[:5]), lambda i: i % 20 == 0))
    assert {q: len(x) for q, x in few.items()} == {0: 4}
    assert ann.nearest(frame(spark, ODD).limit(0), lambda i: i % 20 == 0).count() == 0


def test_recall_of_the_graph(spark, monkeypatch):
    """With parts far smaller than the table, so that rounds and walks have to find the rest."""
    monkeypatch.setattr(ann, "PART", 150)
    draw = np.random.default_rng(4)
    v = clustered(draw, 1500, 8, 1.0)
    rows = [(int(i), v[i].tolist(), 0) for i in range(1500)]
    got, want = found(ann.nearest(frame(spark, rows), lambda i: i % 20 == 0)), nearest(rows, 20)
    assert got.keys() == want.keys()
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 20 for q in want]) >= 0.95


def recall(spark, v, every):
    got = found(ann.nearest(frame(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)]), lambda i: i % every == 0))
    exact = v.astype(np.float64)
    shares = []
    for q in range(0, len(v), every):
        score = exact @ exact[q]
        score[q] = -np.inf
        shares.append(len({i for _, i in got[q]} & set(np.argsort(-score, kind="stable")[:20].tolist())) / 20)
    return np.mean(shares)


def test_recall_among_near_copies_beside_a_long_vector(spark, monkeypatch):
    """1,000 near copies, others of about their length, and one vector 30 times longer."""
    monkeypatch.setattr(ann, "PART", 300)
    draw = np.random.default_rng(5)
    v = draw.normal(size=(1501, 64))
    v[:1000] = v[0] / np.linalg.norm(v[0]) + 0.002 * draw.normal(size=(1000, 64))
    v[1000:] /= np.linalg.norm(v[1000:], axis=1)[:, None]
    v[1000:1500] *= 1 + 0.1 * draw.normal(size=(500, 1))
    v[1500] *= 30
    assert recall(spark, v[draw.permutation(1501)].astype(np.float32), 15) >= 0.9


@pytest.mark.parametrize("noise,longer", [(0.002, 1), (0.0002, 1), (0.002, 30), (0.0002, 30)])
def test_near_copies_keep_their_order(noise, longer):
    """The nearest by the rows that a walk scores with are the nearest."""
    draw = np.random.default_rng(6)
    one = draw.normal(size=64)
    v = one / np.linalg.norm(one) + noise * draw.normal(size=(1000, 64))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(v.tolist(), pa.list_(pa.float32()))], names=["id", "v"])
    most = max(longer, float(np.linalg.norm(v, axis=1).max()))
    (got,) = ann._prepare(most, 64)([batch])
    rows = ann._matrix(got.column("v"), 64)
    exact = v.astype(np.float64)
    shares = [len({*np.argsort(-(rows @ rows[q]))[:160]} & {*np.argsort(-(exact @ exact[q]))[:20]}) / 20 for q in range(0, 1000, 20)]
    assert np.mean(shares) >= 0.9


def test_rounds_go_on_until_the_graph_settles(spark, monkeypatch):
    """From two cuts into small parts, with which two rounds do not get far."""
    monkeypatch.setattr(ann, "PART", 40)
    monkeypatch.setattr(ann, "CUTS", 2)
    draw = np.random.default_rng(7)
    v = draw.normal(size=(2500, 12)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None] * np.float32(1.0001)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")
    lists = ann.graph(rows.mapInArrow(ann._prepare(1.0, 12), "id long, v binary"), 12, len(v)).collect()
    score = v @ v.T
    np.fill_diagonal(score, -4)
    best = np.argsort(-score, axis=1)[:, :10]
    shares = [np.isin(best[r["id"]], np.frombuffer(r["near"], np.int64)).mean() for r in lists]
    assert len(shares) == len(v) and np.mean(shares) >= 0.9


def test_recall_with_very_uneven_lengths(spark):
    """The longest vectors are the answer to nearly every query."""
    draw = np.random.default_rng(8)
    v = draw.normal(size=(6000, 32))
    v *= (draw.lognormal(sigma=0.5, size=6000) / np.linalg.norm(v, axis=1))[:, None]
    assert recall(spark, v.astype(np.float32), 20) >= 0.9


def test_copies_come_by_id(spark):
    """One vector held by a third of all rows: its copies are answers in the order of their ids."""
    draw = np.random.default_rng(9)
    v = draw.normal(size=(1500, 16)).astype(np.float32)
    v[draw.permutation(1500)[:500]] = v[0]
    assert recall(spark, v, 20) >= 0.9
    few = [(i, [1.0, 2.0], 0) for i in range(0, 100, 5)]
    got = found(ann.nearest(frame(spark, few), lambda i: i % 20 == 0, k=3))
    assert got == {q: [(-5.0, i) for i in [i for i in range(0, 100, 5) if i != q][:3]] for q in range(0, 100, 20)}
