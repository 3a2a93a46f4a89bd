"""Text operators against brute force, and what they do with odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from banfleet.llm import langid, ngram_join, quality, suffix_dedup
from banfleet.llm.textbytes import chunks, span_hashes, words

SCHEMA = "doc_id long, text string, lang string, id int, n int, score int, data int, component int"


def frame(spark, rows, lang="en"):
    """Documents with further columns named like those used inside."""
    return spark.createDataFrame([(i, t, lang if isinstance(lang, str) else lang(i), 1, 2, 3, 4, 5) for i, t in rows], SCHEMA)


def prose(draw, n, words_=None):
    return " ".join(draw.choice(words_ or "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy".split()) + str(draw.randint(0, 400)) for _ in range(n))


def test_words_and_hashes():
    texts = ["", "one  two\nthree", " x ", None, "one", "é one\t"]
    for c in chunks(pa.array(texts), 5):
        w = words(c.data, c.starts)
        got = [bytes(c.data[a:b]).decode() for a, b in zip(w.begin, w.end)]
        own = [x or "" for x in texts[c.first : c.first + len(c.starts) - 1]]
        assert got == [x for t in own for x in t.split()]
        assert np.diff(w.starts).tolist() == [len(t.split()) for t in own]
        assert (w.hashes == [span_hashes(np.frombuffer(b"zz" + x.encode(), np.uint8), np.array([2]), np.array([2 + len(x.encode())]))[0] for x in got]).all()


def test_hashes_of_long_spans():
    draw = np.random.default_rng(4)
    long, short = draw.integers(0, 256, 3_000_000, dtype=np.uint8), draw.integers(0, 256, 500, dtype=np.uint8)
    other = long.copy()
    other[2_500_000] ^= 1
    parts = [short, long, short, other, long]
    end = np.cumsum([len(x) for x in parts])
    h = span_hashes(np.concatenate(parts), end - [len(x) for x in parts], end)
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3
    assert h[0] == span_hashes(short, np.array([0]), np.array([500]))[0]
    assert h[1] == span_hashes(long, np.array([0]), np.array([len(long)]))[0]


# -- language ----------------------------------------------------------------------------------

LANGS = {"xx": "tala miro veno saku deli", "yy": "brish thwock gronk spelt fjord", "zz": "öder ßüül äähm ñoño çaça"}


@pytest.fixture(scope="module")
def spoken(spark):
    draw = random.Random(4)
    rows = []
    for i in range(400):
        lang = draw.choice(list(LANGS))
        rows.append((i, "".join(draw.choice(LANGS[lang].split()) + draw.choice(" -") for _ in range(draw.randint(3, 60))), lang))
    return rows


def test_languages_are_told_apart(spark, spoken):
    docs = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    filters = langid.learn(docs.where(~langid.held_out()), F.col("lang"), F.col("text"))
    assert filters.langs == ["xx", "yy", "zz"]
    got = {r["doc_id"]: r for r in langid.predict(docs, filters).collect()}
    held = [i for i, _, _ in spoken if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 60 and all(got[i]["lang_pred"] == spoken[i][2] and got[i]["score"] > 0.9 for i in held)


def plain_grams(text):
    b = b" " + text.encode() + b" "
    b = bytes(x + 32 if 65 <= x < 91 else x if x > 127 or chr(x).isalpha() else 32 for x in b)
    return [b[k : k + 4] for k in range(len(b) - 3) if 32 not in b[k + 1 : k + 3]]


def test_languages_by_plain_sets(spark, spoken):
    """The same counting with a set per language instead of filters."""
    docs = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    filters = langid.learn(docs.where(~langid.held_out()), F.col("lang"), F.col("text"))
    counts = {x: Counter() for x in LANGS}
    for i, text, lang in spoken:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(plain_grams(text))
    rate = {x: {g: n / sum(c.values()) for g, n in c.items() if n >= langid.LEAST} for x, c in counts.items()}
    most = {g: max(r.get(g, 0) for r in rate.values()) for r in rate.values() for g in r}
    sets = {x: {g for g, v in r.items() if v >= langid.SHARE * most[g]} for x, r in rate.items()}
    got = {r["doc_id"]: r for r in langid.predict(docs, filters).collect()}
    for i, text, _ in spoken:
        own = plain_grams(text)
        share = {x: sum(g in known for g in own) / len(own) for x, known in sets.items()}
        best = max(sorted(share), key=share.get)
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(share[best], abs=0.01)


def test_odd_texts_have_a_language_or_none(spark, spoken):
    docs = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    filters = langid.learn(docs, F.col("lang"), F.col("text"))
    odd = frame(spark, [(1, None), (2, ""), (3, "12 %%"), (None, "tala miro"), (5, "q"), (5, "q"), (6, "tala " * 30000), (7, "日"), (8, "²½")])
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 2)) for r in langid.predict(odd, filters).collect()]
    und = {i for i, lang, _ in got if lang == "und"}
    assert und == {1, 2, 3, 8} and len(got) == 9
    assert {lang for i, lang, _ in got if i in (None, 6)} == {"xx"}
    assert all(lang in LANGS for i, lang, _ in got if i in (5, 7))
    assert langid.predict(odd.limit(0), filters).count() == 0
    none = langid.learn(odd.limit(0), F.col("lang"), F.col("text"))
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}
    kept = langid.keep_known(odd, filters, 0.1)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {None, 6}


def test_corrected_shares_are_unbiased():
    """False positives of a full table are taken off again."""
    draw = np.random.default_rng(1)
    table = (draw.random((1, langid.SLOTS)) < 0.6).astype(np.uint8)
    fill = table.mean() ** len(langid.HASHES)
    filters = langid.Filters(["a"], table, np.array([fill]), 0)
    gram = draw.integers(0, 1 << 32, 200_000, dtype=np.uint32)
    share = langid.shares(filters, gram, np.array([0, len(gram)]))[0, 0]
    assert fill > 0.2 and abs(share) < 0.01


# -- quality -----------------------------------------------------------------------------------


def test_quality_learns_rules(spark):
    draw = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = prose(draw, draw.randint(5, 80))
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text))
        labels.append((i, int(not bad), 0))
    docs = frame(spark, [*rows, (900, None), (901, ""), (None, "abc"), (902, "x " * 40000)])
    known = spark.createDataFrame([*labels, (0, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.score_documents(docs, known, ~langid.held_out())
    got = {r["doc_id"]: r for r in found.collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["predicted"] == labels[i][1] for i in held)
    assert len(got) == 304 and all(0 <= r["score"] <= 1 for r in got.values())
    kept = quality.keep_good(docs, quality.learn(docs, known), 0.5)
    assert kept.columns == docs.columns and {i for i, q, _ in labels if q} <= {r["doc_id"] for r in kept.collect()}
    none = quality.score_documents(docs, known.limit(0), F.lit(True))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), known, F.lit(True)).count() == 0


def test_scores_by_plain_rules(spark):
    """The fitted rules, evaluated one by one in Python, give the scores of the column expression."""
    draw = random.Random(8)
    rows = [(i, t if i % 4 else t.upper() + "!!" * draw.randint(0, 9)) for i in range(200) for t in [prose(draw, draw.randint(1, 60))]]
    docs = frame(spark, [*rows, (200, ""), (201, None)])
    model = quality.learn(docs, spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id long, quality int"))
    assert model.rules
    found = quality.statistics(docs)
    for r in found.select("*", model.score().alias("score_")).collect():
        total = model.base
        for weight, rule in model.rules:
            if all(r[name] <= at if upper else r[name] > at for name, upper, at in rule):
                total += weight
        assert r["score_"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)


def test_statistics_by_hand():
    text = "Ab ab ab cd!!\nxx\nxx"
    data = np.frombuffer(text.encode(), np.uint8)
    got = dict(zip(quality.STATISTICS, quality.statistics_of(data, np.array([0, len(data)]))[0]))
    want = {"word_bytes": 14 / 6, "upper": 1 / 12, "exclaims": 2 / 19, "newlines": 2 / 19, "repeats": 2 / 6, "distinct": 4 / 6, "repeated_lines": 1 / 3}
    assert {k: got[k] for k in want} == pytest.approx(want)


# -- repeated strings --------------------------------------------------------------------------


def removed(rows):
    """Brute force: (id, kept bytes, runs) in the order of the rows."""
    out, least = [], {}
    for i, t in rows:
        least[i] = min(least.get(i, 1 << 32), zlib.crc32((t or "").encode()))
    for i, t in rows:
        b = (t or "").encode()
        part = [(j, u) for j, u in rows if j is not None and zlib.crc32((u or "").encode()) == least[j]]
        seen = {x[k : k + 50] for j, u in part if (i, t) in part and j < i for x in [(u or "").encode()] for k in range(len(x) - 49)}
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
        out.append((i, bytes(x for x, g in zip(b, gone) if not g), (b"\0" + bytes(gone)).count(b"\0\1")))
    return out


def test_suffix_arrays_by_brute_force():
    draw = random.Random(1)
    for k in range(120):
        text = bytes(draw.choice(b"ab" if k % 3 else b"abc\x00\xff") for _ in range(draw.randint(1, 400)))
        if k % 5 == 0:
            text = text[:10] * 20
        order = suffix_dedup.suffix_array(np.frombuffer(text, np.uint8))
        assert sorted(order.tolist()) == list(range(len(text)))
        assert all(text[a : a + 50] <= text[b : b + 50] for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("common", [20_000, 3])
def test_repeats_by_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    monkeypatch.setattr(suffix_dedup, "FLUSH", 500)
    monkeypatch.setattr(suffix_dedup, "FLUSH_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "WINDOW", 150)
    draw = random.Random(6)
    shared = [prose(draw, n) for n in (8, 12, 30)]
    rows = [(i, " ".join(draw.choice([*shared, prose(draw, 9), "é" * 30, "a" * 70]) for _ in range(draw.randint(1, 6)))) for i in range(60)]
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, None), (63, ""), (64, "x" * 49), (65, "x" * 50), (66, "y" * 4000), (67, "y" * 3000), (-5, shared[1])]
    rows += [(None, shared[0]), (20, shared[2] + " of another row")]
    got = suffix_dedup.remove_repeats(frame(spark, rows).repartition(5)).collect()
    want = removed(rows)
    assert sorted((r["doc_id"] or 0, bytes(r["kept"]), len(r["spans"])) for r in got) == sorted((i or 0, k, n) for i, k, n in want)
    assert all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) == r["n_bytes"] - len(r["kept"]) for r in got)


def test_equal_hashes_of_unlike_surroundings(monkeypatch):
    """Surroundings whose hashes agree are still compared byte by byte."""
    monkeypatch.setattr(suffix_dedup, "span_hashes", lambda data, begin, end: np.zeros(len(begin), np.uint64))
    texts = [b"a" * 60, b"b" * 60, b"a" * 60, b"a" * 61]
    place = np.zeros(4, suffix_dedup._PLACE)
    place["id"], place["fp"], place["size"] = [1, 2, 3, 4], 7, [len(x) for x in texts]
    end = np.cumsum(place["size"].astype(np.int64))
    again, twin, single = suffix_dedup._alone(place, b"".join(texts), end - place["size"], end)
    assert again.tolist() == [False, False, True, False] and twin.tolist() == [0, 1, 0, 3] and not single.any()


def test_a_line_that_its_document_repeats(spark):
    """A smaller document holds it in another context, or a part of it: all copies go, not only the first."""
    draw = random.Random(9)
    rows = []
    for k in range(0, 60, 3):
        line = "".join(draw.choice("abcdefgh ") for _ in range(draw.randint(60, 200)))
        part = line[draw.randint(0, 8) :] if k % 2 else line
        rows += [(k, f"before {k} {part} after {k}"), (k + 1, "\n".join([line] * 3)), (k + 2, f"{line}\n{k}\n" * 4)]
    got = suffix_dedup.remove_repeats(frame(spark, rows).repartition(3)).collect()
    assert sorted((r["doc_id"], bytes(r["kept"]), len(r["spans"])) for r in got) == sorted(removed(rows))


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(frame(spark, []).limit(0)).count() == 0
    whole = suffix_dedup.remove_repeats(frame(spark, [(1, "é" * 40), (2, "é" * 40 + "x")]), whole_rows=True)
    assert [(r["doc_id"], r["kept_text"], r["rest"]["score"]) for r in whole.orderBy("doc_id").collect()] == [(1, "é" * 40, 3), (2, "x", 3)]


# -- near duplicates ---------------------------------------------------------------------------


def linked(rows, size=5, threshold=0.8):
    """Brute force: {id: (class, links)}."""
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        if i is not None:
            sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    up, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common >= threshold * len(sets[a] | sets[b]):
                links[a], links[b] = links[a] + 1, links[b] + 1
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (root(i), links[i]) for i in sets}


@pytest.mark.parametrize("block", [512, 6])
def test_near_duplicates_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    draw = random.Random(7)
    rows = [(i, prose(draw, draw.randint(1, 60))) for i in range(40)]
    for i in range(40, 140):
        base = draw.choice(rows[:12])[1].split()
        for _ in range(draw.randint(0, 2)):
            base[draw.randrange(len(base))] = "changed" + str(draw.randint(0, 3))
        rows.append((i, " ".join(base)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a b"), (204, "a  b"), (205, "a"), (206, "w " * 30000), (-3, rows[0][1])]
    odd = [(None, rows[1][1]), (203, "a b")]
    got = ngram_join.near_duplicates(frame(spark, [*rows, *odd])).collect()
    assert len(got) == len(rows) + 2
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got if r["doc_id"] is not None} == linked(rows)
    assert [(r["class_id"], r["n_links"]) for r in got if r["doc_id"] is None] == [(None, 0)]
    assert ngram_join.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_near_duplicates_meet_beside_an_unlike_hub(spark):
    """In each band that two near duplicates share the least id is a document unlike both."""
    draw = random.Random(12)

    def drawn(some):
        w = words(np.frombuffer(" ".join(some).encode(), np.uint8), np.array([0, len(" ".join(some))]))
        h, starts = ngram_join.shingles(w, 5)
        return ngram_join.signatures(h, starts)[0].reshape(ngram_join.BANDS, ngram_join.ROWS)

    one = [f"w{i}" for i in range(150)]
    two = [*one[:144], *(f"v{i}" for i in range(6))]
    two[20], two[70] = "x", "y"
    shared = np.flatnonzero((drawn(one) == drawn(two)).all(1))
    assert 0 < len(shared) < ngram_join.BANDS
    runs = [one[i : i + 5] for i in range(146)]
    alone = np.array([drawn(r).ravel() for r in runs]).reshape(len(runs), ngram_join.BANDS, ngram_join.ROWS)
    rows = [(1000, " ".join(one)), (1001, " ".join(two))]
    for band in shared.tolist():
        least = sorted(set(alone[:, band].argmin(0).tolist()))
        for k in range(1000):
            draw.shuffle(least)
            hub = [w for i in least for w in [*runs[i], f"h{band}.{k}.{i}"]]
            if (drawn(hub)[band] == drawn(one)[band]).all():
                break
        rows.append((band, " ".join(hub)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(frame(spark, rows)).collect()}
    assert got[1000] == got[1001] == (1000, 1)
    assert got == linked(rows)


def test_pruning_follows_the_posterior():
    steps = ngram_join.least_matches(0.8, 1e-6)
    draw = np.random.default_rng(3)
    for n, least in steps:
        assert (draw.binomial(n, 0.8, 200_000) < least).mean() < 1e-4
        assert least > 0.4 * n
