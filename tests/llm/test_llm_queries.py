"""The registered queries on the smallest tables, by the contracts of their results."""

import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from banfleet.llm import queries
from banfleet.llm.workers import written
from tools.check import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    ok, note = compare(spark, duck(SF), SF, name)
    assert ok, note


def test_languages(spark, documents):
    got = {r["doc_id"]: r for r in run(spark, "op2_language")}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [i for i in documents if zlib.crc32(str(i).encode()) % 4 == 2]
    assert got.keys() == documents.keys() and all(got[i]["held_out"] == (i in held) for i in got)
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in held]) >= 0.95


def test_repeated_strings(spark, documents):
    got, seen = {r["doc_id"]: r for r in run(spark, "op3_suffix_dedup")}, set()
    assert got.keys() == documents.keys()
    for i in sorted(documents):
        raw = documents[i].encode()
        own, gone = [raw[k : k + 50] for k in range(len(raw) - 49)], bytearray(len(raw))
        for k, x in enumerate(own):
            if x in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        want = (len(raw), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(kept).hexdigest())
        assert tuple(got[i])[1:] == want


def test_token_counts(spark, documents):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in run(spark, "op4_token_counts"):
        text = documents[r["doc_id"]]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert tuple(r)[1:] == (len(text.encode()), n, n > 1024)


def test_packing(spark, documents):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows, pieces = run(spark, "op5_packing"), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert pieces.keys() == documents.keys()
    for i, own in pieces.items():
        ids = np.array([*library.encode(documents[i], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    filled = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 4096 and len(filled) <= 1.05 * sum(filled.values()) / 4096 + 2


def test_nearest(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in sorted(run(spark, "op6_ann"), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(float(rows[r["query_id"]] @ rows[r["vec_id"]]), abs=1e-12)
    want = {q: sorted((-float(x @ y), i) for i, y in rows.items() if i != q)[:20] for q, x in rows.items() if q % 20 == 0}
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & {i for _, i in want[q]}) / 20 for q in want]) >= 0.9


def test_byte_bpe(spark, documents):
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=queries.byte_bpe.read_ranks(path), special_tokens={})
    for r in run(spark, "op8_byte_bpe"):
        ids = library.encode_ordinary(documents[r["doc_id"]])
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert tuple(r)[1:] == (len(ids), digest, hashlib.sha256(documents[r["doc_id"]].encode()).hexdigest())


def test_quality(spark, documents):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in run(spark, "op10_quality")}
    assert got.keys() == documents.keys() and all(r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert np.mean([got[i]["predicted"] == label[i] for i in label if got[i]["held_out"]]) >= 0.9


def test_pipeline_stages_follow_their_rules(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, kept, SF), name)
        assert after.columns == docs.columns
        seen.append({r["doc_id"]: r["text"] for r in after.collect()})
        kept = after
    known, good, single, short = seen
    lang = {r["doc_id"]: r["lang_pred"] for r in run(spark, "op2_language")}
    assert {i for i in documents if lang[i] == "und"} == documents.keys() - known.keys()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([label[i] == 1 for i in known.keys() & label.keys() - good.keys()]) < 0.05
    assert np.mean([i in good for i in label if label[i] and i in known]) > 0.98

    def runs(text):
        w = text.split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: runs(t) for i, t in good.items()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for a, b in {(a, b) for own in holders.values() for a in own for b in own if a < b}:
        common = len(sets[a] & sets[b])
        if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
            up[max(root(a), root(b))] = min(root(a), root(b))
    assert single.keys() == {i for i in sets if root(i) == i}
    assert short.keys() == single.keys()
    strings = set()
    for i in sorted(single):
        raw = single[i].encode()
        own = {raw[k : k + 50] for k in range(len(raw) - 49)}
        assert (short[i] == single[i]) == (not own & strings)
        strings |= own
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == short.keys()
    assert packed.count() == entry.queries()["pipeline"](spark, SF).count()
