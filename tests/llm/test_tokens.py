"""Tokenizers, packing and the token cache against the libraries themselves."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from banfleet.llm import byte_bpe, packing, token_counts
from banfleet.llm.pieces import Pieces

PARTS = [
    "a", "b", " ", "  ", "   ", "\n", "\n\n", "'s", "'", "1", "é", "é", "²", "日本", "Ᲊ", "\U0001e6c0", "!", "...", "\t",
    "<|endoftext|>", "<|startoftext|>", "\x1c", "aaaaaaa", "the", " of", "\r\n", "🙂", "Σ", "ΑΣ", "İ", "word.\nWord", "x###",
]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    made = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    made += ["".join(chr(draw.choice([draw.randint(1, 300), draw.randint(1, 0xD7FF)])) for _ in range(20)) for _ in range(3000)]
    return [*made, "", "a" * 3000, " " * 3000, "ab" * 2000, "\n" * 50]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_are_the_librarys_ids(texts, name):
    with open(P.path(name), "rb") as f:
        pieces = Pieces(f.read(), most=500)
    library = Tokenizer.from_file(P.path(name))
    for at in range(0, len(texts), 700):
        some = texts[at : at + 700]
        want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        assert [x.tolist() for x in pieces.ids(some)] == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_byte_bpe_is_the_librarys(texts, name):
    tables = byte_bpe.read_tables(P.path(name))
    own = byte_bpe.Encoder(tables, P.PATTERN, most=500)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tables.ranks, special_tokens={})
    for x in texts:
        assert np.frombuffer(own.encode(x), np.int32).tolist() == library.encode_ordinary(x)


@pytest.fixture(scope="module")
def spaced():
    """Runs of white space of several kinds, between words and at the ends."""
    draw = random.Random(8)
    kinds = [" ", "\u00a0", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\u2009", "\u2028", "\u3000", "\u200b"]
    made = ["a" + x + "b" for x in (" \u00a0 \u00a0 ", " " + "\u00a0 " * 8, "\n \n", "\t \t", " \u00a0 \u00a0", "\n\t\t", "\n\t\t\t")]
    for _ in range(4000):
        some = draw.sample(kinds, 2)
        made.append("".join("".join(draw.choice(some) for _ in range(draw.randint(0, 9))) + draw.choice(["a", "the", "x.", "1", "é"]) for _ in range(4)))
    return [*made, *(x + " \u00a0 " for x in made[:50])]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_with_other_white_space(spaced, name):
    with open(P.path(name), "rb") as f:
        pieces = Pieces(f.read())
    want = [e.ids for e in Tokenizer.from_file(P.path(name)).encode_batch(spaced, add_special_tokens=False)]
    assert [x.tolist() for x in pieces.ids(spaced)] == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_byte_bpe_with_other_white_space(spaced, name):
    tables = byte_bpe.read_tables(P.path(name))
    own = byte_bpe.Encoder(tables, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tables.ranks, special_tokens={})
    assert [np.frombuffer(own.encode(x), np.int32).tolist() for x in spaced] == [library.encode_ordinary(x) for x in spaced]


ROWS = [(1, "one two. one", 9), (2, None, 9), (3, "", 9), (3, "", 9), (None, "one two. one", 9), (4, "long " * 9000, 9), (5, "one two. one", 9)]
SCHEMA = "doc_id long, text string, n_tokens int"


def test_encode_and_decode(spark):
    ranks = P.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = byte_bpe.decode(byte_bpe.encode(docs, ranks, P.PATTERN), ranks).collect()
    assert sorted((r["doc_id"] or -1, bytes(r["decoded"]).decode()) for r in got) == sorted((i or -1, t or "") for i, t, _ in ROWS)
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), ranks, P.PATTERN), ranks).count() == 0


@pytest.mark.parametrize("pattern", [r"[\s\S]{1,40}", r"\w+|[^\w]+", r"\S+"])
def test_other_patterns_match_whole_texts(spark, pattern):
    ranks = P.path("byte_bpe_50k.tiktoken")
    texts = ["some words, and more  of them " * 5, "a \u00a0 \u00a0 b", " é ", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(ranks), special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(docs, ranks, pattern).collect()}
    assert [got[i] for i in range(len(texts))] == [library.encode_ordinary(x) for x in texts]


def test_counts_come_from_the_cache(spark, folder):
    path = P.path("byte_bpe_50k.json")
    docs = spark.createDataFrame(ROWS, SCHEMA)
    library = Tokenizer.from_file(path)
    want = sorted((i or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ROWS)

    def counted(df):
        return sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df, path, folder).collect())

    assert counted(docs) == want
    _, version = token_counts.version_of(path)
    kept = spark.read.parquet(f"{folder}/tokenizer={version}")
    assert kept.count() == 3  # distinct texts
    assert counted(docs.limit(0)) == []
    # what is stored is taken from there
    text = "a text that isn't there yet"
    digest = hashlib.sha256(text.encode()).hexdigest()
    spark.createDataFrame([(digest, 777)] * 2, "digest string, n_tokens long").write.mode("append").parquet(f"{folder}/tokenizer={version}")
    assert counted(spark.createDataFrame([(8, text, 0), (1, "one two. one", 0)], SCHEMA)) == [(1, 12, want[0][2]), (8, len(text), 777)]


def test_difference_balances():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]
    draw = random.Random(1)
    sizes = [draw.randint(1, 100) for _ in range(400)]
    sums = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 9)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 2


def test_windows_rise_until_all_fit():
    found = packing.pack([60] * 7, 100)
    assert len(found) == 7
    assert packing.pack([], 100) == []
    assert sorted(i for w in packing.pack([100, 100, 1], 100) for i in w) == [0, 1, 2]


def test_packing_holds_every_id_once(spark):
    path = P.path("word_bpe_49k.json")
    docs = spark.createDataFrame([*ROWS, *((100 + i, "some words here " * (i * 7 % 90), 0) for i in range(300))], SCHEMA)
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, end_id=2, capacity=512, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for i, text, _ in docs.collect():
        want = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[i], key=lambda r: r["start"])
        if i != 3:  # 3 is there twice
            assert [x for r in own for x in r["ids"]] == want and {r["doc_tokens"] for r in own} == {len(want)}
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert sum(r["length"] for r in own) <= 512
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) * 512 <= 1.05 * total + 512
    assert packing.pack_documents(docs.limit(0), path, 2).count() == 0
