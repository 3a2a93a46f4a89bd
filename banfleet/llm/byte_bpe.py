"""Byte-level BPE encoding and decoding by the ranks of a vocabulary file.

Bytes are mapped to Latin-1 so that one pass of an Aho-Corasick automaton finds every vocabulary
entry in a word. The encoder takes the longest match, and steps back when two adjacent tokens
could not stand side by side after the merges; those answers are kept. Each position is given up
at most once, so the time is linear in the length of a word, however long.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import filterfalse
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banfleet.llm.pieces import cut_at_spaces
from banfleet.llm.workers import text_chunks, worker_cache


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Tables:
    """What the encoder needs of a vocabulary; made on the driver, bounded by its size."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for n in range(len(token) - 1, 0, -1):
                if (r := ranks.get(token[:n])) is not None:
                    self.shorter[rank] = r
                    break
            parts = self._merged(token) if len(token) > 1 else [rank]
            if len(parts) == 2:
                self.pairs[parts[0], parts[1]] = rank
                self.split[rank] = (parts[0], parts[1])
            else:
                self.split[rank] = (rank, rank)

    def _merged(self, token: bytes) -> list[int]:
        """The token's bytes after all merges of lower rank."""
        parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 1:
            best = min((self.pairs.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts


class Encoder:
    """Words (matches of the pattern) to ids; with ``whole``, the pattern is one that cuts at spaces could change."""

    def __init__(self, tables: Tables, pattern: str, most: int = 250_000, whole: bool = False):
        import ahocorasick
        import regex

        self.t, self.find, self.most, self.whole = tables, regex.compile(pattern).findall, most, whole
        self.automaton = ahocorasick.Automaton()
        for token, rank in tables.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges could leave ``a`` and ``b`` side by side."""
        known = self.fits.get((a, b))
        if known is None:
            known = self.fits[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        pairs, split, limit = self.t.pairs, self.t.split, 1 << 60
        while True:
            if pairs.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        return True

    def word(self, word: bytes) -> list[int]:
        whole = self.t.ranks.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        longest = [0] * n
        for end, (size, rank) in self.automaton.iter(word.decode("latin-1")):
            longest[end + 1 - size] = rank  # later ends are longer
        open_, bytes_of, shorter = bytearray(b"\1") * (n + 1), self.t.bytes_of, self.t.shorter
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else None
            while True:
                end = at + len(bytes_of[token])
                if open_[end] and (last is None or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else None
                    break
                if (less := shorter.get(token)) is not None:
                    token = less
                    continue
                open_[at] = 0
                out.pop()
                at -= len(bytes_of[last])
                token = last
                break
        return out

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece as bytes, 32 bits each."""
        out = []
        for word in self.matches(piece):
            ids = self.words.get(word)
            if ids is None:
                ids = self.words[word] = array("i", self.word(word.encode())).tobytes()
            out.append(ids)
        return b"".join(out)

    def matches(self, piece: str) -> list[str]:
        """Matches of the pattern, with letters and digits as the reference library knows them."""
        if piece.isascii() or not any(_newer(c) for c in piece):
            return self.find(piece)
        found, at, out = self.find("".join("\uffff" if _newer(c) else c for c in piece)), 0, []
        for x in found:
            out.append(piece[at : at + len(x)])
            at += len(x)
        return out

    def encode(self, text: str) -> bytes:
        """A text is cut at spaces that follow no white space, which start a match wherever they stand."""
        for memo in (self.inner, self.words):
            if len(memo) > self.most:
                memo.clear()
        head, rest = (text, []) if self.whole else cut_at_spaces(text)
        inner = self.inner
        for x in filterfalse(inner.__contains__, set(rest)):
            inner[x] = self._piece(" " + x)
        return self._piece(head) + b"".join(map(inner.__getitem__, rest))


#: Letters and digits of Unicode 16, first and last code points. The reference library
#: knows them; Python's own database does not yet, and the pattern module knows later ones too.
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0),
    (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)


def _newer(c: str) -> bool:
    """Not yet assigned as far as the reference library knows."""
    if c < "\u0558" or unicodedata.category(c) != "Cn":
        return False
    return not any(a <= ord(c) <= b for a, b in UNICODE_16)


def read_tables(path: str) -> Tables:
    return Tables(read_ranks(path))


def encode(
    docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id and ``ids`` (array of int), without special tokens.

    What the pattern doesn't match has no ids. Texts are cut at spaces for the pattern of
    :mod:`public_tokenizers` only, which never reaches over one; by other patterns they are matched whole.
    Null text is empty and has no ids. Ids may be null or repeat; other columns are not read. The
    vocabulary's tables are broadcast: their size is that of the vocabulary, not of the data.
    """
    import public_tokenizers  # on the driver only

    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(vars(read_tables(ranks)))
    key, whole = ("byte_bpe", ranks, pattern), pattern != public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(key, lambda: Encoder(SimpleNamespace(**tables.value), pattern, whole=whole))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            for chunk in text_chunks(((x or "", len(x or "")) for x in texts), 4 << 20):
                found = [encoder.encode(x) for x in chunk]
                ends = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in found], out=ends[1:])
                flat = np.frombuffer(b"".join(found), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(chunk)), ids], names=["id", "ids"])
                at += len(chunk)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, ``ids`` and ``decoded`` (binary). Null ids give no bytes."""
    spark = tokens.sparkSession
    vocabulary = read_ranks(ranks)
    table: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
    for token, rank in vocabulary.items():
        table[rank] = token
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = shared.value.__getitem__
        for batch in batches:
            ids = batch.column("ids")
            flat, ends = ids.flatten().to_numpy(), np.append(0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy()))
            texts = [b"".join(map(look, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), ids, pa.array(texts, pa.binary())], names=["id", "ids", "decoded"]
            )

    kind = tokens.schema[id_col].dataType.simpleString()
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    schema = f"id {kind}, ids array<int>, decoded binary"
    return rows.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "ids": ids_col})
