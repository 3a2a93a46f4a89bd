"""Language identification by bit-sliced Bloom filters of byte n-grams.

One table holds the filters of all languages: each slot is a mask with a bit per language, and the
AND of an n-gram's slots gives every language that contains it. A text's n-grams are counted per
language bit; the counts are corrected for the false positives that each language's filter gives,
and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banfleet.llm.textbytes import LOWER, chunks, per_text
from banfleet.llm.workers import forget

#: Slots of the table: a fixed size, whatever the corpus. A fuller table has more false
#: positives, which the correction takes off.
SLOTS = 1 << 20
#: Odd multipliers, one per hash function.
HASHES = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
#: A language holds an n-gram if its rate there is at least this share of the highest rate.
SHARE = 0.1
#: Occurrences in a language below which an n-gram isn't learned.
LEAST = 3

_FOLD = LOWER.copy()
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


class Filters(NamedTuple):
    langs: list[str]
    table: np.ndarray  # a row per 8 languages, a column per slot
    false_rate: np.ndarray  # per language
    prior: int  # the language with the most texts


def grams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All 4-byte windows of the folded texts, and where each text's begin.

    Letters are lower-cased, other ASCII becomes space, and a space is put before and after each
    text. Windows whose two middle bytes aren't both within a word are left out.
    """
    texts = len(starts) - 1
    at = np.arange(texts)
    padded = np.full(len(data) + 2 * texts, 32, np.uint32)
    padded[np.arange(len(data)) + np.repeat(2 * at + 1, np.diff(starts))] = _FOLD[data]
    if len(padded) < 4:
        return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
    window = padded[:-3] | padded[1:-2] << 8 | padded[2:-1] << 16 | padded[3:] << 24
    inside = padded != 32
    keep = inside[1:-2] & inside[2:-1]
    counts = np.concatenate(([0], np.cumsum(keep)))
    # the two middle bytes never reach over the spaces between texts
    return window[keep], counts[np.minimum(starts + 2 * np.arange(texts + 1), len(keep))]


def slots(gram: np.ndarray, multiplier: int) -> np.ndarray:
    return (gram * np.uint32(multiplier)) >> np.uint32(32 - SLOTS.bit_length() + 1)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        names, codes = lang.dictionary.to_pylist(), lang.indices.to_numpy()
        for c in chunks(batch.column("text")):
            gram, starts = grams(c.data, c.starts)
            own = np.repeat(codes[c.first : c.first + len(starts) - 1], np.diff(starts))
            for i in np.unique(own):
                parts = found.setdefault(names[i], [])
                parts.append(np.unique(gram[own == i], return_counts=True))
                if len(parts) > 16:
                    parts[:] = [merged(parts)]
    for name, parts in found.items():
        keys, n = merged(parts)
        for a in range(0, len(keys), 50_000):
            columns = [pa.array([name] * len(keys[a : a + 50_000])), pa.array(keys[a : a + 50_000].astype(np.int64)), pa.array(n[a : a + 50_000])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gram = batch.column("gram").to_numpy().astype(np.uint32)
        for m in HASHES:
            slot = pa.array(slots(gram, m).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), slot], names=["lang", "slot"])


def learn(docs: DataFrame, lang: Column, text: Column) -> Filters:
    """Filters from all rows whose language isn't null.

    n-grams are counted in the tasks, and the counts shuffled. The driver gets one row per
    slot that is set, so at most :data:`SLOTS` a group of 8 languages, however large the corpus.
    """
    rows = docs.select(lang.cast("string").alias("lang"), text.alias("text")).where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Filters([], np.zeros((0, SLOTS), np.uint8), np.zeros(0), -1)
    counts = rows.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.where(F.col("n") >= LEAST).join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    by_gram = rated.groupBy("gram").agg(
        F.max("rate").alias("most"), F.collect_list(F.struct("lang", "rate")).alias("of")
    )
    held = by_gram.select("gram", "most", F.explode("of").alias("x")).where(F.col("x.rate") >= SHARE * F.col("most"))
    bits = held.select("gram", F.col("x.lang").alias("lang")).mapInArrow(_slots_of, "lang string, slot int")
    number = F.create_map(*[x for i, name in enumerate(langs) for x in (F.lit(name), F.lit(i))])
    set_ = (
        bits.select("slot", number[F.col("lang")].alias("i"))
        .groupBy((F.col("i") / 8).cast("int").alias("part"), "slot")
        .agg(F.expr("bit_or(shiftleft(1, i % 8))").alias("mask"))
        .toArrow()
    )
    table = np.zeros((-(-len(langs) // 8), SLOTS), np.uint8)
    table[set_["part"].to_numpy(), set_["slot"].to_numpy()] = set_["mask"].to_numpy()
    fill = np.array([np.mean(table[i // 8] >> (i % 8) & 1) for i in range(len(langs))])
    return Filters(langs, table, fill ** len(HASHES), langs.index(max(langs, key=lambda x: (sizes[x], x))))


def shares(filters: Filters, gram: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Corrected share of each text's n-grams that each language holds."""
    n = np.diff(starts)
    out = np.zeros((len(n), len(filters.langs)))
    places = [slots(gram, m) for m in HASHES]
    for part, row in enumerate(filters.table):
        mask = row[places[0]]
        for place in places[1:]:
            mask &= row[place]
        for i in range(8 * part, min(8 * part + 8, len(filters.langs))):
            out[:, i] = per_text(mask >> (i % 8) & 1, starts)
    wrong = filters.false_rate
    return (out - n[:, None] * wrong) / (np.maximum(n, 1)[:, None] * np.maximum(1 - wrong, 1e-9))


def identify(filters: Filters, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of each text's language (past the last: none) and its score."""
    lang, score = np.full(len(column), len(filters.langs)), np.zeros(len(column))
    for c in chunks(column) if filters.langs else ():
        rows = slice(c.first, c.first + len(c.starts) - 1)
        share = shares(filters, *grams(c.data, c.starts))
        best = share.argmax(1)
        top = share[np.arange(len(best)), best]
        best[top <= 0] = filters.prior
        folded = _FOLD[c.data]
        letters = per_text((folded != 32) & (folded < 128), c.starts)
        for i in np.flatnonzero(letters == 0):
            if not any(map(str.isalpha, column[c.first + int(i)].as_py() or "")):
                best[i], top[i] = len(filters.langs), 0
        lang[rows], score[rows] = best, np.clip(top, 0, 1)
    return lang, score


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``lang_pred`` and ``score`` (0 to 1).

    The score is the corrected share of the text's n-grams that the language holds. A null text and
    one without a letter are ``und`` with score 0; a text without a known n-gram gets the
    language with the most learned texts and score 0, and equal shares the first by name. Nothing learned
    gives ``und`` everywhere. Repeated rows and null ids stay; other columns are not read; an empty table gives
    no rows. The table of filters is broadcast; its size is fixed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(filters))
    names = [*filters.langs, "und"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filters(*shared.value)
        for batch in batches:
            lang, score = identify(f, batch.column("text"))
            found = pa.DictionaryArray.from_arrays(pa.array(lang), pa.array(names)).dictionary_decode()
            yield pa.RecordBatch.from_arrays([batch.column("id"), found, pa.array(score)], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, filters: Filters, least: float, text_col: str = "text") -> DataFrame:
    """Whole rows whose text has a language with at least that score; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(filters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        f = Filters(*shared.value)
        for batch in batches:
            lang, score = identify(f, batch.column(text_col))
            yield batch.filter(pa.array((lang < len(f.langs)) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: a quarter of all ids, null included in none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
