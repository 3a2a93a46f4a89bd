"""Quality scores by a sparse ensemble of rules over text statistics.

Trees are grown on labelled rows; every path from a root is a rule, a conjunction of bounds on
statistics. A lasso logistic model weighs the rules, drops most, and what is left is compiled
into one column expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banfleet.llm.textbytes import chunks, per_text, span_hashes, words
from banfleet.llm.workers import discard, written

STATISTICS = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "exclaims", "spaces", "newlines", "short_words",
    "repeats", "distinct", "repeated_lines",
)

_PLAIN = b".,;:'\"-?()"
_CLASS = {
    "upper": np.array([65 <= i < 91 for i in range(256)]),
    "letters": np.array([chr(i).isalpha() if i < 128 else True for i in range(256)]),
    "digits": np.array([48 <= i < 58 for i in range(256)]),
    "symbols": np.array([32 < i < 127 and not chr(i).isalnum() and i not in _PLAIN for i in range(256)]),
    "exclaims": np.array([i == 33 for i in range(256)]),
    "spaces": np.array([i in (9, 11, 12, 13, 32) for i in range(256)]),
    "newlines": np.array([i == 10 for i in range(256)]),
}


def _distinct(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many different values each text has."""
    own = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((hashes, own))
    h, t = hashes[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=len(starts) - 1)


def statistics_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row per text, a column per name in :data:`STATISTICS`; all 0 for a text without words."""
    n = len(starts) - 1
    count = {k: per_text(of[data], starts).astype(float) for k, of in _CLASS.items()}
    size = np.maximum(np.diff(starts), 1)
    w = words(data, starts)
    total = np.diff(w.starts)
    some = np.maximum(total, 1)
    length = w.end - w.begin
    same = np.zeros(len(w.hashes), bool)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    firsts = w.starts[:-1][total > 0]
    same[firsts] = False
    cut = np.flatnonzero(data == 10)
    begin = np.union1d(starts[:-1], cut + 1)
    begin = begin[begin < len(data)]
    ends = np.append(begin[1:], len(data))
    line = np.searchsorted(begin, starts)
    trim = ends - (data[ends - 1] == 10)
    lines = np.diff(line)
    out = np.column_stack([
        np.log1p(total),
        per_text(length, w.starts) / some,
        count["upper"] / np.maximum(count["letters"], 1),
        count["digits"] / size,
        count["symbols"] / size,
        count["exclaims"] / size,
        count["spaces"] / size,
        count["newlines"] / size,
        per_text(length <= 3, w.starts) / some,
        per_text(same, w.starts) / some,
        _distinct(w.hashes, w.starts) / some,
        1 - _distinct(span_hashes(data, begin, trim), line) / np.maximum(lines, 1),
    ])
    out[total == 0] = 0
    return out.reshape(n, len(STATISTICS))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and a double per statistic of the whole text; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                found = statistics_of(c.data, c.starts)
                ids = batch.column("id").slice(c.first, len(found))
                columns = [ids, *(pa.array(found[:, i]) for i in range(len(STATISTICS)))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *STATISTICS])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, " + ", ".join(f"{x} double" for x in STATISTICS)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def with_statistics(docs: DataFrame, prefix: str, text_col: str = "text") -> DataFrame:
    """Whole rows, with the statistics as further columns; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(text_col)):
                found = statistics_of(c.data, c.starts)
                own = batch.slice(c.first, len(found))
                columns = [*own.columns, *(pa.array(found[:, i]) for i in range(len(STATISTICS)))]
                yield pa.RecordBatch.from_arrays(columns, names=[*own.schema.names, *(prefix + x for x in STATISTICS)])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + x, T.DoubleType()) for x in STATISTICS)])
    return docs.mapInArrow(run, schema)


#: A rule: bounds (statistic, upper?, threshold) that hold together.
Rule = tuple[tuple[str, bool, float], ...]


def _paths(node, above: Rule = ()) -> Iterator[Rule]:
    if above:
        yield above
    if "InternalNode" in node.getClass().getName():
        split = node.split()
        name, at = STATISTICS[split.featureIndex()], float(split.threshold())
        yield from _paths(node.leftChild(), (*above, (name, True, at)))
        yield from _paths(node.rightChild(), (*above, (name, False, at)))


def holds(rule: Rule, prefix: str = "") -> Column:
    return reduce(Column.__and__, (F.col(prefix + n) <= at if upper else F.col(prefix + n) > at for n, upper, at in rule))


class Model:
    """Weighted rules; ``score()`` is a column over the statistics."""

    def __init__(self, base: float, rules: list[tuple[float, Rule]]):
        self.base, self.rules = base, rules

    def score(self, prefix: str = "") -> Column:
        total = F.lit(self.base)
        for weight, rule in self.rules:
            total = total + F.when(holds(rule, prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(
    labelled: DataFrame, label: str = "label", trees: int = 12, depth: int = 3, penalty: float = 0.0005, seed: int = 7
) -> Model:
    """Rules from statistics and a label of 0 or 1 per row; rows with a null label are left out.

    Trees and weights are fitted on all rows by distributed aggregation. Without rows, or with one
    label only, the score is the smoothed share of label 1.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("label"), *STATISTICS)
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    share = (ones + 1) / (n + 2)
    if ones in (0, n):
        return Model(math.log(share / (1 - share)), [])
    vectors = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"), *STATISTICS)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(vectors)
    rules = sorted({rule for tree in forest.trees for rule in _paths(tree._call_java("rootNode"))})
    marks = rows.select("label", array_to_vector(F.array(*(holds(r).cast("double") for r in rules))).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60, aggregationDepth=2)
    fitted = lasso.fit(marks)
    weights = fitted.coefficients.toArray().tolist()
    return Model(float(fitted.intercept), [(w, r) for w, r in zip(weights, rules) if w])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from all labelled rows; their statistics are picked out of one pass over the texts."""
    found = written(statistics(docs, id_col, text_col), "statistics")
    model = _learn(found, labels, label, id_col)
    discard(found)
    return model


def _learn(found: DataFrame, labels: DataFrame, label: str, id_col: str) -> Model:
    known = labels.select(F.col(id_col), F.col(label).alias("label")).where(F.col("label").isNotNull())
    return fit(written(found.join(known, id_col).select("label", *STATISTICS), "labelled"))


def keep_good(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """Whole rows that score at least ``threshold``; no shuffle."""
    prefix = "_statistic_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    scored = with_statistics(docs, prefix, text_col).where(model.score(prefix) >= threshold)
    return scored.drop(*(prefix + x for x in STATISTICS))


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.7,
) -> DataFrame:
    """One row per input row: id, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Statistics are computed in one pass over the texts and written to the shared folder: a hundred bytes a
    row, from which labelled rows are picked and all rows scored. ``learn_from`` says by id which
    rows may be learned from. Null and empty texts are scored like others; repeated rows and null ids
    stay (a null id has no label); an id with several labels is learned from each of them; an empty table gives no rows.
    """
    found = written(statistics(docs, id_col, text_col), "statistics")
    model = _learn(found, labels.where(learn_from), label, id_col)
    scored = found.select(id_col, model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
