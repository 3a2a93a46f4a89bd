"""The corpus pipeline: documents to packed sequences in five stages.

Each stage takes what the one before has kept, as a table, and its decisions take effect. All but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banfleet.llm import langid, ngram_join, packing, quality, suffix_dedup
from banfleet.llm.workers import written

#: Share of known n-grams below which a text is in no learned language.
LEAST_KNOWN = 0.1
#: Score below which a document is rejected; the scores of clean and bad text lie far from it.
LEAST_QUALITY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus has; null texts and those without a letter go."""
    return langid.keep_known(docs, langid.learn(docs, F.col("lang"), F.col("text")), LEAST_KNOWN)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score well, by a model of all labelled ones; without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.learn(docs, labels), LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class; rows with a null id stay."""
    classes = ngram_join.near_duplicates(docs.select("doc_id", "text"))
    copies = classes.where(F.col("class_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings that an earlier one has; ``n_chars`` counts what is left.

    A character of which only some bytes were removed goes as a whole.
    """
    found = suffix_dedup.remove_repeats(docs, whole_rows=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*(new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left in sequences of at most 4096 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096, alone=True)


STAGES = [
    ("language", language),
    ("quality", good),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", pack),
]

#: The stages are no SQL: they learn models, sort suffixes and use a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each over the table that the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
