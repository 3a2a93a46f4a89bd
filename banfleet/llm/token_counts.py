"""Token counts through a cache of content digests.

A text is encoded once per tokenizer version, however many rows, runs or tables hold it: rows are
joined by digest to stored counts, and only distinct texts without one are encoded and appended.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banfleet.llm.pieces import Pieces
from banfleet.llm.workers import text_chunks, worker_cache

_CACHE = "digest string, n_tokens long"


def version_of(tokenizer: str) -> tuple[bytes, str]:
    """The tokenizer's file, and a digest of it together with the library's version."""
    import tokenizers

    with open(tokenizer, "rb") as f:
        content = f.read()
    return content, hashlib.sha256(content + tokenizers.__version__.encode()).hexdigest()


def normalised(text):
    """Content that is counted: null is empty. Both kinds of tokenizer see every other byte."""
    return F.coalesce(text, F.lit(""))


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Counts in ``folder``, which may not exist yet; a repeated append counts once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _CACHE)
    return spark.read.schema(_CACHE).parquet(folder).dropDuplicates(["digest"])


def count_batches(content: bytes, version: str):
    """A mapInArrow function from (digest, text) to (digest, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_cache(("pieces", version), lambda: Pieces(content))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = []
            for chunk in text_chunks(((x, len(x)) for x in texts), 4 << 20):
                n += [len(x) for x in pieces.ids(chunk)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens``; null text counts as empty.

    ``cache`` is a folder that all executors reach. Distinct missing texts are found with map-side
    combine, so a text that a third of all rows hold is shuffled once per task. Repeated rows stay
    repeated, null ids stay null, an empty table gives an empty table, and columns other than the
    two named are not read.
    """
    spark = docs.sparkSession
    content, version = version_of(tokenizer)
    folder = os.path.join(cache, f"tokenizer={version}")
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    keyed = rows.withColumn("digest", F.sha2("text", 256))
    known = stored(spark, folder)
    misses = keyed.select("digest", "text").dropDuplicates(["digest"]).join(known, "digest", "left_anti")
    misses.mapInArrow(count_batches(content, version), _CACHE).write.mode("append").parquet(folder)
    counts = stored(spark, folder)
    light = keyed.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return light.join(counts, "digest", "left").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
