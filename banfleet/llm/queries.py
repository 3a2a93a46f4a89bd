"""Queries of the operators over the given tables, and SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banfleet.llm import ann, byte_bpe, chat, conversation_repair, embedding_dedup, langid, line_dedup, ngram_join, packing, prefix_trie, quality, suffix_dedup, token_counts
from banfleet.llm.oracles import ORACLES as ORACLES
from banfleet.session import scratch_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every vector, within its label."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    filters = langid.learn(docs.where(~langid.held_out()), F.col("lang"), F.col("text"))
    found = langid.predict(docs, filters)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without strings that an earlier one has."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts by the byte-level tokenizer, from a cache that starts empty."""
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts = token_counts.count_tokens(docs, path, scratch_folder(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, among all."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document, and how many others it is linked with."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the bytes they stand for, as digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    both = byte_bpe.decode(tokens, ranks)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations rendered, then read back from the rendering."""
    rows = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.render_conversations(chat.log_of(rows)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of three quarters of them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.score_documents(docs, labels, ~langid.held_out())
    return found.select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of all conversations after damage, and their cheapest repair."""
    return conversation_repair.damaged_report(table(spark, sf_dir, "conversations"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, each begun like the first of its hundred."""
    return prefix_trie.branched_trie(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents hold."""
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_language, op3_suffix_dedup, op4_token_counts, op5_packing, op6_ann, op7_ngram_join, op8_byte_bpe, op9_chat, op10_quality, op11_conversation_repair, op12_prefix_trie, op13_line_dedup)}

