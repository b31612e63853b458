"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and its result
is written as Parquet and read again as the next stage's input. All stages but the last return the
columns of ``documents``. An empty table passes through all stages.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pathlight.llm import decontaminate, pieces, simhash, substrings, toxicity
from pathlight.llm.lineage import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: that of the least doc_id."""
    return simhash.keep_one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that occur earlier in the corpus go; documents without words left go too."""
    return substrings.drop_repeated_words(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_bytes, ids, decoded_sha256) of every document: its SentencePiece ids, and the digest
    of the text that they decode to, by which a lossy encoding shows."""
    kept = docs.select("text", "doc_id", "lang", "source")
    # Rows are carried along and workers come from other stages: smaller blocks than the operator's own.
    encoded = pieces.encode(kept, public_tokenizers.path("piece_bpe_32k.model"), keep_row=True, block_bytes=8 << 20, digest=True)
    return encoded.select("row.doc_id", "row.lang", "row.source", "n_bytes", "ids", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
