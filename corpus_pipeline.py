"""From raw documents to token ids: quality, near copies, secrets, mixture, tokens.

Every stage takes what its predecessor kept, as written Parquet, and all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, minhash, mixing, quality, secrets
from weftline.llm.common import materialize, release, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the rest goes. A null text is scored as the empty one; rows that are
    equal fare alike; an empty table gives no rows."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest doc_id; a row without an id goes for one with.

    Rows equal throughout are copies of each other, and a shared id doesn't make rows copies. Texts without words, null ones
    too, are one class. An empty table gives no rows."""
    return minhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; null and empty texts stay as they are."""
    return secrets.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, from never to three times; texts without words are never taken. Of rows that
    are equal throughout some may go and some stay. An empty table gives no rows."""
    return mixing.repeat_rows(docs)


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded text, a row for each row of ``docs``, repeated ones too. A null text is
    the empty one, without ids; an empty table gives no rows."""
    coded = bpe.encode_decode(docs.select(F.col("doc_id").cast("long").alias("key"), "text"), bpe.vocabulary())
    return coded.select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mixing),
    ("BPE encoding and decoding", bpe_encode_decode),
]

#: The classifier, the classes and the tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
            release(before)
    return docs
