"""A corpus pipeline of five stages: quality, near copies, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents; the last returns each document's ids. A document that was mixed in several times
comes as often.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import bpe, jaccard, mixing, pii, quality
from pairlens.llm.common import load, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Shares of tokens; the quality stage has taken the junk out before.
TARGETS = {"clean": 0.92, "junk": 0.005, "toxic": 0.075}
#: Documents below this score are rejected.
LEAST_SCORE = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores LEAST_SCORE or more."""
    model = quality.fit(docs, load(spark, sf_dir, "labels"), quality.learnable())
    docs = docs.select(*COLUMNS)
    return docs.mapInArrow(quality.keep_good(model, LEAST_SCORE), docs.schema)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, Jaccard 0.8 or more) the document of smallest id.

    Rows of one doc_id are one document: they stay or go together. Rows of a null doc_id stay.
    """
    found = jaccard.similar(docs, k=5, num=80, den=100)
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    if gone.count() <= jaccard.BROADCAST_ROWS:
        gone = F.broadcast(gone)  # that many rows of one number at most
    return docs.select(*COLUMNS).join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked, and their new lengths."""
    docs = docs.select(*COLUMNS)
    masked = docs.mapInArrow(pii.mask_texts(pii.model(docs)), docs.schema)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask for."""
    return mixing.mixed_rows(docs.select(*COLUMNS), load(spark, sf_dir, "labels"), TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_copies),
    ("personal data", personal_data),
    ("mixing to target weights", mix),
    ("byte-level BPE", tokens),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
