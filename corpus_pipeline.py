"""From raw documents to token ids: five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import exact_dedup, minhash, mixing, quality, sentencepiece_bpe
from peakloom.llm.common import crc_mod
from peakloom.session import materialize

#: No source is repeated more often than this; the least repeated one is used once, so mixing loses no document.
MAX_REPETITION = 1.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least quality.KEEP_SCORE; held-out labels aren't learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, held_out=crc_mod("doc_id", 5) == 0)
    return quality.kept_documents(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the largest doc_id."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the one with the smallest doc_id."""
    return minhash.kept_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of smaller sources up to MAX_REPETITION times on average."""
    return mixing.mixed_documents(docs, MAX_REPETITION)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the token ids of every use of a document, and the digest of what they decode to."""
    found = sentencepiece_bpe.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [("quality", keep_good), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("encoding", encode)]
#: Neither compression nor token merges can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
