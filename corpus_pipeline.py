"""Documents to tokens: toxicity, exact copies, near copies, benchmark passages, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import bpe, dartminhash, decontamination, exact_dedup, toxicity
from voxelloom.llm.queries import RANKS
from voxelloom.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score stays below the threshold of their language; fitted on labelled rows of ``docs``."""
    net = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, net)
    return scored.filter(~toxicity.is_toxic(net, F.col("out.score"), F.col("doc.lang"))).select("doc.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dartminhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids as little-endian unsigned 32-bit integers, and the digests of op7 for what is left."""
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    coded = bpe.round_trip(docs, ranks, pattern, keep=["doc_id", "lang", "source"])
    return coded.select("doc.*", "out.n_tokens", "out.ids_sha256", "out.decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("near-duplicates", drop_near_copies), ("decontamination", drop_benchmark), ("byte-level BPE", to_tokens)]

ORACLE_SQL = None  # SQL can't express the classifier, the signatures or the merges


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
