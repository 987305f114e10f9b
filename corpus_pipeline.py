"""The training-data pipeline over documents: each stage reads what the one before has written.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerweave.llm import mixing, radix_dedup, simhash, toxicity, viterbi_pieces
from ledgerweave.llm.queries import tokenizer_path
from ledgerweave.work import written


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return radix_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the row with the smallest doc_id stays."""
    return simhash.drop_near_copies(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row's text, with their count and digests."""
    return viterbi_pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxic_stage), ("exact_dedup", exact_stage), ("simhash", near_stage), ("mixing", mix_stage), ("sentencepiece", encode_stage)]

#: The stages hash, draw and encode in ways that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
