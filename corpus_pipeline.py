"""The corpus pipeline: toxic documents out, one of each near-duplicate group, repeats out, benchmark text out, tokens.

Each stage takes all documents that the one before kept, is written as Parquet, and is
read again as the next one's input. Stages but the last return the columns of documents.

Defined results: null and empty texts pass all stages (no terms beyond the bias, no
shingles, no windows, no tokens); an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm import bpe, decontaminate, near_dedup, substring_dedup, toxicity
from folioworks.llm._common import materialize, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half (operator 4)."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.below(docs, machine)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group (operator 3)."""
    return near_dedup.one_of_each(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of passages that came earlier (operator 10); n_chars follows the text."""
    out = substring_dedup.dedup_texts(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages (operator 2)."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of encoding and decoding (operator 1)."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", remove_toxic), ("near_dedup", remove_near_duplicates), ("substring_dedup", remove_repeats), ("decontamination", remove_contaminated), ("bpe", encode)]

#: A learned stage and iterated ones: not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
