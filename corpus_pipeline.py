"""From documents to packed sequences: five stages, each a job over all that the one before kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from plateflow.llm.common import staged, table

#: Weights of the domains that the labels name: documents of poor and of good quality.
TARGETS = {"0": 0.1, "1": 0.9}


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar rejects go."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, and documents of which nothing is left."""
    return line_dedup.without_repeats(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that the expected tokens per domain meet the targets. Without a budget the
    fit itself keeps every rate at one or more, so every document stays at least once."""
    rates = staged(mixing.mix(docs, table(spark, sf_dir, "labels"), F.col("quality"), TARGETS, epochs=None), "rates")
    return mixing.apply_rates(docs, rates)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in as few sequences as the packing finds."""
    tokenizer, merges = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(packing.token_pieces(docs, tokenizer, merges))


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_duplicates),
    ("mixing", mixed),
    ("best-fit packing", packed),
]

#: Learned scores, rates and token ids are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
