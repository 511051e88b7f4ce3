"""A corpus pipeline of five of the training-data operators, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mintscope.llm import jaccard, langid, linededup, mixing, packing
from mintscope.llm.common import cut, docs_table
from mintscope.llm.queries import SHARES, vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, no letters) go."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or within one character of an earlier one go, and documents of which nothing is left; n_chars follows."""
    return linededup.drop_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (SimHash fingerprints within two bits and what MinHash finds beyond, verified: five-word shingles, Jaccard 0.8 or more) stays, that of the smallest doc_id."""
    return jaccard.drop_near_duplicates(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their rates say: toxic ones not at all, poor ones at a quarter of their tokens, good ones once."""
    return mixing.resample(docs, mixing.label_domains(docs_table(spark, sf_dir, "labels")), SHARES)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in windows of 1024 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_to_weights", mix_to_weights),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_table(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs


#: Classifiers, components and packing aren't SQL's to express; the stages are tested against brute force instead.
ORACLE_SQL = None
