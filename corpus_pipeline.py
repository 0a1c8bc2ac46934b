"""Corpus pipeline: quality classifier, near-duplicates, mixing, sampled segmentations.

Every stage takes the documents that the one before it kept and returns the columns of the
documents, but for the last, which returns the sampled piece ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import near_copies, piece_sampling, soft_mixing, subword_classifier
from lanewise.llm.queries import domain_labels
from lanewise.llm.shared import stored

#: Wanted expected tokens of each domain, as multiples of the present ones.
FACTORS = {"clean": 1.05, "poor": 0.5, "toxic": 0.25}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = subword_classifier.fit(docs, _labels(spark, sf_dir), "doc_id", "text", "quality")
    name = "score"
    while name in docs.columns:
        name += "_"
    return subword_classifier.score(docs, model, "text", out_col=name).filter(F.col(name) >= subword_classifier.ACCEPT).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.one_of_each_group(docs, "doc_id", "text")


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents kept, dropped or repeated by rates that bring the domains to their targets."""
    return soft_mixing.resample(docs, domain_labels(_labels(spark, sf_dir)), "doc_id", "text", FACTORS)


def sample_segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document."""
    return piece_sampling.sample_pieces(docs, "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("soft_mixing", mix_domains),
    ("piece_sampling", sample_segmentations),
]

# Trained models and random draws have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
