"""The pipeline's stages: each takes (spark, docs, sf_dir) and works on all rows of ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup as exact
from . import mixing as mixer
from . import near_dedup as near
from . import packing as packer
from . import toxicity as toxic
from .queries import vocabulary_path
from .shared import durable as written  # noqa: F401  used by corpus_pipeline


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not call toxic.  It
    is fitted on a bounded sample of the labelled ones; rows pass through the
    scoring as they are, so nothing is joined."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxic.without_toxic(docs, labels)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return near.dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it does."""
    return mixer.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packer.pack(docs, vocabulary_path())
