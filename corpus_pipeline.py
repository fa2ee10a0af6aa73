"""A corpus pipeline of five operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Between stages the documents are
written as Parquet and read again.

Defined cases: null and empty texts have too few words and go in the first
stage; repeated rows are one document to near-dedup; rows without doc_id stay
there, each; an empty table gives an empty result; other columns are carried
along to the last stage, which returns doc_id, counts and digests.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from declgraph.llm import bpe, classifier, mixing, quality_rules, simhash
from declgraph.llm.common import checkpoint_folder


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Workers keep what they have filled from stage to stage, so the caches are smaller than the operators' own."""
    return classifier.accepted(docs, classifier.Settings(cached=120_000))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """On shingles of five words, for a similarity of 0.8 or more."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, cached=250_000)


STAGES = [("quality rules", rules), ("quality classifier", quality), ("simhash near-dedup", near_dedup), ("mix sources", mix), ("byte-level bpe", tokens)]

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
