"""A corpus prepared in five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a frame; it is written as
Parquet and read again before the next one.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lastseen.llm.byte_pair import encoded
from lastseen.llm.common import handing_few_rows, shipped, stored
from lastseen.llm.line_dedup import without_boilerplate
from lastseen.llm.mixing import mixed_documents
from lastseen.llm.near_dup import without_near_copies
from lastseen.llm.quality_model import scored, trained


@shipped
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality model, trained on the labels of these, scores 0.5 or more."""
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model, least=0.5).select(*docs.columns)


@shipped
def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sources."""
    return without_boilerplate(docs).select(*docs.columns)


@shipped
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return without_near_copies(docs, words=5, percent=80)


@shipped
def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixed_documents(docs)


@shipped
def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encoded(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_shared_lines),
    ("near_dedup", one_of_each_group),
    ("mix", to_target_weights),
    ("tokens", as_tokens),
]

#: The first stage trains a model, the last one tokenizes: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with handing_few_rows(spark):
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
