"""The corpus pipeline: five stages over documents, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallystone.llm.common import split_by, written
from tallystone.llm.language import keep_known
from tallystone.llm.minhash import near_duplicates
from tallystone.llm.packing import pack
from tallystone.llm.quality import keep_good
from tallystone.llm.secrets import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; null and empty texts are scored too."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be learned; null texts and those without a letter go."""
    return keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, by five-word shingles.

    A document with a null doc_id or without words is in no group and stays; rows that
    share a doc_id are one document and stay or go together.
    """
    gone = written(near_duplicates(docs).where("component_id <> doc_id").select("doc_id").distinct(), "near-duplicates")
    maybe, rest = split_by(docs, "doc_id", gone)
    return maybe.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns]).unionByName(rest)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by [SECRET]; n_chars follows."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: The stages hold trained models and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
