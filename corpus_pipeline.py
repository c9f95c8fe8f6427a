"""A corpus pipeline: language ID, exact and near deduplication, mixing, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of documents, further ones too if docs
has any, whatever their names.

Defined cases: a null text, or one without a letter, goes in the first stage. A null doc_id
is a document; among equal or linked texts it stays only if no other has an id. Rows that repeat
doc_id and text are equal texts, so one stays. Ties are broken by the least doc_id. An empty
table gives an empty result. After mixing a document comes once for each pass that takes
words of it, so what identifies a packed piece is its place: (sequence_id, offset).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repograph.llm import exact_dedup, langid, mixing, packing, simhash
from repograph.llm.common import scratch, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go; a null lang becomes the predicted one.
    No score rejects a document: the lowest ones are those of short clean texts."""
    return langid.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id stays."""
    return simhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a document comes once for each pass over its source that takes words of it, with these
    words. Which blocks the last pass of a source takes is what its permutation and target say."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixture's documents and the sequence and offset of each."""
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: Trained models, hashes and permutations aren't SQL; a brute-force version tests it instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's tables go when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep:
        for name, stage in STAGES:
            with scratch(spark) as pass_on:
                docs = pass_on(written(stage(spark, docs, sf_dir), name))
        return keep(docs)
