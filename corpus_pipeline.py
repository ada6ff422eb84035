"""A training-data pipeline over ``documents``: five stages, each one operator of ``pagesift.llm``.

Every stage takes the documents its predecessor kept; all but the last return
the columns of ``documents``. ``run`` writes each stage's rows to the shared
folder before the next one reads them, so a lost executor repeats one stage
at most. Null texts count as empty, rows without id are kept, empty tables
stay empty; the operators' docstrings say more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagesift.llm import bpe, mixing, neardup, pii, toxicity
from pagesift.llm.common import table, written
from pagesift.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half, by a model fitted to the labelled ones among them."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates: five-word shingles, a
    likeness of 0.8 or more."""
    return neardup.keep_first(docs, threshold=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a repeated document is a repeated row."""
    return mixing.emit(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every row."""
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.json"), with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", mask_personal_data),
          ("mixing", mix_sources), ("bpe", tokenize)]

#: No SQL says what a trained classifier, shingle components or merges give; the tests hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
