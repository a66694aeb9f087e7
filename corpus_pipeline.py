"""A corpus pipeline: toxicity, near-duplicates, repeated strings, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.  All but the last keep the columns of ``documents``.

Nulls and odd input, stage by stage: a null or empty text has no toxic word and stays; of all texts
without words one stays; a null text loses no string; a null source is a source of its own, a document
without words has size 0; a null text has no tokens.  Rows with a null doc_id take part, told apart by
their texts.  Repeated rows are one document: the near-duplicate stage keeps one.  Extra columns,
whatever their names, pass through to the last stage.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import bpe, mixing, simhash, substring_dedup, toxicity
from tallyspark.llm.common import materialize, table


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; the model learns from this stage's documents."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: five-word shingles, similarity of 0.8 or more."""
    return simhash.keep_one(docs, similarity=0.8, n=5)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out; ``n_chars`` follows the text."""
    return substring_dedup.strip_bytes(docs, length="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; a document stands as often as the mix takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix, with its source."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", toxic_filter),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("mixing", mix),
    ("bpe", tokens),
]

#: The toxicity model, SimHash and BPE have no SQL form; tests/llm/test_pipeline.py holds the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
