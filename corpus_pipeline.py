"""From raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, of documents' columns but for the last. Nulls in any column
pass through; a null text counts as empty, so the first stage rejects it. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm import jaccard_join, packing, pii, quality, substring_dedup
from seqloom.llm.common import documents, written


def _recounted(df: DataFrame, names: list[str]) -> DataFrame:
    """With n_chars, if there is such a column, as the text now has."""
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)).select(names) if "n_chars" in names else df


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of Jaccard 3/4 on five-word shingles join, the document of the smallest id."""
    return jaccard_join.first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words and more that start anywhere else too."""
    return _recounted(substring_dedup.strip_repeats(docs), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _recounted(pii.redact(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("pack_sequences", pack_sequences),
]

#: The near-duplicate, field and packing stages are beyond SQL; a test holds run() against plain near-duplicate and passage stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents on; what a stage returns is written to the shared folder and read by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
