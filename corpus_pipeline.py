"""From raw documents to packed training sequences, in stages that are written between.

Every stage takes (spark, docs, sf_dir) and all that the stage before it kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.common import table, written
from tallyspark.llm.exact_dedup import without_copies
from tallyspark.llm.language import in_known_language
from tallyspark.llm.mixing import mixed
from tallyspark.llm.near_dedup import without_near_copies
from tallyspark.llm.packing import pack


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language; null texts and texts without letters go."""
    return in_known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8."""
    return without_near_copies(docs, words=5, percent=80)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences of 1024 tokens."""
    return pack(docs, end_id=0, size=1024)


STAGES = [
    ("language", known_language),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("source weights", source_weights),
    ("packing", sequences),
]

#: A recurrent network and a tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
