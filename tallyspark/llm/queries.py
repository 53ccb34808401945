"""The registered queries of this package: a name and a function of (spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.llm.alignment import align
from tallyspark.llm.common import remainder, table
from tallyspark.llm.exact_dedup import exact_dedup
from tallyspark.llm.filter_audit import filter_audit
from tallyspark.llm.language import identify
from tallyspark.llm.mixing import mix
from tallyspark.llm.near_dedup import near_duplicates
from tallyspark.llm.page_text import extract
from tallyspark.llm.packing import pack
from tallyspark.llm.pattern_packing import pack_by_patterns
from tallyspark.llm.passages import repeated_passages
from tallyspark.llm.token_files import read_token_files, write_token_files
from tallyspark.llm.topk import top_k
from tallyspark.llm.toxicity import toxicity
from tallyspark.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, end_id=2)
    return read_token_files(spark, path).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), end_id=0, size=1024)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id")) == 2
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id")) == 2
    found = identify(table(spark, sf_dir, "documents"), learn=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_patterns(table(spark, sf_dir, "documents"), end_id=0, size=2048)


QUERIES: dict[str, Query] = {
    "op1_topk": op1_topk,
    "op2_mixing": op2_mixing,
    "op3_near_dedup": op3_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_page_text": op5_page_text,
    "op6_passages": op6_passages,
    "op7_token_files": op7_token_files,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_alignment": op11_alignment,
    "op12_filter_audit": op12_filter_audit,
    "op13_best_fit_packing": op13_best_fit_packing,
}
