"""Feed registry and folder import.

A feed maps file extensions to a staging function ``(spark, path) -> movements``.
Files with another extension are skipped. A file whose rows cannot be read in
full is reported with its errors and contributes no row; the others go on. Every
file of the feed is reported, also one without a row. Units of symbol currencies
keep eight decimals in ``quantity``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspark.functions.text import file_extension, file_name
from tallyspark.sources import readers

Stage = Callable[[SparkSession, str], DataFrame]

STAGED = (
    "source_file string, source_row int, date date, amount decimal(14,2), currency string,"
    " description string, external_ref string, raw_description string, quantity decimal(24,8)"
)


def _card_csv(spark: SparkSession, path: str) -> DataFrame:
    return readers.stage_card_rows(readers.read_card_rows(spark, path))


def _sectioned_csv(spark: SparkSession, path: str) -> DataFrame:
    texts = readers.read_texts(spark, path, "*.[cC][sS][vV]", "ISO-8859-1")
    rows = readers.stage_sectioned_movements(texts, "Fecha").withColumn("quantity", F.col("units"))
    return rows.withColumn("amount", F.col("units").cast("decimal(14,2)"))


def _xml(spark: SparkSession, path: str) -> DataFrame:
    return readers.stage_xml_block(readers.read_texts(spark, path, "*.[xX][mM][lL]"))


FEEDS: dict[str, dict[str, Stage]] = {
    "card": {".csv": _card_csv},
    "broker": {".xml": _xml},
    "exchange": {".csv": _sectioned_csv},
}


def stage_feed(spark: SparkSession, feed: str, path: str) -> DataFrame:
    """All rows of a feed's folder in one staged schema."""
    if feed not in FEEDS:
        raise KeyError(f"unknown feed {feed!r}, known: {sorted(FEEDS)}")
    out = None
    for stage in FEEDS[feed].values():
        rows = stage(spark, path)
        for name in ("source_row", "currency", "external_ref", "raw_description", "quantity"):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None))
        cast = [F.expr(f"cast(`{f.split()[0]}` as {f.split()[1]})").alias(f.split()[0]) for f in STAGED.split(", ")]
        rows = rows.select(*cast)
        out = rows if out is None else out.unionByName(rows)
    return out


def _problems() -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("date").isNull(), "date"),
            F.when(F.col("amount").isNull(), "amount"),
        )
    )


def feed_files(spark: SparkSession, feed: str, path: str) -> DataFrame:
    """Names of the files of a folder that belong to the feed; contents are not read."""
    listed = spark.read.format("binaryFile").load(path).select(file_name(F.col("path")).alias("source_file"))
    return listed.filter(F.lower(file_extension(F.col("source_file"))).isin(*FEEDS[feed]))


def file_status(staged: DataFrame, files: DataFrame) -> DataFrame:
    """Per file of ``files``: rows and the fields that could not be read somewhere in it."""
    rows = staged.select("source_file", _problems().alias("_p"))
    found = rows.groupBy("source_file").agg(
        F.count("*").alias("_n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_p")))).alias("_bad")
    )
    bad = F.coalesce(F.size("_bad"), F.lit(0)) > 0
    return (
        files.join(found, "source_file", "left")
        .select(
            "source_file",
            F.when(bad, "error").otherwise("ok").alias("status"),
            F.when(bad, F.lit(0)).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("rows"),
            F.when(bad, F.concat(F.lit("unreadable: "), F.array_join("_bad", ", "))).alias("error"),
        )
        .orderBy("source_file")
    )


def ingest_feed(spark: SparkSession, feed: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the readable files of a folder and the status of every file."""
    staged = stage_feed(spark, feed, path)
    bad = staged.filter(F.size(_problems()) > 0).select("source_file").distinct()
    return staged.join(bad, "source_file", "left_anti"), file_status(staged, feed_files(spark, feed, path))
