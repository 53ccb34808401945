"""Exact duplicates in two passes over a Bloom filter; DataFrame operations only.

The first pass counts, for every slot of the filter, how many rows set it, and
keeps the slots set at least twice. The second pass looks every row up: a row
with a slot that nobody else set has no equal and passes straight through. Only
the other rows are shuffled by their hash. What is shuffled is a hash, an id and
a length, never a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm.common import SPACE, checked_broadcast, scratch, texts, written

BITS = 26
MAX_BROADCAST = 2_000_000


def _slot(seed: int, bits: int) -> Column:
    return F.xxhash64("hash", F.lit(seed)).bitwiseAND(F.lit((1 << bits) - 1))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the SHA-256 of its text without white space, the code points of
    the text as it is, and a row number."""
    return texts(docs, id_col, text_col).select(
        "doc_id",
        F.unhex(F.sha2(F.regexp_replace("text", SPACE, ""), 256)).alias("hash"),
        F.char_length("text").cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def repeated_slots(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """The filter after the first pass: 64-bit words of slots that several rows set.

    At most 2**bits / 64 rows, whatever the number of documents.
    """
    slots = rows.select(F.explode(F.array(_slot(1, bits), _slot(2, bits))).alias("slot"))
    often = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    return often.groupBy(F.expr("shiftright(slot, 6)").alias("word")).agg(F.bit_or(one).alias("mask"))


def possibly_repeated(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` with ``possible``: false only where no other row has the same hash.

    The filter is broadcast: 2**26 slots are at most 2**20 words of 16 bytes.
    """
    words = written(repeated_slots(rows, bits))
    out = rows
    for seed in (1, 2):
        word = words.select(F.col("word").alias(f"word{seed}"), F.col("mask").alias(f"mask{seed}"))
        out = out.withColumn(f"slot{seed}", _slot(seed, bits)).withColumn(
            f"word{seed}", F.expr(f"shiftright(slot{seed}, 6)")
        )
        out = out.join(F.broadcast(word), f"word{seed}", "left")
    hit = [F.expr(f"coalesce(shiftright(mask{s}, cast(slot{s} & 63 as int)) & 1, 0) = 1") for s in (1, 2)]
    return out.select(*rows.columns, (hit[0] & hit[1]).alias("possible"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without white space. Of equal rows the one
    with the most code points stays, then the smallest id (a null id is last), then
    the first in the table. Null texts count as empty and equal each other. Repeated
    rows are documents like any other: one of them stays. Other columns are ignored.
    An empty table gives no rows.

    ``bits`` sets the size of the filter. With many more documents than slots more
    rows take the second way; the result stays the same.
    """
    rows = written(keyed(docs, id_col, text_col))
    marked = possibly_repeated(rows, bits)
    sha = F.lower(F.hex("hash")).alias("text_sha256")
    alone = marked.filter(~F.col("possible")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha
    )
    maybe = marked.filter("possible").drop("possible")
    order = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), "doc_id", "row_no")
    groups = maybe.groupBy("hash").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("first"))
    # Written first: both sides of the join then have a shuffle of their own, and a
    # group with a third of all rows is split over many tasks.
    groups = written(groups.filter("group_size > 1"))
    found = maybe.join(groups, "hash", "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first").isNull() | (F.col("row_no") == F.col("first.row_no"))).alias("kept"),
        sha,
    )
    return alone.unionByName(found)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are.

    What goes is found by the ids of the rows that do not stay, so texts are shuffled only
    if these are too many to broadcast. Rows whose id is null or occurs several times are
    compared by hash as well, and of those that are equal to a kept one the longest stays.
    """
    with scratch(docs.sparkSession) as keep:
        found = written(exact_dedup(docs, id_col, text_col, bits).select("doc_id", "kept", "text_sha256"))
        several = found.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.struct("doc_id").alias("_id"))
        several = keep(several)
        dropped = keep(found.filter("not kept").select(F.struct("doc_id").alias("_id")).distinct())
        stay = keep(found.filter("kept").select(F.struct("doc_id", "text_sha256").alias("_copy")).distinct())
    several, dropped = checked_broadcast(several, MAX_BROADCAST), checked_broadcast(dropped, MAX_BROADCAST)
    # One column, so that no name of the table can clash.
    rows = docs.select(F.struct("*").alias("_row"), F.struct(F.col(f"`{id_col}`").cast("long").alias("doc_id")).alias("_id"))
    straight = rows.join(several, "_id", "left_anti").join(dropped, "_id", "left_anti")
    text = F.coalesce(F.col("_row")[text_col], F.lit(""))
    sha = F.lower(F.sha2(F.regexp_replace(text, SPACE, ""), 256))
    again = rows.join(several, "_id", "left_semi").withColumn("_copy", F.struct(F.col("_id.doc_id").alias("doc_id"), sha.alias("text_sha256")))
    again = again.join(stay, "_copy", "left_semi")
    longest = again.groupBy("_copy").agg(F.max_by("_row", F.char_length(text)).alias("_row"))
    return straight.select("_row.*").unionByName(longest.select("_row.*"))
