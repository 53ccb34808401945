"""Interaction of filters: what every order of some filters removes at every step.

Which filters a document fails does not depend on their order, so documents are counted
once by *mask*: the set of filters they fail and whether they are marked good or toxic.
Every mask stands for one wide integer. Its fields of 64 bits hold 0 or 1 for each
outcome of each step of each order, so a sum of such integers is a sum of all outcomes at
once. A field never overflows into the next, as no part has 2**63 documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.common import written

LETTERS = "ABCDE"
#: Outcomes of a step that a field counts, in the order of the fields.
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD_BYTES = 8
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{o} long" for o in (*OUTCOMES, "shapley"))


CAPITALS = bytes(range(65, 91))
FOLLOWING = bytes(range(128, 192))  # bytes of a code point after its first
SYMBOLS = (b"#", b"$", b"%", b"&", b"*", b"|")


def text_failures(data: bytes) -> int:
    """Bits of the filters that look at one text only: A short, B repetitive, C capitals, D symbols."""
    words = data.split()  # of bytes: at 0x20 and 0x09 to 0x0D
    n, distinct = len(words), len(set(words))
    capitals = len(data) - len(data.translate(None, CAPITALS))
    points = len(data.translate(None, FOLLOWING))
    symbols = any(c in data for c in SYMBOLS)
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * capitals > 2 * points) << 2 | symbols << 3


def judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Per document: doc_id, part, the bits of A to D and the SHA-256 of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
            bits = pa.array([text_failures(t) for t in texts], pa.int32())
            hashes = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            # Ids pass as they are: no float in between.
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), bits, hashes], ["doc_id", "part", "bits", "hash"]
            )

    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.col(f"`{text_col}`").cast("binary").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, part string, bits int, hash binary")


def marked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``n`` equal rows as one, and whether the labels call the document good or toxic."""
    at_labels = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = at_labels.agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    same = rows.groupBy("doc_id", "part", "bits", "hash").agg(F.count(F.lit(1)).alias("n"))
    # Rows without an id have no label; the join would send all of them to one task.
    named, nameless = same.filter("doc_id is not null"), same.filter("doc_id is null")
    no = F.lit(False)
    return (
        named.join(marks, "doc_id", "left")
        .withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
        .unionByName(nameless.withColumns({"good": no, "toxic": no}))
    )


def mask_counts(rows: DataFrame) -> DataFrame:
    """Documents by part and mask: bits 0 to 4 the filters A to E, bit 5 good, bit 6 toxic.

    A document fails E if a smaller id has the same text anywhere. Within a part, mask and
    text only those of the smallest id can pass, so a group of copies is counted without
    joining its documents; what a text has in different parts meets in a window.
    """
    kinds = rows.groupBy("hash", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    least = kinds.groupBy("hash").agg(F.min("first.doc_id").alias("least"), F.count(F.lit(1)).alias("kinds"))
    # Texts of one part and mask, nearly all of them, need no second look.
    several = least.filter("kinds > 1").select("hash", "least")
    placed = kinds.join(several, "hash", "left")
    is_first = F.col("first").isNotNull() & (F.col("first.doc_id") == F.coalesce("least", "first.doc_id"))
    passing = F.col("nameless") + F.when(is_first, F.col("first.n")).otherwise(0)
    mask = F.col("bits").bitwiseOR(F.when(F.col("good"), 32).otherwise(0)).bitwiseOR(F.when(F.col("toxic"), 64).otherwise(0))
    split = placed.select(
        "part",
        F.explode(
            F.array(
                F.struct(mask.alias("mask"), passing.alias("n")),
                F.struct(mask.bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - passing).alias("n")),
            )
        ).alias("c"),
    )
    return split.filter("c.n > 0").groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"))


class WideCounters:
    """Sums of wide integers of masks over some filters, named by letters.

    A mask has a bit for every filter in the order of the letters, then one for good and
    one for toxic documents.
    """

    def __init__(self, letters: str = LETTERS):
        self.letters = letters
        self.orders = ["".join(p) for p in permutations(letters)]
        self.made: dict[int, int] = {}

    def of(self, mask: int) -> int:
        """The integer of a mask: a field for every order, step and outcome, first fields lowest."""
        if mask not in self.made:
            k = len(self.letters)
            failed, good, toxic = mask & ((1 << k) - 1), mask >> k & 1, mask >> (k + 1) & 1
            bit = {letter: 1 << i for i, letter in enumerate(self.letters)}
            fields = []
            for order in self.orders:
                there = 1
                for letter in order:
                    fails = 1 if failed & bit[letter] else 0
                    removed, redundant = there & fails, fails & (1 - there)
                    there &= 1 - fails
                    fields += (there, removed, redundant, int(failed == bit[letter]), removed & good, removed & toxic)
            self.made[mask] = int.from_bytes(np.array(fields, dtype="<u8").tobytes(), "little")
        return self.made[mask]

    def unpack(self, total: int) -> np.ndarray:
        """The fields of a sum of wide integers: orders x steps x outcomes."""
        k = len(self.letters)
        size = len(self.orders) * k * len(OUTCOMES) * FIELD_BYTES
        return np.frombuffer(total.to_bytes(size, "little"), dtype="<i8").reshape(-1, k, len(OUTCOMES))

    def outcomes(self, part: str, masks: list[int], counts: list[int]) -> pd.DataFrame:
        """All steps of all orders of one part, from its documents by mask."""
        if sum(counts) >= 1 << 63:
            raise OverflowError("a field holds less than 2**63 documents")
        fields = self.unpack(sum(n * self.of(m) for m, n in zip(masks, counts)))
        k = len(self.letters)
        which = np.array([[self.letters.index(c) for c in order] for order in self.orders])
        removed = fields[:, :, OUTCOMES.index("removed")]
        share = np.array([removed[which == i].sum() for i in range(k)])
        out = pd.DataFrame({o: fields[:, :, i].reshape(-1) for i, o in enumerate(OUTCOMES)})
        out.insert(0, "part", part)
        out.insert(1, "filter_order", np.repeat(self.orders, k))
        out.insert(2, "step", np.tile(np.arange(1, k + 1, dtype="int32"), len(self.orders)))
        return out.assign(shapley=share[which].reshape(-1))


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """Per part, order of the filters and step: what the step keeps, removes and loses.

    kept, removed: documents after and at this step. redundant: those that fail its filter
    and were gone before. unique_fails: those that fail its filter only. good_lost,
    toxic_lost: removed here, with quality or toxic 1 in ``labels`` (doc_id, quality,
    toxic; of several rows of one id any counts, null is no mark). shapley: what the
    filter of the step removes, summed over all orders.

    A null text is empty, a null part an empty string. A row without id has no label, and
    neither fails E nor makes others fail it; rows that repeat an id do not make each other
    fail E. An empty table gives no rows. Other columns are ignored.
    """
    rows = written(judged(docs, id_col, text_col, part_col))
    counts = mask_counts(marked(rows, labels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = WideCounters()
        for batch in batches:
            for part, masks, counts in zip(batch["part"], batch["masks"], batch["counts"]):
                yield wide.outcomes(part, masks.tolist(), counts.tolist())

    # At most 128 masks to a part, however many documents it has.
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n")).alias("c"))
    return by_part.select("part", F.col("c.mask").alias("masks"), F.col("c.n").alias("counts")).mapInPandas(run, AUDIT)
