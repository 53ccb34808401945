"""Mixing of sources to target weights by entropy balancing; DataFrame operations only.

Among all rates of documents that give every source its target of words, the one closest
to taking each document once (in relative entropy, no rate above the limit) is
``min(limit, exp(tilt * size / mean size))`` with one tilt for each source. The tilts are
the solution of the convex dual, found by Newton steps for all sources together: a step is
one aggregation over the documents.

Rates become whole copies by one cut for each source: copy ``j`` of a document has the key
``j - rate - u`` with ``u`` fixed by a hash, and the copies with the smallest keys are taken
until the target is reached. The cut is found by histograms of the keys, ten bits at a time.

All sums are of whole numbers, so no order of adding changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark.llm.common import WORD, texts, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
STEPS = 40
PASSES = 4
#: Keys are kept in units of 2**-28 above -LIMIT, sums of words in units of 2**-10.
UNIT, SUM_UNIT = 1 << 28, 1 << 10
LEVEL_BITS = 10
ALL = 1 << 40
MAX_BROADCAST_BYTES = 16 << 20


def broadcast_sources(sources: DataFrame) -> DataFrame:
    """Broadcast the table of sources if its names and columns fit the bound; else leave
    the join to Spark, which splits the partition of a hot source."""
    width = F.coalesce(F.octet_length("source"), F.lit(0)) + 16 * len(sources.columns)
    size = sources.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(sources) if size <= MAX_BROADCAST_BYTES else sources


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    renamed = sources.withColumnRenamed("source", "_source")
    sides = broadcast_sources(sources)
    if sides is not sources:
        renamed = F.broadcast(renamed)
    return rows.join(renamed, rows["source"].eqNullSafe(renamed["_source"])).drop("_source")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, source and the number of words of the text (null: 0)."""
    return texts(docs, id_col, text_col, source_col).select(
        "doc_id",
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"),
    )


def ranked(sources: DataFrame) -> DataFrame:
    """Sources with ``place`` from 0 by code point, null last.

    Ordered in ranges, so that no task sees all sources: places in a range, plus the
    sources of the ranges before it.
    """
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    dealt = written(sources.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("part", before.alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return dealt.withColumn("inside", inside).join(F.broadcast(bases), "part").select(
        *sources.columns, (F.col("base") + F.col("inside") - 1).alias("place")
    )


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Sources (source, source_size, place) with their target of words.

    The level rises from the plain share: what sources at their limit cannot take is
    dealt to the others by weight, until none is above its limit.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = written(sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(limit)))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        above = F.col("most") < F.lit(level) * F.col("weight")
        held, rest = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("most")).cast("decimal(38,3)")), F.lit(0)).cast("double"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        new = (total * share - held) / rest if rest else level
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least("most", F.lit(max(level, 0.0)) * F.col("weight"))).drop("weight")


def _rate(limit: float) -> Column:
    tilted = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))
    return F.when(F.col("at_limit"), F.lit(float(limit))).otherwise(F.least(F.lit(float(limit)), tilted))


def tilts(rows: DataFrame, sources: DataFrame, limit: float = LIMIT, steps: int = STEPS) -> DataFrame:
    """``sources`` with the tilt of each: safeguarded Newton steps on the dual."""
    fixed = ["source", "source_size", "n_docs", "most", "target", "place", "mean", "at_limit"]
    state = sources.withColumn("mean", F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)))
    state = state.withColumn("at_limit", F.col("target") >= F.col("most") * (1 - 1e-12))
    state = written(
        state.select(*fixed, F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    )
    for step in range(steps):
        rate = _rate(limit)
        words = F.col("size") * rate
        slope = F.when(rate < limit, words * F.col("size") / F.col("mean")).otherwise(0.0)
        exact = lambda c: F.sum(F.round(c * SUM_UNIT).cast("long")) / SUM_UNIT
        sums = _with_sources(rows, state).groupBy(F.col("place").alias("p")).agg(exact(words).alias("words"), exact(slope).alias("slope"))
        miss = F.col("words") - F.col("target")
        bound = 4.0 * 2**step
        newton = F.when(F.col("slope") > 0, -miss / F.col("slope")).otherwise(-F.signum(miss) * bound)
        moved = F.col("tilt") + F.least(F.greatest(newton, F.lit(-bound)), F.lit(bound))
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        outside = (moved <= F.col("new_low")) | (moved >= F.col("new_high"))
        done = F.col("at_limit") | (F.abs(miss) <= F.greatest(F.col("target") * 1e-7, F.lit(1e-3)))
        nearer = state.join(sums, state["place"] == sums["p"]).withColumn("new_low", low).withColumn("new_high", high)
        halfway = (F.col("new_low") + F.col("new_high")) / 2
        state = written(
            nearer.select(
                *fixed,
                F.when(done, F.col("tilt")).when(F.coalesce(outside, F.lit(False)), halfway).otherwise(moved).alias("tilt"),
                F.col("new_low").alias("low"),
                F.col("new_high").alias("high"),
                done.alias("done"),
            )
        )
        if state.filter("not done").isEmpty():
            break
        state = state.drop("done")
    return state.select(*fixed, "tilt")


def _key(copy: int, limit: float, seed: int) -> Column:
    chance = F.pmod(F.xxhash64("doc_id", "size", "source", F.lit(seed)), F.lit(UNIT)) / F.lit(float(UNIT))
    return F.floor((copy - _rate(limit) - chance + limit) * UNIT).cast("long")


def cuts(rows: DataFrame, sources: DataFrame, limit: int = LIMIT, seed: int = 1, passes: int = PASSES) -> DataFrame:
    """``sources`` with arrays ``cut`` and ``fit``: a copy is taken if for some k its key is
    below cut[k] and its document has at most fit[k] words.

    The first pass stops at the document that would go over the target; later passes fill
    what is missing with documents that still fit.
    """
    top_bits = (int(limit + 1) * UNIT - 1).bit_length()
    levels = -(-top_bits // LEVEL_BITS)
    state = sources.select(
        "*", F.array().cast("array<bigint>").alias("cut"), F.array().cast("array<bigint>").alias("fit"),
        F.floor("target").cast("long").alias("need"),
    )
    state = written(state)
    for _ in range(passes):
        state = written(
            state.withColumn("fit", F.concat("fit", F.array("need"))).withColumn("base", F.lit(0).cast("long")).withColumn("whole", F.lit(False))
        )
        for level in range(levels - 1, -1, -1):
            shift = level * LEVEL_BITS
            at = _with_sources(rows, state)
            units = at.filter("size > 0").withColumn("key", F.explode(F.array(*[_key(j, limit, seed) for j in range(1, limit + 1)])))
            open_unit = (F.col("size") <= F.element_at("fit", -1)) & ~_taken("key") & ~F.col("whole")
            inside = F.expr(f"shiftright(key, {shift + LEVEL_BITS}) = shiftright(base, {shift + LEVEL_BITS})")
            bins = units.filter(open_unit & inside).groupBy("place", F.expr(f"shiftright(key, {shift})").alias("bin")).agg(F.sum("size").alias("words"))
            running = F.sum("words").over(Window.partitionBy("place").orderBy("bin"))
            over = bins.withColumn("running", running).join(state.select("place", "need"), "place")
            found = over.groupBy("place").agg(
                F.min(F.when(F.col("running") > F.col("need"), F.col("bin"))).alias("bin"),
                F.max(F.when(F.col("running") <= F.col("need"), F.col("running"))).alias("below"),
            )
            joined = state.join(found.withColumnRenamed("place", "p"), F.col("place") == F.col("p"), "left")
            keep = [c for c in state.columns if c not in ("base", "need", "whole")]
            none_over = F.col("bin").isNull() & ~F.col("whole")
            state = written(
                joined.select(
                    *keep,
                    F.when(F.col("whole"), F.col("base")).when(none_over, F.lit(ALL)).otherwise(F.expr(f"shiftleft(bin, {shift})")).alias("base"),
                    (F.col("need") - F.coalesce("below", F.lit(0))).alias("need"),
                    (F.col("whole") | none_over).alias("whole"),
                )
            )
        state = state.withColumn("cut", F.concat("cut", F.array("base"))).drop("base", "whole")
        state = written(state)
        if state.filter("need > 0.001 * target and need > 0").isEmpty():
            break
    return state.drop("need")


def _taken(key: str) -> Column:
    """Whether the cuts made so far take the copy with this key."""
    made = F.size("cut")
    pairs = F.arrays_zip(F.col("cut").alias("c"), F.slice(F.col("fit"), F.lit(1), made).alias("f"))
    return F.exists(pairs, lambda x: (F.col(key) < x["c"]) & (F.col("size") <= x["f"]))


def mixing_plan(
    rows: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: int = 1
) -> DataFrame:
    """Per source: source_size, target, tilt and cuts, from sized rows (doc_id, source, size)."""
    summary = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = with_targets(ranked(written(summary)), weights, share, limit)
    return written(cuts(rows, tilts(rows, written(targets), limit), limit, seed))


def with_copies(rows: DataFrame, plan: DataFrame, limit: int = LIMIT, seed: int = 1) -> DataFrame:
    """Rows (doc_id, source, size, ...) with source_size, target and ``copies`` of each."""
    out = _with_sources(rows, plan)
    copies = F.lit(0)
    for j in range(1, limit + 1):
        out = out.withColumn(f"_key{j}", _key(j, limit, seed))
        copies = copies + _taken(f"_key{j}").cast("int")
    return out.select(*rows.columns, "source_size", "target", F.when(F.col("size") == 0, 1).otherwise(copies).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken.

    Sources in order of code points, null last, weigh 3, 1, 2 and so on; together they
    get ``share`` of all words, none more than ``limit`` times what it has. ``taken`` is
    copies * size, and copies is at most ``limit``. Texts without words are taken once, which
    costs nothing. Rows that repeat (id, source and size) are taken equally often. A null
    source is a source. An empty table gives no rows. Other columns are ignored.
    """
    rows = written(sized(docs, id_col, text_col, source_col))
    out = with_copies(rows, mixing_plan(rows, **how), how.get("limit", LIMIT), how.get("seed", 1))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, all columns as they are."""
    rows = written(sized(docs, id_col, text_col, source_col))
    plan = mixing_plan(rows, **how)
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )
    counted = with_copies(own, plan, how.get("limit", LIMIT), how.get("seed", 1)).select("_row", "copies").filter("copies > 0")
    return counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")
