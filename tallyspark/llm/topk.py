"""Exact top-k search by inner product, block at a time.

A term is a component and its sign. Rows are ordered by their main term and cut into
blocks of neighbouring rows; a block keeps its rows (the forward index) and, per term,
the largest value in it. A query orders blocks by the sum of these maxima weighted by
its own terms, the most that any row of the block can score, and scores blocks whole
until the next bound is below its k-th score so far. That score starts from the block
the query itself lies in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyspark.llm.common import written

BLOCK_ROWS = 256
#: Blocks of one part and queries of one group meet in one task.
PART_ROWS, GROUP_QUERIES = 4_096, 2_048
NONE = -(1 << 63) + 1
STORED = "block long, kind int, ids binary, rows binary, high binary, low binary, floors binary"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and v, the floor of ``scale`` times each component; rows with null or
    non-finite components or without an id are left out. What does not fit a long is an error."""
    scaled = f"{float(scale)}D * cast(x as double)"
    whole = f"if(abs({scaled}) < 9.2e18D, floor({scaled}), cast(raise_error('component beyond a long') as bigint))"
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v")).filter(
        "vec_id is not null and v is not null "
        "and not exists(v, x -> x is null or isnan(x) or abs(cast(x as double)) = double('infinity'))"
    ).select("vec_id", F.expr(f"transform(v, x -> {whole})").alias("v"))


def _products(a: np.ndarray, b: np.ndarray, bound: bool = False) -> np.ndarray:
    """a @ b.T in whole numbers; by floats only where these are exact. A product that does not fit
    a long is an error; a ``bound`` is held to the largest long, which no score exceeds."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if bound:
        exact = np.clip(exact, NONE, -NONE)
    elif exact.size and not NONE < exact.min() <= exact.max() <= -NONE:
        raise OverflowError("a score does not fit a long")
    return exact.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, ties to smaller ids."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def blocks(rows: DataFrame, dims: int, every: int, k: int, parts: int, kind: type = np.int32) -> DataFrame:
    """Stored blocks (kind 0) and, next to each, the queries that lie in it (kind 1) with
    the score their k-th hit has at least. Components are stored as ``kind``."""
    # The main term: the place of the largest component, with its sign.
    largest = "array_max(transform(v, x -> abs(x)))"
    main = F.expr(f"coalesce(array_position(v, {largest}) * 2, 0) + coalesce(array_position(v, -{largest}) * 2 + 1, 0)")
    ordered = rows.withColumn("term", main).repartitionByRange(parts, "term", "vec_id")
    ordered = ordered.sortWithinPartitions("term", "vec_id").select("vec_id", "v")

    def stored(number: int, ids: list[int], vectors: list) -> list[dict]:
        ids_ = np.array(ids, dtype=np.int64)
        matrix = np.zeros((len(ids), dims), dtype=kind)
        for row, v in zip(matrix, vectors):
            row[: len(v)] = v
        out = [
            {
                "block": number, "kind": 0, "ids": ids_.tobytes(), "rows": matrix.tobytes(), "floors": b"",
                "high": matrix.max(axis=0).tobytes(), "low": matrix.min(axis=0).tobytes(),
            }
        ]
        asks = np.flatnonzero(ids_ % every == 0)
        if len(asks):
            scores = _products(matrix[asks].astype(np.int64), matrix.astype(np.int64))
            scores[ids_[asks][:, None] == ids_[None, :]] = NONE
            floors = np.full(len(asks), NONE, dtype=np.int64)
            if len(ids) >= k:
                floors = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            out.append(
                {
                    "block": number, "kind": 1, "ids": ids_[asks].tobytes(), "rows": matrix[asks].tobytes(),
                    "floors": floors.tobytes(), "high": b"", "low": b"",
                }
            )
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, ids, vectors = TaskContext.get().partitionId() << 32, [], []
        for batch in batches:
            for i, v in zip(batch["vec_id"].tolist(), batch["v"]):
                ids.append(i)
                vectors.append(v)
                if len(ids) == BLOCK_ROWS:
                    yield pd.DataFrame(stored(number, ids, vectors))
                    number, ids, vectors = number + 1, [], []
        if ids:
            yield pd.DataFrame(stored(number, ids, vectors))

    return ordered.mapInPandas(run, STORED)


def search_cell(found: pd.DataFrame, dims: int, k: int, kind: type = np.int32) -> pd.DataFrame:
    """Hits of the queries among the blocks of one cell (rows as stored)."""
    held, asks = found[found["kind"] == 0], found[found["kind"] == 1]
    empty = pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
    if len(held) == 0 or len(asks) == 0:
        return empty
    read = lambda column, kind: [np.frombuffer(x, dtype=kind) for x in column]
    q_ids = np.concatenate(read(asks["ids"], np.int64))
    q = np.concatenate(read(asks["rows"], kind)).reshape(len(q_ids), dims).astype(np.int64)
    row = np.concatenate([b * BLOCK_ROWS + np.arange(len(i) // 8) for b, i in zip(asks["block"], asks["ids"])])
    floor = np.concatenate(read(asks["floors"], np.int64))
    ids = read(held["ids"], np.int64)
    rows = [m.reshape(-1, dims).astype(np.int64) for m in read(held["rows"], kind)]
    high, low = (np.stack(read(held[c], kind)).astype(np.int64) for c in ("high", "low"))
    # Both sides at once, so that no sum of two bounds runs over.
    bound = _products(np.hstack([np.maximum(q, 0), np.minimum(q, 0)]), np.hstack([high, low]), bound=True)
    order = np.argsort(-bound, axis=1, kind="stable")
    top, top_ids = np.full((len(q), k), NONE, dtype=np.int64), np.full((len(q), k), (1 << 63) - 1, dtype=np.int64)
    for place in range(order.shape[1]):
        block = order[:, place]
        kth = np.maximum(floor, top[:, -1])
        active = np.flatnonzero(bound[np.arange(len(q)), block] >= kth)
        if len(active) == 0:
            break
        for b in np.unique(block[active]):
            who = active[block[active] == b]
            scores = _products(q[who], rows[b])
            scores[q_ids[who][:, None] == ids[b][None, :]] = NONE
            some = (scores >= kth[who][:, None]).any(axis=1)
            who, scores = who[some], scores[some]
            if len(who):
                all_ids = np.concatenate([top_ids[who], np.broadcast_to(ids[b], scores.shape)], axis=1)
                top[who], top_ids[who] = _best(np.concatenate([top[who], scores], axis=1), all_ids, k)
    x, y = np.nonzero((top > NONE) & (top >= floor[:, None]))
    return pd.DataFrame({"query_row": row[x], "query_id": q_ids[x], "vec_id": top_ids[x, y], "score": top[x, y]})


def top_k(
    vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Per query its k best rows: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every``, candidates all rows with another
    id; fewer than k candidates are all returned. Ties go to the smaller id. Rows with
    null or non-finite components, a null vector or a null id take no part; a shorter vector, also
    one without components, ends in zeros. A component or score that does not fit a long is an
    error, never another number. A repeated candidate is
    returned as often as it occurs, a repeated query is answered each time. An empty table
    gives no rows. Other columns are ignored.
    """
    rows = integer_vectors(vectors, id_col, vector_col)
    asked = F.sum((F.col("vec_id") % every == 0).cast("long"))
    largest = F.max(F.expr("array_max(transform(v, x -> abs(x)))"))
    dims, count, queries, most = rows.agg(F.max(F.size("v")), F.count(F.lit(1)), asked, largest).first()
    dims, kind = max(1, dims or 0), np.int32 if (most or 0) < 1 << 31 else np.int64
    parts, groups = max(1, -(-count // PART_ROWS)), max(1, -(-(queries or 0) // GROUP_QUERIES))
    stored = written(blocks(rows, dims, every, k, parts, kind))
    # The range of an order is found by sampling, so parts are numbered by block instead.
    spot = F.xxhash64("block")
    held = stored.filter("kind = 0").withColumn("part", F.pmod(spot, F.lit(parts)))
    held = held.withColumn("group", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")))
    asks = stored.filter("kind = 1").withColumn("part", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")))
    asks = asks.withColumn("group", F.pmod(spot, F.lit(groups)))
    cells = held.unionByName(asks).groupBy("part", "group")
    hits = cells.applyInPandas(
        lambda found: search_cell(found, dims, k, kind), "query_row long, query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
