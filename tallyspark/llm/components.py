"""Connected components of a graph of links, by alternating large and small stars.

Every step is one aggregation and one join of narrow rows. A node with very many links
is a hot key of the join only; both sides of that join are read from written tables, so
Spark can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges a > b. Large: neighbours above a node link to its smallest
    neighbour. Small: a node and its neighbours below link to the smallest of these."""
    links = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = written(links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    joined = links.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = down.unionByName(least.select("a", F.col("m").alias("b")))
    return written(out.filter("a <> b").distinct())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per node that has links: node and component, the smallest node it is connected with.

    Links may repeat and point either way; a link of a node with itself does not count.
    """
    edges = written(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    )
    before = _state(edges)
    while before[0]:
        edges = _star(_star(edges, large=True), large=False)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
