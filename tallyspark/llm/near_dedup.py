"""Near duplicates: MinHash bands find candidates, b-bit signatures weigh them, full sets decide.

Documents with equal shingle sets are one node. Nodes that agree in a band share a bucket.
Candidates are never all pairs of a bucket:

1. every node is held against the central node of each of its buckets (the one whose
   buckets are largest; in a family of edited copies this is the text they come from),
2. what is still apart is compared by signature in blocks of bounded size, outside the
   largest component of the bucket against all of it. Only nodes with a pair that could
   reach the threshold bring their sets; inside the block the likeliest pair of two
   components is held against each other first, and what leaves it are the links that
   join components, fewer than its nodes.

Pairs inside one component are left out at every step, as they cannot change the result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.common import checked_broadcast, scratch, shingle_hashes, texts, word_hashes, written
from tallyspark.llm.components import components

ROWS = 5
MISS = 1e-5
SIGNATURE = 1024
LOW_BITS = 2
SIGMAS = 4
BLOCK = 256
MAX_BROADCAST = 2_000_000


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of ``rows`` minima so that a pair at the threshold is missed with at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def _seeds(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, count, dtype=np.uint32)


def minima(grams: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest hash of a set under every hash function."""
    x, (mul, flip) = (grams >> np.uint64(32)).astype(np.uint32), seeds
    least = np.full(len(mul), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, ((x[at : at + 512, None] ^ flip) * mul).min(axis=0), out=least)
    return least


def low_bits(least: np.ndarray) -> bytes:
    """The two low bits of every minimum, packed."""
    bits = np.empty((len(least), LOW_BITS), dtype=np.uint8)
    for k in range(LOW_BITS):
        bits[:, k] = (least >> np.uint32(k)) & np.uint32(1)
    return np.packbits(bits.T.reshape(-1)).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (last axis: 64-bit words, first half the lowest
    bits): share of equal fields, corrected for fields that agree by chance."""
    half = a.shape[-1] // 2
    other = a ^ b
    unequal = np.bitwise_count(other[..., :half] | other[..., half:]).sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << LOW_BITS)
    return (1 - unequal / SIGNATURE - chance) / (1 - chance)


def gate(percent: int) -> float:
    """The estimate below which a pair is not worth a look: threshold less four standard errors."""
    t, chance = percent / 100, 1 / (1 << LOW_BITS)
    p = t + (1 - t) * chance
    return t - SIGMAS * math.sqrt(p * (1 - p) / SIGNATURE) / (1 - chance)


def _words(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint64).reshape(len(column), SIGNATURE * LOW_BITS // 64)


def banded(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per document (doc_id, text): size and digest of its shingle set and its band keys."""
    bands = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(bands * ROWS, 1)
        powers = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, ROWS + 1)], dtype=np.uint64)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column("text"):
                grams = shingle_hashes(word_hashes(text.as_py()), words)
                sizes.append(len(grams))
                if len(grams) == 0:
                    digests.append(None)
                    keys.append(None)
                    continue
                digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                least = minima(grams, seeds).reshape(bands, ROWS).astype(np.uint64)
                key = (least * powers).sum(axis=1) + np.arange(bands, dtype=np.uint64)
                key ^= key >> np.uint64(31)
                keys.append((key * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
            made = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            # Ids pass as they are: no float in between.
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_shingles", "digest", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<bigint>")


def signed(docs: DataFrame, words: int) -> DataFrame:
    """Per document: its packed signature and its whole shingle set as sorted 64-bit hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = _seeds(SIGNATURE, 2)
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.iloc[at : at + 500]
                sets = [shingle_hashes(word_hashes(t), words) for t in some["text"]]
                yield pd.DataFrame(
                    {
                        "node": some["doc_id"].to_numpy(),
                        "size": [len(g) for g in sets],
                        "sig": [low_bits(minima(g, seeds)) for g in sets],
                        "grams": [g.tobytes() for g in sets],
                    }
                )

    return docs.mapInPandas(run, "node long, size long, sig binary, grams binary")


def _two_sides(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    for side in ("a", "b"):
        picked = nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(picked, side)
    return pairs


def _sizes_allow(percent: int):
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    return 100 * small >= percent * large


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate could reach the threshold, with that estimate."""
    least = gate(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                out = batch[["a", "b"]].assign(est=estimate(_words(batch["sig_a"]), _words(batch["sig_b"])))
                yield out[out["est"] >= least]

    both = _two_sides(pairs, nodes, "size", "sig").filter(_sizes_allow(percent))
    return both.select("a", "b", "sig_a", "sig_b").mapInPandas(run, "a long, b long, est double")


def are_linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets of distinct hashes reach the threshold."""
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def confirmed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [[np.frombuffer(g, dtype=np.uint64) for g in batch[c]] for c in ("grams_a", "grams_b")]
            yield batch.loc[[are_linked(x, y, percent) for x, y in zip(*sets)], ["a", "b"]]

    return _two_sides(pairs, nodes, "grams").select("a", "b", "grams_a", "grams_b").mapInPandas(run, "a long, b long")


class Grouping:
    """Which component each node is in so far; links only ever join components."""

    def __init__(self, nodes: DataFrame, percent: int):
        self.nodes, self.percent = nodes, percent
        self.of = written(nodes.select("node", F.col("node").alias("comp")))
        self.tested: DataFrame | None = None

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs between different components."""
        return _two_sides(pairs, self.of, "comp").filter("comp_a <> comp_b").drop("comp_a", "comp_b")

    def join(self, pairs: DataFrame) -> None:
        """Confirm pairs on full sets and join the components of those that hold."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = written(pairs)
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        self.merge(confirmed(pairs, self.nodes, self.percent))

    def merge(self, links: DataFrame) -> None:
        """Join the components of confirmed links (a, b)."""
        edges = _two_sides(written(links), self.of, "comp")
        merged = written(components(edges, "comp_a", "comp_b"))
        moved = merged.select(F.col("node").alias("comp"), F.col("component").alias("to"))
        self.of = written(
            self.of.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        )


def _blocks(members: DataFrame, group: Grouping, hubs: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, dealt to blocks.

    Nodes outside the largest component of a bucket ("small") meet all its nodes. Both are
    cut into blocks of about BLOCK nodes, and every block of one meets every block of the
    other in a group of its own.
    """
    placed = written(members.join(group.of, "node"))
    counts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    per_key = counts.groupBy("key").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")
    )
    live = per_key.filter("comps > 1 and n > 2").select(
        "key",
        F.col("main.comp").alias("main"),
        F.ceil(F.col("n") / BLOCK).cast("long").alias("wide"),
        F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("long").alias("narrow"),
    )
    rows = placed.join(written(live.join(hubs.select("key", "hub"), "key")), "key")
    spot = F.xxhash64("node")
    everyone = rows.withColumn("i", F.pmod(spot, "wide")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("narrow") - 1)))
    few = rows.filter("comp <> main")
    few = few.withColumn("j", F.pmod(spot, "narrow")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    columns = ["key", "i", "j", "node", "comp", "hub"]
    return everyone.select(*columns, F.lit(False).alias("small")).unionByName(few.select(*columns, F.lit(True).alias("small")))


def _open_pairs(few: pd.DataFrame, rest: pd.DataFrame, percent: int) -> np.ndarray:
    """Estimates of the pairs of two components that could be linked, -1 for all others.

    The hub of a bucket has been held against all its nodes before."""
    est = estimate(_words(few["sig"])[:, None, :], _words(rest["sig"])[None, :, :])
    hub, a, b = few["hub"].iloc[0], few["node"].to_numpy(), rest["node"].to_numpy()
    size_a, size_b = few["size"].to_numpy()[:, None], rest["size"].to_numpy()[None, :]
    open_pair = few["comp"].to_numpy()[:, None] != rest["comp"].to_numpy()[None, :]
    open_pair &= (a != hub)[:, None] & (b != hub)[None, :]
    open_pair &= 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    return np.where(open_pair & (est >= gate(percent)), est, -1.0)


def spanning_links(few: pd.DataFrame, rest: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between ``few`` and ``rest`` that join all components their links join.

    The likeliest pair is tried first, and none whose components are joined already."""
    est = _open_pairs(few, rest, percent)
    x, y = np.nonzero(est >= 0)
    order = np.argsort(-est[x, y], kind="stable")
    parent: dict[int, int] = {}

    def root(comp: int) -> int:
        while (up := parent.get(comp, comp)) != comp:
            parent[comp] = parent.get(up, up)
            comp = up
        return comp

    sides = [(d["node"].tolist(), d["comp"].tolist(), d["grams"].tolist()) for d in (few, rest)]
    (node_a, comp_a, set_a), (node_b, comp_b, set_b) = sides
    links = []
    for i, j in zip(x[order].tolist(), y[order].tolist()):
        p, q = root(comp_a[i]), root(comp_b[j])
        if p != q and are_linked(np.frombuffer(set_a[i], np.uint64), np.frombuffer(set_b[j], np.uint64), percent):
            parent[p] = q
            links.append((node_a[i], node_b[j]))
    return links


def _block_links(blocks: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) inside the blocks, no more of a block than it has nodes."""

    def halves(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        return rows[rows["small"]], rows[~rows["small"]]

    def active(rows: pd.DataFrame) -> pd.DataFrame:
        few, rest = halves(rows)
        if len(few) == 0 or len(rest) == 0:
            return rows.iloc[:0].drop(columns=["size", "sig"])
        hit = _open_pairs(few, rest, percent) >= 0
        return pd.concat([few[hit.any(axis=1)], rest[hit.any(axis=0)]]).drop(columns=["size", "sig"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        few, rest = halves(rows)
        links = spanning_links(few, rest, percent) if len(few) and len(rest) else []
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    signed_rows = blocks.join(nodes.select("node", "size", "sig"), "node").select(*blocks.columns, "size", "sig")
    some = written(signed_rows.groupBy("key", "i", "j").applyInPandas(active, blocks.schema))
    whole = some.join(nodes.select("node", "size", "sig", "grams"), "node")
    return whole.groupBy("key", "i", "j").applyInPandas(join, "a long, b long").distinct()


def shared_buckets(entries: DataFrame) -> DataFrame:
    """Entries (node, key, ...) of keys that occur more than once, with ``n``, how often.

    Counted and written first: both sides of the join then have a shuffle of their own, so
    Spark can split a key that very many nodes share.
    """
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return entries.join(written(shared), "key")


def linked(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Nodes with their component (node, comp).

    ``members`` (node, key, n) are the nodes of shared buckets, ``nodes`` (node, size, sig,
    grams) their signatures and sets.
    """
    central = written(members.groupBy("node").agg(F.sum("n").alias("weight")))
    hubs = members.join(central, "node").groupBy("key")
    hubs = written(hubs.agg(F.max(F.struct("weight", F.expr("~node").alias("minus"))).alias("top"))).select(
        "key", F.expr("~top.minus").alias("hub")
    )
    group = Grouping(nodes, percent)
    pairs = members.join(hubs, "key").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    likely = written(estimated(pairs, nodes, percent))
    group.join(likely.groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b")))
    group.join(group.apart(likely.select("a", "b")))
    blocks = written(_blocks(members.select("node", "key"), group, hubs))
    if not blocks.isEmpty():
        group.merge(_block_links(blocks, nodes, percent))
    return group.of


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * common >= ``percent`` * united distinct runs of
    ``words`` words (A-Z lower-cased). component_id is the smallest id reachable over
    links; kept says that it is the document's own. A text of fewer words is one run, one
    without words, empty or null is linked with nothing. A link at the threshold is missed
    with a chance of about 1e-5 (bands) plus 3e-5 (estimate); no pair below it is linked.
    Rows that repeat an id with other text are one node with it; a null id stays by itself.
    An empty table gives no rows. Other columns are ignored.
    """
    source = texts(docs, id_col, text_col)
    with scratch(docs.sparkSession) as keep:
        made = written(banded(source, words, percent))
        rows = keep(made.drop("keys"))
        full = made.filter("digest is not null and doc_id is not null")
        # Equal sets are one node, named by its smallest id.
        equal = written(full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")))
        members = written(shared_buckets(equal.select("node", F.explode("keys").alias("key"))))
        wanted = checked_broadcast(members.select(F.col("node").alias("doc_id")).distinct(), MAX_BROADCAST)
        nodes = written(signed(source.join(wanted, "doc_id", "left_semi"), words).dropDuplicates(["node"]))
        comps = linked(members, nodes, percent)
        named = equal.select("digest", "node").join(comps, "node", "left")
        named = keep(named.select("digest", F.coalesce("comp", "node").alias("comp")))

    ids = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.coalesce("comp", "doc_id")
    return ids.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def without_near_copies(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the document of the smallest id of each group, all columns as they are.

    Rows that repeat an id stay or go together, rows without an id stay."""
    found = near_duplicates(docs, words, percent, id_col, text_col)
    dropped = written(found.filter("not kept").select(F.col("doc_id").alias("_dropped")).distinct())
    rows = docs.select(F.struct("*").alias("_row"))
    alike = F.col("_row")[id_col] == F.col("_dropped")
    return rows.join(checked_broadcast(dropped, MAX_BROADCAST), alike, "left_anti").select("_row.*")
