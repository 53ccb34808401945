"""Session settings for local runs and the place where staged tables are written."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Collection, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(app: str = "tallyspark", cores: str | None = None, partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    master = f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]"
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "6g"))
        # The JVM leaves methods above 8000 bytes of bytecode interpreted; beyond that
        # size separate operators are faster than one fused stage.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a new local folder only when
    none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="tally-ckpt-")


_STAGED: list[str] = []


def drop_staged(spark: SparkSession, since: int = 0, keep: Collection[str] = ()) -> int:
    """Remove the tables this process has staged, from number ``since`` on and but for those
    in ``keep``; returns their number. To be called when their results have been read, at
    the latest before the session ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    gone = [p for p in _STAGED[since:] if p not in keep]
    for name in gone:
        table = path(name)
        table.getFileSystem(spark._jsc.hadoopConfiguration()).delete(table, True)
        _STAGED.remove(name)
    return len(gone)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Remove the tables staged inside at the end, but for those written with the function
    that is given: they are whole by then and need no other."""
    since, kept = len(_STAGED), []

    def keep(df: DataFrame) -> DataFrame:
        out = written(df)
        kept.append(_STAGED[-1])
        return out

    yield keep
    drop_staged(spark, since, kept)


#: Spark removes the shuffle files of a query when it has ended, not when the driver forgets them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of each query that runs inside as soon as it has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a new table in the checkpoint folder and read it back.

    The plan behind it runs once, however often the result is used, and a lost
    executor costs no recomputation. What it shuffled is removed when the table is
    whole; the table stays until ``drop_staged``.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    _STAGED.append(path)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes that one round reads, and rounds at most: each reads the input again.
ROUND, MAX_ROUNDS = 2**27, 8


def rounds_of(*tables: DataFrame) -> int:
    """Rounds by the size of the files that ``tables`` are read from; rows in memory are one round."""
    total = 0
    for df in tables:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        # A source that does not know its size says the greatest number.
        total += sum(n for n in sizes if n < 2**60)
    return max(1, min(MAX_ROUNDS, -(-total // ROUND)))


def in_rounds(
    make: Callable[..., DataFrame], key: str, *tables: DataFrame, rounds: int | None = None, write: Callable[[DataFrame], DataFrame] = written
) -> DataFrame:
    """``make(*tables)`` where no row depends on two values of ``key``, for some values after the
    others: what a round shuffles is removed before the next one."""
    n = rounds or rounds_of(*tables)
    if n == 1:
        return write(make(*tables))
    part = F.pmod(F.xxhash64(key), F.lit(n))
    return reduce(DataFrame.unionByName, [write(make(*[t.filter(part == k) for t in tables])) for k in range(n)])
