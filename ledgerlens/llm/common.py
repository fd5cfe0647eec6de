"""What several operators of this subpackage share: tables, shared storage, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch: texts can be long, and each task holds a batch in several forms.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes at most."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).rstrip("b")  # bytes are given as 64b
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def in_blocks(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, size: int = 1024) -> np.ndarray:
    """f of the rows of x, ``size`` at a time, so that what f makes on its way stays small."""
    return np.concatenate([f(x[i : i + size]) for i in range(0, max(1, len(x)), size)])


class Bins:
    """Chunks, numbered by cell and part, in bins of chunks that follow each other: what meets chunks of a bin is sent there once.

    parts: the number of parts of each cell. Up to LEAST chunks have a bin each; above that bins hold CHUNKS at least.
    """

    LEAST, CHUNKS = 48, 24

    def __init__(self, parts: np.ndarray):
        self.first = np.append(0, np.cumsum(parts))
        total = int(self.first[-1])
        self.n = min(total, max(self.LEAST, total // self.CHUNKS))

    def of(self, cell: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (self.first[cell] + part) * self.n // self.first[-1]

    def cells(self) -> list[np.ndarray]:
        """The cells that have chunks in each bin."""
        number = np.arange(self.first[-1])
        cell = np.searchsorted(self.first, number, side="right") - 1
        own = number * self.n // self.first[-1]
        return [np.unique(cell[a:b]) for a, b in zip(np.searchsorted(own, range(self.n)), np.searchsorted(own, range(self.n), side="right"))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input; also sees to small Arrow batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is named, on local masters only (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
    kept = getattr(shared_dir, "own", None)
    if kept is None:
        kept = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
    return kept


def materialize(spark: SparkSession, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder (in folders ``by`` a column) and read it again, which cuts its lineage.

    The files survive a lost executor; they are removed when the session's JVM ends. Shuffle files are removed once
    the table is written.
    """
    path = f"{shared_dir(spark)}/ledgerlens-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def discard(spark: SparkSession, df: DataFrame, part: str = "") -> None:
    """Remove the files of a materialised table (or one folder of them) that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{df.stage_path}/{part}" if part else df.stage_path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u long, v long); component is the least node.

    Alternating large-star and small-star rounds: each is one aggregation and one
    join on the node, so no neighbourhood is ever gathered in one place; minima
    are combined before the shuffle. Rounds grow with the logarithm of the
    longest path. Each round is written to shared storage.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def large_star(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = least(down)
        moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(low.select("u", F.col("m").alias("v")))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = materialize(spark, edges, "edges")
    before = mark(edges)
    if before[0] == 0:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        last = edges
        edges = materialize(spark, small_star(large_star(last)).where("u <> v").distinct(), "edges")
        discard(spark, last)
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.union(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
