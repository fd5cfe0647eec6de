"""Tables that are written once and read several times: they cut lineage and plans, and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staging_folder(spark: SparkSession, name: str) -> str:
    """A new folder in that of spark.checkpoint.dir; on local masters without one, in a temporary folder. It goes when the JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        root = staging_folder.__dict__.setdefault("own", "file://" + tempfile.mkdtemp(prefix="ledgerlens-"))
    path = f"{root}/ledgerlens-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def staged(df: DataFrame, name: str, by: list[str] | None = None, tidy: bool = False) -> DataFrame:
    """``df`` written to a staging folder (in folders ``by`` columns) and read again. tidy: smaller files, and the shuffle files that made them go."""
    path = staging_folder(df.sparkSession, name)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, "false")
    writer = df.write.option("compression", "zstd") if tidy else df.write
    if tidy:
        conf.set(CLEANUP, "true")
    try:
        (writer.partitionBy(*by) if by else writer).parquet(path)
    finally:
        if tidy:
            conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
