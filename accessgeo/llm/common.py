"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: `spark.checkpoint.dir`, or one of our own where that is unset and all runs on this machine."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.conf.get("spark.accessgeo.scratch", None)
        if not at:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            at = "file://" + tempfile.mkdtemp(prefix="accessgeo-")
            spark.conf.set("spark.accessgeo.scratch", at)
    return at.rstrip("/")


#: Paths handed out by `scratch` while a list is noted here.
_noted: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _noted:
        paths.append(path)
    return path


@contextlib.contextmanager
def noted_paths() -> Iterator[list[str]]:
    """The list of all scratch paths handed out inside the block."""
    paths: list[str] = []
    _noted.append(paths)
    try:
        yield paths
    finally:
        # by identity: a block inside this one may have noted just the same paths
        _noted[:] = [x for x in _noted if x is not paths]


def discard(spark: SparkSession, paths: list[str], unless: DataFrame | None = None) -> list[str]:
    """Delete tables in the shared folder, but those that `unless` still reads: these are returned."""
    names = [p.rsplit("/", 1)[-1] for p in paths]
    read = set() if unless is None else {part for f in unless.inputFiles() for part in f.split("/") if part in names}
    for path, name in zip(paths, names, strict=True):
        if name not in read:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return [p for p, name in zip(paths, names, strict=True) if name in read]


def bound_batches(spark: SparkSession, rows: int = 2_000, megabytes: int = 8) -> None:
    """At most `rows` rows or about `megabytes` in an Arrow batch from here on: rows are whole documents, and the
    defaults of 10,000 rows or 64 MB would not fit beside the other tasks of an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def materialise(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Broadcast `df` (materialised) only if it has at most `max_rows` rows; else leave the join to AQE."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def bare(df: DataFrame, **columns) -> DataFrame:
    """Only the named columns, so that extra columns of the input cannot clash with ours."""
    return df.select(*[c.alias(k) for k, c in columns.items()])
