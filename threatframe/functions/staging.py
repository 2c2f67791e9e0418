"""Materialising intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

ROWS = 100_000  #: rows of one task of work that costs much on each row

_own: dict[str, str] = {}
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is configured, a local session (tests) gets a temporary folder; a
    cluster gets an error, since its machines share no temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
    return base.rstrip("/")


def removed(spark: SparkSession, path: str) -> bool:
    """Delete a folder in any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def together(*work: Callable[[], object]) -> list:
    """Results of jobs that do not need one another, started at the same time."""
    with ThreadPoolExecutor(len(work)) as pool:
        return [f.result() for f in [pool.submit(copy_context().run, w) for w in work]]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any file system that Spark knows: under another name first, so that it is there whole or not at all."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, part = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.part")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(target, False)
    if not system.rename(part, target):
        raise OSError(f"cannot write {path}")


def read_texts(spark: SparkSession, folder: str) -> dict[str, Callable[[], str]]:
    """The small files of a folder by name, each as a reader."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(folder)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return {}

    def reader(path):
        def read() -> str:
            stream = system.open(path)
            try:
                return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()

        return read

    return {f.getPath().getName(): reader(f.getPath()) for f in system.listStatus(where) if not f.getPath().getName().endswith(".part")}


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end: for work whose results are written elsewhere by then."""
    path = f"{shared_dir(spark)}/threatframe-scope-{uuid.uuid4().hex}"
    token = _scope.set(path)
    try:
        yield
    finally:
        _scope.reset(token)
        removed(spark, path)


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan in partitions of at most ROWS rows, and in as many as there are cores at least, for work that costs
    much on each row.

    A small file is one split however many cores wait, and a split by bytes may hold millions of short rows: without this the
    longest task would grow with the table.
    """
    wanted = max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // ROWS))
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() < wanted else scan


def over_cores(df: DataFrame) -> DataFrame:
    """The rows of df in partitions for three of four cores at least, for work that costs little on each row. Nothing is counted."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * df.rdd.getNumPartitions() < 3 * cores else df


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and every consumer shares it.

    by: a column of few values; a filter on it then reads only its own files.
    """
    path = f"{_scope.get() or shared_dir(df.sparkSession)}/threatframe-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
