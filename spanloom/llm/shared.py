"""Helpers that the text operators share: shared storage, cutting lineage, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master may go without one: it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path_of(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


#: The lists of tables that open ``scratch`` blocks free at their end.
_open: list[list[tuple[SparkSession, str]]] = []


def stash(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a DataFrame that reads it.

    This cuts the lineage: a lost executor costs a reread, not a recomputation, and both consumers of
    ``df`` read the same rows. The table goes with ``free``, at the end of a ``scratch`` block, or when the
    driver's JVM ends; with ``keep`` it outlives ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, target = _path_of(spark, path)
    files.deleteOnExit(target)
    if _open and not keep:
        _open[-1].append((spark, path))
    found = spark.read.schema(df.schema).parquet(path)
    found.stashed_at = path
    return found


def free(*tables: DataFrame) -> None:
    """Delete tables that ``stash`` wrote and that nothing reads any more."""
    for df in tables:
        files, target = _path_of(df.sparkSession, df.stashed_at)
        files.delete(target, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Frees the tables stashed within at its end; what is to outlive it is stashed after it or written elsewhere."""
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            files, target = _path_of(spark, path)
            files.delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker holds few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


def drawn(df: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df`` for fitting, drawn by a hash of their columns from all parts of the table.

    Rows are first thinned to about twice as many, so that what reaches the driver does not grow with the
    number of tasks.
    """
    range_ = 1 << 40
    share = min(1.0, 2.0 * rows / max(df.count(), 1))
    h = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(range_))
    return df.withColumn("__drawn", h).where(F.col("__drawn") < int(share * range_)).orderBy("__drawn").limit(rows).drop("__drawn")
