"""What the operators of this subpackage share: shared storage, slicing of Arrow input, row normalisation."""

from __future__ import annotations

import ctypes
import contextlib
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where it is unset, one for local runs is made."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        found = sc._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else "file://" + os.path.join(tempfile.mkdtemp(prefix="markloom-"), "shared")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def release(spark: SparkSession) -> None:
    """Collects frames that nothing refers to any more, so that Spark deletes the shuffle files of finished steps while
    later ones run, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Paths that `materialize` wrote, by the scopes of `scratch` that are open, the innermost last.
_SCOPES: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialized inside, but for frames written with `kept`, is deleted at the end: no frame that still reads
    it may be used afterwards."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            where, files = _file_system(spark, path)
            files.delete(where, True)


def materialize(df: DataFrame, kept: bool = False) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    The files go when the JVM ends, or with the `scratch` around it; if `kept`, with the next one out."""
    spark = df.sparkSession
    release(spark)
    path = f"{shared_dir(spark).rstrip('/')}/markloom-{uuid.uuid4().hex}"
    scopes = _SCOPES[: len(_SCOPES) - kept]
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one number to the driver."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def tidy() -> None:
    """Gives memory that is free back to the system. A Python worker lives on after its task, and freed arrays would
    stay with it beside those of the next one; elsewhere than with the GNU library only Arrow's are given back."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(f: Callable) -> Callable:
    """`f`, for groups of many rows, with `tidy` after each."""

    @functools.wraps(f)
    def run(*args, **named):
        try:
            return f(*args, **named)
        finally:
            tidy()

    return run


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches again, cut so that a slice holds about `most` bytes of `column`, and one row at least; then `tidy`."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
    tidy()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
