"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.sizes import checkpoint_folder

#: UTF-8 bytes of text that a Python worker handles at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints, which all executors share; a session on one machine that names none gets its own."""
    return checkpoint_folder(spark)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and any executor can reread it.

    The application owns the files: ``discard`` removes them, and what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return out


def carried(docs: DataFrame, leave: tuple[str, ...] = (), **more: Column) -> DataFrame:
    """``(_row, **more)``: whole rows (but for columns to ``leave``) in one column, so that no name among theirs clashes with what an operator adds."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in leave)).alias("_row"), *(c.alias(n) for n, c in more.items()))


def restored(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The ``carried`` rows' columns again, some replaced by ``new`` values."""
    return df.select(*(new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in columns))


def few(df: DataFrame, most: int = 200_000, most_bytes: int = 32 << 20) -> DataFrame:
    """A staged table as the small side of a join: broadcast if it has ``most`` rows and ``most_bytes`` of files at most, else hashed by its shuffled parts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most_bytes and df.count() <= most else df.hint("shuffle_hash")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any longer."""
    for df in tables:
        if path := getattr(df, "staged_path", None):
            fs, at = _file_system(df.sparkSession, path)
            fs.delete(at, True)


def release() -> None:
    """Give memory that earlier tasks of this worker have freed back to the system: workers live as long as the session, and so would their largest task's memory."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def byte_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices whose ``column`` holds about ``most`` bytes (one longer value makes a slice)."""
    import numpy as np
    import pyarrow.compute as pc

    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
