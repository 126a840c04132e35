"""Broadcasts whose size is checked first, Arrow batches of bounded bytes, the folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.config import DEFAULT


def small(df: DataFrame, most: int = DEFAULT.broadcast_rows) -> DataFrame:
    """``df`` marked for broadcast if it has ``most`` rows at most; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: A table of fewer bytes is spread over all cores before a costly map: small files are often one row group, hence one task.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame, most: float | None = None) -> DataFrame:
    """``df`` with its rows dealt out over all cores if it is read from fewer files than there are cores and small (so that moving it costs little; ``SPREAD_BYTES`` unless ``most`` is given); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= (SPREAD_BYTES if most is None else most) and 0 < len(df.inputFiles()) < cores else df


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices whose ``column`` holds ``most`` bytes at most (a longer value is a slice of its own)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def checkpoint_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where it is unset, a session on one machine gets a folder of its own; on a cluster that's an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidewell-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read again: for long loops, as nothing of its plan stays on the driver.  The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/tidewell-kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, so that its lineage ends there."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint()
