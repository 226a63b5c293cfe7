"""What the operators share: checkpoints, bounded label samples and Arrow slices."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    One of our own is set only where that setting is absent and Spark runs in one process.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder, which takes less room than a checkpoint; it goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_exit(spark, path)
    return spark.read.parquet(path)


def gone_at_exit(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key alone; null keys give null."""
    return F.when(key.isNotNull(), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)))


def bounded_sample(rows: DataFrame, key: str, strata: str, bound: int, seed: int = 1) -> DataFrame:
    """About `bound` rows of each stratum (all, where it has fewer), chosen by a hash of the key.

    Used to fit classifiers alone. Strata must be few; one aggregation counts them.
    """
    counts = {r[0]: r[1] for r in rows.filter(F.col(strata).isNotNull()).groupBy(strata).count().collect()}
    share = F.lit(None).cast("double")
    for value, n in sorted(counts.items(), key=str):
        share = F.when(F.col(strata) == F.lit(value), F.lit(min(1.0, bound / n))).otherwise(share)
    return rows.filter(F.col(strata).isNotNull() & (unit(F.col(key), seed) < share))


def slices(col: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with at most about `most` bytes of text each, a row at least."""
    if len(col) == 0:
        return
    ends = np.frombuffer(col.buffers()[1], dtype=np.int32 if pa.types.is_string(col.type) or pa.types.is_binary(col.type) else np.int64)
    ends = ends[col.offset : col.offset + len(col) + 1].astype(np.int64)
    start = 0
    while start < len(col):
        stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
        stop = min(len(col), max(stop, start + 1))
        yield start, stop
        start = stop


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same map; when a partition ends, the worker gives what it has freed back to the system, as it may then idle for long."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return outer


def flat(value) -> pa.Array:
    """One contiguous array, without chunks or dictionary."""
    if isinstance(value, pa.ChunkedArray):
        value = value.combine_chunks()
    return value


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_sample(df: DataFrame, sample: DataFrame, key: str, most: int = 200_000) -> DataFrame:
    """df joined with a sample that a parameter bounds: broadcast where its rows, counted, are few; else shuffled."""
    sample = checkpoint(sample)
    return df.join(F.broadcast(sample) if sample.count() <= most else sample, key)
