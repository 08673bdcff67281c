"""Shared helpers: tables in the folder all executors share, and Arrow-batch mapping."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders made by operators and not yet cleared, by application id.
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset (tests on one machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tabwright-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark)}/tabwright/{name}-{uuid.uuid4().hex}"
    written(spark).append(path)
    return path


def shared_table(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once and survives lost executors.

    Where rows are of many kilobytes ``group_rows`` bounds those of a row group: a reader decodes up to 4,096 rows of one at
    a time, arrays too.
    """
    path = new_folder(df.sparkSession, name)
    options = {} if group_rows is None else {"parquet.block.row.count.limit": group_rows}
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """The folders that this session's operators have made, in order."""
    return _WRITTEN.setdefault(spark.sparkContext.applicationId, [])


def clear_shared(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of ``written``; call it once the results built on them are stored."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in folders:
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        written(spark).remove(path)


def map_partitions(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow``, after which a worker gives its freed memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand at most ``rows`` rows at once to Python; by default it is 10,000, of whatever size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``map_partitions`` with a function of one batch."""
    return map_partitions(df, lambda batches: (out for batch in batches for out in fn(batch)), schema)


def give_back() -> None:
    """Return memory that this Python worker has freed to the system; idle workers would keep it from later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of 64-bit keys by bucket of their hash, and the runs (bucket, first, end) in it.

    Packed by these runs, what a task sends on is a row per bucket, however many keys it has.
    """
    to = ((keys.astype("<i8").view("<u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.empty(0, np.int64)
    return order, [(int(to[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(to)] if len(to) else [], strict=True)]


def buckets_for(spark: SparkSession, n_bytes: int, each: int = 8 << 20) -> int:
    """Into how many buckets data that a task holds whole is dealt: ``each`` bytes a bucket, so that tasks stay of one size at
    any input, but no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))


def whole_text(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
