"""Summaries of a stream's errors over windows of event time, with late rows counted apart.

Spark's own windowed aggregation drops rows that are later than the watermark, and tells how many partial rows these were
only. Here each micro-batch is grouped by window, column and keyword, its late rows apart, and written under its number:
a batch that is run again replaces what it wrote. A row is late if its window had ended by the watermark of the
batches before: the latest time they held, less the delay. ``window_summary`` adds the batches up; minima, maxima and
counts merge, so a window that holds a third of all rows is a row per batch and kind of error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tabwright.operators.validate import error_rows, key_names
from tabwright.plans.constraints import constraints
from tabwright.spec import SpecCollection

_TIMES = "batch long, latest timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stream_summary(stream: DataFrame, spec: SpecCollection, key: str, time: str, every: str, delay: str, folder: str) -> DataStreamWriter:
    """A query, yet to be started, that summarises errors below ``folder``; started again it goes on from there.

    ``every`` and ``delay`` are intervals such as ``10 minutes``. A row without a time is late.
    """

    def summarise(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = None
        if _exists(spark, f"{folder}/times"):
            latest = spark.read.schema(_TIMES).json(f"{folder}/times/*").where(F.col("batch") < number).agg(F.max("latest")).first()[0]  # a row per batch
        seen = Observation()
        rows = batch.observe(seen, F.max(F.col(f"`{time}`").cast("timestamp")).alias("latest"))
        at, name = F.col(f"`{key_names([time])[time]}`").cast("timestamp"), key_names([key])[key]
        errors = error_rows(rows, constraints(spec, batch), list(dict.fromkeys([key, time])))
        span = F.window(at, every)
        ended = F.lit(False) if latest is None else F.coalesce(span["end"] <= F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {delay}"), F.lit(True))
        errors = errors.withColumn("late", ended | at.isNull())
        # A row without a time has no window, and would be dropped by its making.
        with_time = errors.where(at.isNotNull()).groupBy(span.alias("span"), "column", "keyword", "late")
        without = errors.where(at.isNull()).groupBy(F.lit(None).cast("struct<start:timestamp,end:timestamp>").alias("span"), "column", "keyword", "late")
        found = [F.count(F.lit(1)).alias("n"), F.min(F.col(f"`{name}`")).alias("first_key"), F.max(F.col(f"`{name}`")).alias("last_key")]
        parts = with_time.agg(*found).unionByName(without.agg(*found))
        parts.select("span.start", "span.end", "column", "keyword", "late", "n", "first_key", "last_key").write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")
        moved = max((t for t in (latest, seen.get.get("latest")) if t is not None), default=None)
        spark.createDataFrame([(number, moved)], _TIMES).coalesce(1).write.mode("overwrite").json(f"{folder}/times/batch_{number}")

    return stream.writeStream.foreachBatch(summarise).option("checkpointLocation", f"{folder}/checkpoint")


def window_summary(spark: SparkSession, folder: str) -> DataFrame:
    """(start, end, column, keyword, late, n, first_key, last_key): what all batches so far found."""
    parts = spark.read.parquet(f"{folder}/parts").drop("batch")
    merged = parts.groupBy("start", "end", "column", "keyword", "late")
    return merged.agg(F.sum("n").cast(T.LongType()).alias("n"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
