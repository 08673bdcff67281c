"""Rules over the rows of one subject in order of time: what was last known (as-of), and intervals that overlap.

A subject's rows are cut into chunks of time; a window runs over each chunk, and what a chunk hands to those after it is
carried by a second window over chunks, a row each. So a subject that holds a third of all rows is spread like any
other, unless its rows all fall into a moment. Chunks are as wide as makes about ``CHUNK_ROWS`` of all rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.spec import SpecError

CHUNK_ROWS = 100_000
_UPTO_NOW, _BEFORE = (Window.unboundedPreceding, Window.currentRow), (Window.unboundedPreceding, -1)


def place(column: Column, kind: T.DataType) -> Column:
    """A time, date or number as a number in its order: microseconds, or as it is."""
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(column.cast("timestamp"), F.current_timezone()))
    if isinstance(kind, T.NumericType):
        return column
    raise SpecError(f"rows can't be put in order of time by {kind.simpleString()}")


def _width(rows: DataFrame, at: str, chunk_rows: int) -> float:
    n, low, high = rows.agg(F.count(at), F.min(at), F.max(at)).first()
    return 1.0 if not n or high == low else max(float(high - low) / max(1, -(-n // chunk_rows)), 1e-9)


def _subjects(df: DataFrame, by: list[str]) -> list[Column]:
    return [F.col(f"`{c}`").alias(f"_b{i}") for i, c in enumerate(by)]


def as_of(df: DataFrame, other: DataFrame, by: list[str], time: str, take: Mapping[str, str], other_time: str | None = None, inclusive: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Each row of ``df`` with columns of the latest row of ``other`` of the same subject before it (``inclusive``: or at its time).

    ``take`` maps columns of ``other`` to their names in the result; they are null where there is no such row, or where
    subject or time is null. Of rows of ``other`` at one time the one with the largest values counts.
    """
    other_time, subjects = other_time or time, [f"_b{i}" for i in range(len(by))]
    mine = df.select(*_subjects(df, by), place(F.col(f"`{time}`"), df.schema[time].dataType).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    theirs = other.select(*_subjects(other, by), place(F.col(f"`{other_time}`"), other.schema[other_time].dataType).alias("_t"), F.lit(0 if inclusive else 2).alias("_side"), F.struct(*[F.col(f"`{c}`").alias(n) for c, n in take.items()]).alias("_last"))
    rows = mine.unionByName(theirs.dropna(subset=[*subjects, "_t"]), allowMissingColumns=True)
    rows = rows.withColumn("_chunk", F.floor(F.col("_t") / _width(rows, "_t", chunk_rows)))
    within = Window.partitionBy(*subjects, "_chunk").orderBy("_t", "_side", "_last").rowsBetween(*_UPTO_NOW)
    seen = rows.withColumn("_here", F.last("_last", ignorenulls=True).over(within)).where("_side = 1")
    ends = rows.where("_last IS NOT NULL").groupBy(*subjects, "_chunk").agg(F.max(F.struct("_t", "_last"))["_last"].alias("_end"))
    marks = seen.groupBy(*subjects, "_chunk").agg(F.lit(None).cast(ends.schema["_end"].dataType).alias("_end")).unionByName(ends)
    marks = marks.groupBy(*subjects, "_chunk").agg(F.max("_end").alias("_end"))  # chunks that either side has
    carried = marks.withColumn("_carried", F.last("_end", ignorenulls=True).over(Window.partitionBy(*subjects).orderBy("_chunk").rowsBetween(*_BEFORE))).select(*subjects, "_chunk", "_carried")
    found = seen.join(carried, [*subjects, "_chunk"], "left")
    return found.select("_row.*", *[F.coalesce("_here", "_carried")[n].alias(n) for n in take.values()])


def overlapping(df: DataFrame, by: list[str], start: str, end: str, key: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows whose interval, from ``start`` up to but without ``end``, begins before all earlier ones of the subject have ended.

    Earlier is by start, then by key. Rows with a null in subject, start or end overlap with none; an interval that ends
    before it starts holds no time, but may lie in another.
    """
    subjects = [f"_b{i}" for i in range(len(by))]
    rows = df.select(*_subjects(df, by), place(F.col(f"`{start}`"), df.schema[start].dataType).alias("_s"), place(F.col(f"`{end}`"), df.schema[end].dataType).alias("_e"), F.struct(*[F.col(f"`{k}`") for k in key]).alias("_k"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    rows = rows.dropna(subset=[*subjects, "_s", "_e"])
    rows = rows.withColumn("_chunk", F.floor(F.col("_s") / _width(rows, "_s", chunk_rows)))
    here = F.max("_e").over(Window.partitionBy(*subjects, "_chunk").orderBy("_s", "_k").rowsBetween(*_BEFORE))
    ends = rows.groupBy(*subjects, "_chunk").agg(F.max("_e").alias("_end"))
    carried = ends.select(*subjects, "_chunk", F.max("_end").over(Window.partitionBy(*subjects).orderBy("_chunk").rowsBetween(*_BEFORE)).alias("_carried"))
    found = rows.withColumn("_here", here).join(carried, [*subjects, "_chunk"])
    return found.where(F.greatest("_here", "_carried") > F.col("_s")).select("_row.*")


def outside_limits(df: DataFrame, limits: DataFrame, by: list[str], at: str, value: str, begin: str = "begin", end: str = "end", low: str = "low", high: str = "high") -> DataFrame:
    """The rows whose value is outside a limit that holds for their group at their place, with that limit as ``limit_...``.

    ``limits`` has the columns of ``by``, an interval from ``begin`` up to but without ``end``, and inclusive ends ``low``
    and ``high`` of which a null binds nothing. An interval is put into bins of the power of two that is no smaller than
    its length: two bins at most, however long it is; a row looks into the bin of each size that occurs, 64 or so. Bins
    make an equality join, which adaptive execution can split where a group is hot.
    """
    own, theirs = place(F.col(f"`{at}`"), df.schema[at].dataType), lambda c: place(F.col(f"`{c}`"), limits.schema[c].dataType)
    held = limits.select(*_subjects(limits, by), theirs(begin).alias("_from"), theirs(end).alias("_to"), *[F.col(f"`{c}`").alias(f"limit_{n}") for c, n in ((begin, "begin"), (end, "end"), (low, "low"), (high, "high"))])
    held = held.where("_to > _from").withColumn("_level", F.ceil(F.log2((F.col("_to") - F.col("_from")).cast("double"))).cast("int"))
    bin_of = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    levels = [r._level for r in held.select("_level").distinct().collect()]  # sizes, as powers of two
    binned = held.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(F.col("_from")), bin_of(F.col("_to"))))))
    rows = df.select(*_subjects(df, by), own.alias("_at"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{value}`").alias("_value"))
    rows = rows.where(F.col("_at").isNotNull() & F.col("_value").isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_bin", bin_of(F.col("_at")))
    found = rows.join(binned, [*[f"_b{i}" for i in range(len(by))], "_level", "_bin"])
    found = found.where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")) & ((F.col("_value") < F.col("limit_low")) | (F.col("_value") > F.col("limit_high"))))
    return found.select("_row.*", "limit_begin", "limit_end", "limit_low", "limit_high")
