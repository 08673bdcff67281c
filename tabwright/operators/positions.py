"""Numbers of rows: by their places in files, and by any sort key, without a task that sees all rows.

Both count rows of parts first and add these counts up; a row's number is then the count of all parts before its own plus
its place there. What is added up is a row per part, which the driver never sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.operators.shared import written

#: Parts whose counts are broadcast: 16 bytes a part, and what a hash table adds.
BROADCAST_PARTS = 200_000
_IN_PARTITION = (1 << 33) - 1


def _before(sizes: DataFrame, group: str, place: str) -> DataFrame:
    """``sizes`` with ``_before``: rows in all parts before, by group and by place within. Parts of a group are added up in one
    task, and groups in one; these are rows per part and per group."""
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy(group).agg(F.sum("_n").alias("_in_group"))
    groups = groups.select(group, F.coalesce(F.sum("_in_group").over(earlier.orderBy(group)), F.lit(0)).alias("_groups_before"))
    within = sizes.withColumn("_within", F.coalesce(F.sum("_n").over(earlier.partitionBy(group).orderBy(place)), F.lit(0)))
    return within.join(groups, group).withColumn("_before", F.col("_groups_before") + F.col("_within"))


def in_file_order(scan: DataFrame, name: str = "row") -> DataFrame:
    """Rows numbered from 1 in the order of their files' paths and of their places in these.

    ``scan`` is what a reader of files gives, before any other step. Two passes: the first counts the rows of each split of a
    file; in the second each row adds its place in its split. Where the two passes would cut files differently (the
    machines have changed between them) the query fails, rather than number rows wrongly.
    """
    at = F.monotonically_increasing_id()
    split = F.xxhash64("_metadata.file_path", "_metadata.file_block_start")
    placed = scan.select("*", split.alias("_split"), F.spark_partition_id().alias("_part"), at.alias("_at"))
    sizes = scan.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), split.alias("_split"), F.spark_partition_id().alias("_part"), at.alias("_at"))
    sizes = sizes.groupBy("_file", "_start", "_split", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    sizes = written(sizes, "splits")
    offsets = _before(sizes, "_file", "_start").select("_split", "_part", (F.col("_before") - F.col("_first") + 1).alias("_offset"))
    offsets = F.broadcast(offsets) if sizes.count() <= BROADCAST_PARTS else offsets
    number = F.coalesce(F.col("_offset"), F.raise_error(F.lit("files were cut differently in the second pass")).cast("long")) + F.col("_at")
    return placed.join(offsets, ["_split", "_part"], "left").select(*[F.col(f"`{c}`") for c in scan.columns], number.alias(name))


def numbered_by(df: DataFrame, order: list[str], name: str = "row", parts: int | None = None, descending: bool = False) -> DataFrame:
    """Rows numbered from 1 in the order of any columns, nulls last.

    Rows are dealt to ranges of the key by sampled splitters, sorted there and written once with their places. Rows of one
    key are told apart by a digest of the whole row, and those that are alike altogether by where they come from, so a key
    that many rows share is spread over ranges as well. Which of such rows comes first isn't fixed.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_last())
    keys = [end(f"`{o}`") for o in order] + [F.col("_tie"), F.col("_from")]
    rows = df.withColumn("_tie", F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(df.columns)])))).withColumn("_from", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie", "_from")
    rows = written(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))), "ranges")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _before(sizes.withColumn("_block", F.floor(F.col("_part") / 1000)), "_block", "_part").select("_part", "_before")
    return rows.join(F.broadcast(offsets), "_part").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_at") + 1).alias(name))  # a row per range


def chunk_of_rows(df: DataFrame, key: list[str], broken: Column, size: int = 5000, name: str = "row") -> DataFrame:
    """The rows of the first run of ``size`` rows in the order of the key that has a broken one, from that row on, with their
    numbers. Two aggregates and a sort that keeps ``size`` rows; the table is neither sorted nor numbered."""
    own = F.struct(*[F.col(f"`{k}`") for k in key])
    first = df.where(broken).select(F.min(own)).scalar()
    before = df.where(own < first).select(F.count(F.lit(1))).scalar()
    rows = df.where(own >= first).withColumn("_own", own).orderBy("_own").limit(size).withColumn("_before", before)
    rows = rows.withColumn(name, F.col("_before") + F.row_number().over(Window.orderBy("_own")))  # ``size`` rows
    return rows.where(F.ceil(F.col(name) / size) == F.ceil((F.col("_before") + 1) / size)).drop("_before", "_own")
