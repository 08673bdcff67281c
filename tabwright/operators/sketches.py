"""Uniqueness over many deliveries by sketches that merge, with an exact pass over what they can't rule out.

A sketch has two bits for each of 2^``bits`` slots that values are hashed to: whether any row, and whether more than one, has
fallen there. Its bitmaps of 4 KB are rows of a table, stored beside a delivery; sketches merge without the deliveries
that they were made of. Rows alike share a slot, so a slot with one row holds no duplicate; only rows in slots with more
are looked at by the exact rule, whose result over them is that over all rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.operators.rules import short_keys, violating_rows
from tabwright.spec import Rule, SpecError

BITS = 32
SIZE = 1 << 15  # bits of a bitmap, as Spark makes them


def _slot(df: DataFrame, rule: Rule, bits: int) -> Column:
    if rule.type != "check_unique":
        raise SpecError(f"rule {rule.id}: only uniqueness has sketches")
    if not 15 <= bits <= 46:
        raise SpecError(f"a sketch has 2^15 to 2^46 slots, not 2^{bits}")
    keys, _ = short_keys(df, rule.column)
    return F.pmod(F.xxhash64(F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))), F.lit(1 << bits))


def sketch(df: DataFrame, rule: Rule, bits: int = BITS) -> DataFrame:
    """(bucket, some, more): the sketch of a table under a uniqueness rule. Rows of a slot are counted, combined before the
    shuffle, so a value that fills the table is one row by then."""
    counts = df.select(_slot(df, rule, bits).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    at = F.pmod(F.col("slot"), F.lit(SIZE))
    return counts.groupBy(F.floor(F.col("slot") / SIZE).alias("bucket")).agg(F.bitmap_construct_agg(at).alias("some"), F.bitmap_construct_agg(F.when(F.col("n") > 1, at)).alias("more"))


def merged(sketches: Iterable[DataFrame]) -> DataFrame:
    """The sketch of all deliveries together, from two of them at a time."""
    parts = list(sketches)
    if not parts:
        raise SpecError("there is no sketch to merge")
    while len(parts) > 1:
        parts = [_two(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def _bits(bitmap: Column) -> Column:
    """A bitmap as 512 numbers of 64 bits."""
    return F.transform(F.sequence(F.lit(0), F.lit(SIZE // 64 - 1)), lambda k: F.conv(F.hex(F.substr(bitmap, k * 8 + 1, F.lit(8))), 16, -10).cast("long"))


def _bitmap(numbers: Column) -> Column:
    return F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _two(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("bucket", F.col("some").alias("sa"), F.col("more").alias("ma")).join(b.select("bucket", F.col("some").alias("sb"), F.col("more").alias("mb")), "bucket", "full")
    either = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseOR(q))
    some = _bitmap(either(_bits(F.col("sa")), _bits(F.col("sb"))))
    more = _bitmap(either(either(_bits(F.col("ma")), _bits(F.col("mb"))), F.zip_with(_bits(F.col("sa")), _bits(F.col("sb")), lambda p, q: p.bitwiseAND(q))))
    shared = F.col("sa").isNotNull() & F.col("sb").isNotNull()  # buckets of one side only come out as they went in
    return both.select("bucket", F.when(shared, some).otherwise(F.coalesce("sa", "sb")).alias("some"), F.when(shared, more).otherwise(F.coalesce("ma", "mb")).alias("more"))


def suspects(df: DataFrame, rule: Rule, of_all: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of a delivery whose slot more than one row of all deliveries has."""
    open_ = of_all.where(F.bitmap_count("more") > 0).select(F.col("bucket").alias("_bucket"), F.col("more").alias("_more"))
    rows = df.withColumn("_slot", _slot(df, rule, bits)).withColumn("_bucket", F.floor(F.col("_slot") / SIZE)).withColumn("_at", F.pmod(F.col("_slot"), F.lit(SIZE)))
    held = F.conv(F.hex(F.substr("_more", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(open_, "_bucket").where(held.bitwiseAND(F.pow(F.lit(2), F.pmod(F.col("_at"), F.lit(8))).cast("int")) > 0).select(*[F.col(f"`{c}`") for c in df.columns])


def duplicates(deliveries: Iterable[DataFrame], rule: Rule, of_all: DataFrame, key: list[str], bits: int = BITS) -> DataFrame:
    """The rows of all deliveries that break a uniqueness rule (all but the first by key of those alike), found among suspects."""
    rows = None
    for df in deliveries:
        own = suspects(df, rule, of_all, bits)
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        raise SpecError("there is no delivery")
    return violating_rows(rows, rule, key)
