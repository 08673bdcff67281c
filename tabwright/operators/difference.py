"""What differs between two deliveries of a table, by key and by column.

Each side is reduced to a row per key: how many rows it has, the sum of their digests, and a hash of each column. Sums
are combined before the shuffle, so a key that very many rows share is a row per task by then. The two sides are joined
on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.spec import SpecError


def _side(df: DataFrame, key: list[str], columns: list[str], side: str) -> DataFrame:
    whole = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])), 256)
    pieces = [F.conv(F.substring("_digest", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    rows = df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(key)], whole.alias("_digest"), F.array(*[F.xxhash64(F.col(f"`{c}`")) for c in columns]).cast("array<bigint>").alias("_hashes"))
    sums: list[Column] = [F.sum(p).alias(f"_s{k}") for k, p in enumerate(pieces)]
    own = rows.groupBy(*[f"_k{i}" for i in range(len(key))]).agg(F.count(F.lit(1)).alias("_n"), *sums, F.min("_hashes").alias("_hashes"))
    return own.select(*[F.col(f"_k{i}").alias(f"{side}_k{i}") for i in range(len(key))], F.struct("_n", F.struct(*[f"_s{k}" for k in range(4)]).alias("_sum"), "_hashes").alias(side))


def difference(old: DataFrame, new: DataFrame, key: list[str] | str, columns: list[str] | None = None) -> DataFrame:
    """(key..., change, columns, n_old, n_new) for each key that differs.

    change: added, gone, changed (rows of the key are others, or other in number). columns: those that differ where the key
    has one row on each side; null for other changes. Rows of one key are compared as a multiset. Nulls are equal to each
    other, in keys too. ``columns``: those to compare, by default all that both tables have; a column that only one of
    them has is no difference of rows.
    """
    key = [key] if isinstance(key, str) else list(key)
    columns = [c for c in old.columns if c in new.columns and c not in key] if columns is None else list(columns)
    if missing := [c for c in (*key, *columns) if c not in old.columns or c not in new.columns]:
        raise SpecError(f"not in both tables: {', '.join(missing)}")
    same = F.lit(True)
    for i in range(len(key)):
        same = same & F.col(f"old_k{i}").eqNullSafe(F.col(f"new_k{i}"))
    both = _side(old, key, columns, "old").join(_side(new, key, columns, "new"), same, "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").when(F.col("old._sum") != F.col("new._sum"), "changed")
    names = F.filter(F.arrays_zip(F.array(*[F.lit(c) for c in columns]).cast("array<string>").alias("name"), F.col("old._hashes").alias("a"), F.col("new._hashes").alias("b")), lambda x: x["a"] != x["b"])
    single = (F.col("old._n") == 1) & (F.col("new._n") == 1)
    found = both.withColumn("change", change).where("change IS NOT NULL")
    keys = [F.when(F.col("old").isNull(), F.col(f"new_k{i}")).otherwise(F.col(f"old_k{i}")).alias(k) for i, k in enumerate(key)]
    return found.select(*keys, "change", F.when(single, F.transform(names, lambda x: x["name"])).alias("columns"), F.coalesce("old._n", F.lit(0)).alias("n_old"), F.coalesce("new._n", F.lit(0)).alias("n_new"))
