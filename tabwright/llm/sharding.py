"""Sharding by longest-processing-time scheduling: groups that must stay together, largest first, to the least-loaded shard.

Equal texts are a group. A heap over every group of a large corpus would be a list of all groups on one machine, but
groups of one size are interchangeable, so the schedule needs no more than how many groups have each size. These counts
are a table; its rows go past the driver from the largest size on, one partition of them at a time, and all that is kept
is the load of each shard. What each size gets goes to a table by pieces of ``piece`` sizes, so the driver holds as much
at any input. Sizes that differ add up to the corpus at least, so at most sqrt(2 * bytes) of them go past (14 million at
100 TB). Few groups of a size go through the heap one by one; many are levelled at once (``levelled``), with what the
heap would give. The loads of all shards, and how many groups of each size a shard gets, are those of a
heap over all groups, at any input.

Which groups of a size these are is settled without bringing them together: groups are numbered by their digest in
chunks of about ``chunk_rows``, and each shard takes a run of numbers. Slots number the rows of a shard from 0 without
gaps in the same way, by the digest of the id; counts of chunks are added up in two levels (``begins_of``), so no task
sees a whole size, shard or group.

Defined results: null text counts as empty (size 8), all empty texts are one group, texts of any length are hashed
whole; null and repeated ids get slots of their own, in no fixed order among rows that are alike in id, text and size.
Rows without an id are spread by the digest of their text; rows that share an id are numbered in one task, as are those
without an id that are alike in text. An empty table gives no rows. Other columns may have any names; those in
``carry`` come out as they went in, but one that is called as a column made here gets ``_given`` after its name.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.llm.common import new_folder, shared_table, table, whole_text

ROW_OVERHEAD = 8
MADE = ["doc_id", "size", "text_crc32", "shard", "slot"]
PIECE = 50_000


def levelled(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of one size each shard gets if they go one by one to the least-loaded, the first of equal ones.

    A shard takes its items at loads of load, load + size, and so on; the items taken are the ``count`` lowest of these
    levels over all shards.
    """
    low, high = min(loads), max(loads) + size * count + 1
    below = lambda level: sum(max(0, -(-(level - x) // size)) for x in loads)
    while low + 1 < high:  # the largest level below which there are no more than ``count``
        middle = (low + high) // 2
        low, high = (middle, high) if below(middle) <= count else (low, middle)
    got = [max(0, -(-(low - x) // size)) for x in loads]
    rest = count - sum(got)
    for k, x in enumerate(loads):
        if rest and x + got[k] * size == low:
            got[k] += 1
            rest -= 1
    return got


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """LPT over (size, how many) from the largest size on: for each size how many of its groups each shard gets."""
    heap = [(0, k) for k in range(shards)]
    for size, count in sizes:
        if count <= 2 * shards:
            got = [0] * shards
            for _ in range(count):
                load, k = heap[0]
                got[k] += 1
                heapq.heapreplace(heap, (load + size, k))
        else:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            got = levelled(loads, size, count)
            heap = [(load + size * n, k) for k, (load, n) in enumerate(zip(loads, got, strict=True))]
            heapq.heapify(heap)
        yield size, got


def chunk_of(digest: Column, chunks: Column) -> Column:
    """The chunk of a hexadecimal digest among ``chunks``, in the order of digests."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * chunks / float(1 << 32)).cast("long")


def begins_of(counts: DataFrame, by: str, width: int = 1000) -> DataFrame:
    """(by, chunk, begins): from rows (by, chunk, n), how many are in earlier chunks; blocks of ``width`` chunks are added up first."""
    block = F.floor(F.col("chunk") / width).alias("block")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(by, block).agg(F.sum("n").alias("n"))
    blocks = blocks.select(by, "block", F.coalesce(F.sum("n").over(earlier.partitionBy(by).orderBy("block")), F.lit(0)).alias("blocks_before"))
    within = counts.select(by, "chunk", block, F.coalesce(F.sum("n").over(earlier.partitionBy(by, block).orderBy("chunk")), F.lit(0)).alias("before"))
    return within.join(blocks, [by, "block"]).select(by, "chunk", (F.col("blocks_before") + F.col("before")).alias("begins"))


def schedule(groups: DataFrame, shards: int, chunk_rows: int, piece: int = PIECE) -> DataFrame:
    """(bytes, upto, chunks) for rows (group_key, bytes): of a size's groups, the number that go to each shard but the last
    or to one before it, and in how many chunks they are numbered."""
    spark = groups.sparkSession
    counts = shared_table(groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")), "shard-histogram")
    sizes = ((r.bytes, r.n) for r in counts.orderBy(F.desc("bytes")).toLocalIterator())
    given = longest_first(sizes, shards)
    layout, path = "bytes long, upto array<bigint>, chunks long", None
    while True:
        part = list(itertools.islice(given, piece))
        upto = [list(itertools.accumulate(got))[:-1] for _, got in part]
        columns = [pa.array([size for size, _ in part], pa.int64()), pa.array(upto, pa.list_(pa.int64())), pa.array([-(-sum(got) // chunk_rows) for _, got in part], pa.int64())]
        rows = spark.createDataFrame(pa.table(columns, names=["bytes", "upto", "chunks"]), layout)
        if path is None and len(part) < piece:
            return F.broadcast(rows)  # 8 bytes a number and shard, 10 MB at most for 24 shards
        path = path or new_folder(spark, "shard-schedule")
        if part:
            rows.write.mode("append").option("compression", "zstd").parquet(path)
        if len(part) < piece:
            return spark.read.schema(layout).parquet(path)


def group_shards(groups: DataFrame, shards: int, chunk_rows: int, piece: int = PIECE) -> DataFrame:
    """(group_key, shard) for rows (group_key, bytes): the schedule's counts, dealt to groups of a size in the order of keys."""
    placed = groups.join(schedule(groups, shards, chunk_rows, max(1, min(piece, PIECE * 24 // shards))), "bytes").withColumn("chunk", chunk_of(F.col("group_key"), F.col("chunks")))
    begins = begins_of(placed.where("chunks > 1").groupBy("bytes", "chunk").agg(F.count(F.lit(1)).alias("n")), "bytes")
    nth = F.row_number().over(Window.partitionBy("bytes", "chunk").orderBy("group_key")) - 1
    placed = placed.withColumn("nth", nth).join(begins, ["bytes", "chunk"], "left")
    number = F.col("nth") + F.coalesce("begins", F.lit(0))
    return placed.select("group_key", F.size(F.filter("upto", lambda u: u <= number)).alias("shard"))


def carried_names(carry: list[str]) -> dict[str, str]:
    """The names under which carried columns come out."""
    taken, names = {c.lower() for c in [*MADE, *carry]}, {}
    for c in carry:
        name = c
        while name.lower() in MADE or name != c and name.lower() in taken:
            name += "_given"
        taken.add(name.lower())
        names[c] = name
    return names


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = 1_000, carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot, and the columns in ``carry``; equal texts share a shard."""
    text = whole_text(text_col)
    kept = {f"kept_{k}": c for k, c in enumerate(carry or [])}
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("group_key"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.md5(text.cast("binary"))).cast("binary")).alias("row_key"),
        *[F.col(f"`{c}`").alias(k) for k, c in kept.items()],
    )
    narrow = shared_table(rows.select("doc_id", "size", "text_crc32", "group_key", "row_key"), "shard-rows")
    groups = shared_table(narrow.groupBy("group_key").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed = shared_table(group_shards(groups, shards, chunk_rows), "shard-plan")
    # As many chunks for each shard as its rows ask for: at most one row per shard.
    sums = shared_table(narrow.join(placed, "group_key").groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("chunks")), "shard-sizes")
    located = lambda r: r.join(placed, "group_key").join(F.broadcast(sums), "shard").withColumn("chunk", chunk_of(F.col("row_key"), F.col("chunks")))
    counts = shared_table(located(narrow).groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n")), "shard-counts")
    begins = shared_table(begins_of(counts, "shard"), "shard-begins")
    within = Window.partitionBy("shard", "chunk").orderBy(F.substring("row_key", 1, 8), "doc_id", "text_crc32", "size")
    out = located(rows if kept else narrow).withColumn("nth", F.row_number().over(within) - 1).join(begins, ["shard", "chunk"])
    free = carried_names(list(kept.values()))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("begins") + F.col("nth")).cast("long").alias("slot"), *[F.col(k).alias(free[c]) for k, c in kept.items()])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes, equal texts together."""
    return assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: LPT step by step over all groups; a size's shards in ascending order go to its groups in the order of their digests.
OP9_SQL = """
WITH RECURSIVE step(v, c, k) AS (SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crcs AS (SELECT list(c ORDER BY v) AS t FROM step WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 8 AS size, md5(coalesce(text, '')) AS g FROM documents),
texts AS (SELECT g, any_value(text) AS text FROM d GROUP BY g),
crc AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM texts, crcs
),
groups AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, g) AS i FROM (SELECT g, sum(size)::BIGINT AS bytes FROM d GROUP BY g)),
lpt(i, loads, shard, bytes) AS (
  SELECT 0::BIGINT, list_transform(range(24), lambda x: 0::BIGINT), -1::BIGINT, 0::BIGINT
  UNION ALL
  SELECT groups.i, list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + groups.bytes ELSE x END), list_position(loads, list_min(loads)) - 1, groups.bytes
  FROM lpt JOIN groups ON groups.i = lpt.i + 1
),
dealt AS (SELECT shard, bytes, row_number() OVER (PARTITION BY bytes ORDER BY shard) AS n FROM lpt WHERE i > 0),
placed AS (SELECT g, shard FROM (SELECT g, bytes, row_number() OVER (PARTITION BY bytes ORDER BY g) AS n FROM groups) JOIN dealt USING (bytes, n))
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id::VARCHAR)[1:8], doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM d JOIN placed USING (g) JOIN crc USING (g)
"""
