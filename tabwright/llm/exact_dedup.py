"""Exact deduplication by Grace hashing.

Records are dealt to buckets by a hash of their content. Within a bucket an open-addressing table holds one copy of
each content, found by comparing whole contents. Once the table has its fill of bytes, records that are new to it go
to spill files by further digits of the hash, and each file is worked off in the same way, so memory stays bounded
for any bucket; every pass settles at least one content, so it ends for any input.

Before the shuffle each input partition is reduced by the same table (emptied into the output when full), so a
content that fills a third of all rows reaches its bucket once per input partition.

Defined results: null counts as empty; texts are compared after each white-space run became one space; ids may be
null or repeated: the smallest id that is not null stays, rows sharing that id are all kept, and a group whose ids
are all null has a null ``keep_id`` and keeps every row. Texts of any length are compared whole: a table
holds one that is larger than its fill alone. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import os
import pickle
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import shared_table, table, whole_text

FANOUT_BITS = 4

Entry = tuple[bytes, bytes, int | None, int]  # digest, content, smallest id, rows


def normalised(column: str = "text"):
    """The text with each run of white space (x20, x09 to x0D) replaced by one space."""
    return F.regexp_replace(whole_text(column), r"[\x20\x09-\x0D]+", " ")


class ContentTable:
    """Open addressing with linear probing; slots hold positions in a list of entries."""

    def __init__(self, slots: int = 1 << 10) -> None:
        self.slots = np.full(slots, -1, np.int64)
        self.entries: list[list] = []
        self.bytes = 0

    def _slot(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (k := self.slots[at]) >= 0:
            if self.entries[k][1] == content:
                return at
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, content: bytes, least: int | None, rows: int, room: int) -> bool:
        """Count the record in; False if its content is new and ``room`` bytes are used up."""
        at = self._slot(digest, content)
        if (k := self.slots[at]) >= 0:
            entry = self.entries[k]
            if least is not None and (entry[2] is None or least < entry[2]):
                entry[2] = least
            entry[3] += rows
            return True
        if self.entries and self.bytes + len(content) > room:
            return False
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, least, rows])
        self.bytes += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            for k, entry in enumerate(self.entries):
                self.slots[self._slot(entry[0], entry[1])] = k
        return True


def reduce_stream(entries: Iterable[Entry], room: int) -> Iterator[Entry]:
    """Equal contents merged as far as they meet in a table of ``room`` bytes, which is emptied when full."""
    held = ContentTable()
    for entry in entries:
        if not held.add(*entry, room):
            yield from map(tuple, held.entries)
            held = ContentTable()
            held.add(*entry, room)
    yield from map(tuple, held.entries)


def grace_dedup(entries: Iterable[Entry], room: int, folder: str | None = None, level: int = 0) -> Iterator[Entry]:
    """One entry per distinct content; memory is bounded by ``room`` bytes of contents, the rest is spilled."""
    held, files, own = ContentTable(), {}, folder is None
    try:
        for entry in entries:
            if held.add(*entry, room):
                continue
            if folder is None:
                folder = tempfile.mkdtemp(prefix="grace-")
            # Digits beyond the digest's length repeat the last; the table still settles one content a pass.
            digit = int.from_bytes(entry[0], "big") >> max(0, 8 * len(entry[0]) - 64 - FANOUT_BITS * (level + 1)) & (1 << FANOUT_BITS) - 1
            if digit not in files:
                files[digit] = open(f"{folder}/{level}-{digit}", "wb")  # noqa: SIM115
            pickle.dump(entry, files[digit], pickle.HIGHEST_PROTOCOL)
        yield from map(tuple, held.entries)
        del held
        for digit, file in sorted(files.items()):
            file.close()
            yield from grace_dedup(_spilled(file.name), room, os.path.dirname(file.name), level + 1)
    finally:
        for file in files.values():
            file.close()
        if own and folder:
            shutil.rmtree(folder, ignore_errors=True)


def _spilled(path: str) -> Iterator[Entry]:
    moved = f"{path}-read"
    os.rename(path, moved)
    with open(moved, "rb") as file:
        while True:
            try:
                yield pickle.load(file)  # noqa: S301
            except EOFError:
                break
    os.remove(moved)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[Entry]:
    for batch in batches:
        for digest, content, least, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield digest, content, least, rows


def _batches(entries: Iterable[Entry], with_content: bool, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    names = ["digest", "content", "least", "rows"]
    use = [0, 1, 2, 3] if with_content else [0, 2, 3]

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in use], [names[i] for i in use])

    rows, size = [], 0
    for entry in entries:
        rows.append(entry)
        size += len(entry[1])
        if size > most_bytes or len(rows) >= 50_000:
            yield batch(rows)
            rows, size = [], 0
    if rows:
        yield batch(rows)


def distinct_contents(records: DataFrame, room: int = 64 << 20) -> DataFrame:
    """Of ``records`` (digest binary, content binary, least long, rows long): digest, least and rows per distinct content."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(reduce_stream(_entries(batches), room), True)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(grace_dedup(_entries(batches), room), False)

    reduced = records.mapInArrow(reduce, "digest binary, content binary, least long, rows long")
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reduced.repartition(n, "digest").mapInArrow(settle, "digest binary, least long, rows long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Groups are found by whole contents; rows get theirs by SHA-256. Should one digest ever stand for two contents, the
    operator stops with an error rather than mix them up.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("t")).withColumn("digest", F.unhex(F.sha2("t", 256)))
    records = rows.select("digest", F.col("t").cast("binary").alias("content"), F.col("doc_id").cast("long").alias("least"), F.lit(1).cast("long").alias("rows"))
    groups = shared_table(distinct_contents(records), "exact-groups")
    one = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("keep_id"), F.sum("rows").alias("group_size"))
    one = shared_table(one.withColumn("group_size", F.when(F.col("n") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two contents have one SHA-256")).cast("long"))).drop("n"), "exact-checked")
    return rows.select("doc_id", "digest").join(one, "digest", "left").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies in ``documents``; of equal texts the smallest doc_id stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM t
"""
