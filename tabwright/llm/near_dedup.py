"""Near-duplicate detection with HyperMinHash registers.

Every shingle falls into one of ``REGISTERS`` buckets; of a bucket's smallest hash, a register keeps the count of
leading zeros and ten bits of mantissa. Texts that agree in all registers of a band are candidates; their Jaccard
similarity is estimated from the registers, corrected for chance collisions, and only pairs clearly below the
threshold (by six standard deviations) are let go. The others are confirmed on their full shingle sets.

Groups of any size are worked off without making all their pairs. Texts with equal shingle sets are one class. In
each band's bucket the classes are first confirmed against the one with the smallest set; only members that are then
in different components are looked at further. Shingles that only one of them has bound what it can share with any
other, which settles most near copies of one text that are too far from each other (``may_have_partner``); the others
are confirmed against the one with the most room for partners, as long as that joins many (``star_merges``). What is then
left of a bucket is compared block by block inside tasks, and no more links leave a task than join components.

With 40 bands of 6 registers a pair at the threshold of 0.85 is missed with a probability below 1e-8, one above it
with less. Full sets hold 64-bit hashes of shingles.

Defined results: null text counts as empty; a text without words has no shingles and is linked with nothing; rows
that repeat an id are one document with all their texts; a row with a null id has a null component and is kept. Texts
of any length give all their shingles; a set must fit in a task's memory. An empty table gives no rows. Only the id and text
columns are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import buckets_for, dealt, map_batches, map_partitions, shared_table, table, whole_text
from tabwright.llm.components import components
from tabwright.llm.shingles import shingle_sets

BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
EMPTY = 0xFFFF
MANTISSA = 10
DEVIATIONS = 6.0
BLOCK = 256
STARS = 3
LAYOUT = ["key", "i", "j", "own", "band", "rep", "component", "n_shingles", "most"]


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a set given as sorted 64-bit hashes."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if not len(hashes):
        return out
    spread = (hashes >> np.uint64(32)) * np.uint64(REGISTERS)
    bucket = (spread >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(hashes), bool)
    np.not_equal(bucket[1:], bucket[:-1], out=first[1:])
    low = (spread[first] << np.uint64(32)) | (hashes[first] & np.uint64(0xFFFFFFFF))
    bits = low.astype(np.float64).view(np.uint64)
    zeros = np.clip(63 - ((bits >> np.uint64(52)).astype(np.int64) - 1023), 0, 62)
    out[bucket[first]] = (zeros << MANTISSA) | ((bits >> np.uint64(52 - MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1))
    return out


def chance_agreement(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that a register agrees by chance for disjoint sets of n and m shingles.

    A bucket's smallest of a = n / REGISTERS hashes has density a * exp(-a x); both fall in one cell of width w with
    about the integral of w * a * b * exp(-(a + b) x), level by level of leading zeros.
    """
    a, b = n[..., None] / REGISTERS, m[..., None] / REGISTERS
    level = np.arange(63)
    top, bottom = 2.0**-level, 2.0 ** -(level + 1)
    return (bottom / (1 << MANTISSA) * a * b / (a + b) * (np.exp(-(a + b) * bottom) - np.exp(-(a + b) * top))).sum(-1)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard similarity of registers x and y (last axis), and how many registers were used."""
    used = ((x != EMPTY) | (y != EMPTY)).sum(-1)
    agree = ((x == y) & (x != EMPTY)).sum(-1)
    chance = chance_agreement(n, m)
    share = agree / np.maximum(used, 1)
    return (share - chance) / (1 - chance), used


def may_reach(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """False for pairs whose estimate or sizes rule out a similarity of ``percent`` / 100."""
    got, used = estimate(x, y, n, m)
    t = percent / 100
    sizes = np.minimum(n, m) * 100 >= percent * np.maximum(n, m)
    return sizes & (got >= t - DEVIATIONS * np.sqrt(t * (1 - t) / np.maximum(used, 1)))


def _register_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), registers; the last two null without shingles."""

    def sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, keys, signed = [], [], []
        for found in shingle_sets(batch.column(1), words):
            counts.append(len(found))
            keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            signed.append(registers(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signed, pa.binary())], ["doc_id", "n_shingles", "set_key", "registers"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    return map_batches(rows, sign, "doc_id long, n_shingles long, set_key binary, registers binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """(band, key, rep, n_shingles): a row per class and band that has a register."""
    band = F.expr(f"substring(registers, 1 + band * {2 * ROWS}, {2 * ROWS})")
    return (
        classes.select("rep", "n_shingles", "registers", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
        .where(band != F.lit(bytearray(b"\xff" * 2 * ROWS)))
        .select("band", F.xxhash64("band", band).alias("key"), "rep", "n_shingles")
    )


def texts_of(texts: DataFrame, ids: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of ``texts`` (doc_id, text) whose id is in ``ids``; up to ``most_broadcast`` ids go to the scan, with more
    both sides are shuffled."""
    ids = shared_table(ids.distinct(), "text-ids")
    ids = F.broadcast(ids) if ids.count() <= most_broadcast else ids
    return shared_table(texts.join(ids, "doc_id", "left_semi"), "pair-texts")


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b): those whose estimate stands and whose full shingle sets reach the threshold."""

    def likely(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, m = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 4))
        keep = may_reach(_register_rows(batch.column(3)), _register_rows(batch.column(5)), n, m, percent) if batch.num_rows else np.empty(0, bool)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def confirm(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        left, right = shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words)
        keep = []
        for x, y in zip(left, right, strict=True):
            same = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * same >= percent * (len(x) + len(y) - same))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, other = (classes.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}")) for c in "ab")
    judged = pairs.join(one, "a").join(other, "b").select("a", "b", "n_a", "r_a", "n_b", "r_b")
    judged = shared_table(map_batches(judged, likely, "a long, b long"), "likely-pairs")
    wanted = texts_of(texts, judged.select(F.col("a").alias("doc_id")).union(judged.select("b")))
    one, other = (wanted.select(F.col("doc_id").alias(c), F.col("text").alias(f"t_{c}")) for c in "ab")
    both = judged.join(one, "a").join(other, "b").select("a", "b", "t_a", "t_b")
    return shared_table(map_batches(both, confirm, "a long, b long").distinct(), "confirmed-pairs")


def _by_group(work: Callable[[pa.Table], pa.RecordBatch]) -> Callable:
    """For ``mapInArrow`` over rows sorted by (key, i, j), the first three columns: ``work`` on the rows of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(low, high - low)
                if held and any(held[0].column(c)[0] != part.column(c)[0] for c in (0, 1, 2)):
                    yield work(pa.Table.from_batches(held))
                    held = []
                if part.num_rows:
                    held.append(part)
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def lone_shingles(texts: DataFrame, words: int) -> DataFrame:
    """(rep, lone): of rows (rep, text), how many of a text's shingles none of the other texts has.

    Hashes meet in buckets, packed by input batch, and what buckets find goes back packed by rep. Hashes are cut to 48
    bits: two that collide count as shared, so ``lone`` is never too large.
    """
    buckets = buckets_for(texts.sparkSession, texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    low_bits = np.uint64((1 << 48) - 1)

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        reps, sets = batch.column(0).to_numpy(), list(shingle_sets(batch.column(1), words))
        if not sum(map(len, sets)):
            return
        hashes, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        bucket = ((hashes >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        hashes, own, bucket = hashes[order] & low_bits, own[order], bucket[order]
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(bucket)]
        parts = [(int(bucket[a]), hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), reps[own[a:b]].astype("<i8").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "hashes", "reps"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not found:
            return
        packed = np.zeros((sum(len(r[1]) for r in found) // 6, 8), np.uint8)
        packed[:, :6] = np.frombuffer(b"".join(r[1] for r in found), np.uint8).reshape(-1, 6)
        hashes, reps = packed.reshape(-1).view("<u8"), np.frombuffer(b"".join(r[2] for r in found), "<i8")
        order = np.argsort(hashes, kind="stable")  # buckets that share a task may collide, which is as harmless
        same = hashes[order][1:] == hashes[order][:-1]
        alone = ~(np.append(same, False) | np.append(False, same))
        rep, n = np.unique(reps[order][alone], return_counts=True)
        order, runs = dealt(rep, buckets)
        columns = [[x[order][a:b].astype("<i8").tobytes() for _, a, b in runs] for x in (rep, n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["to", "reps", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[np.frombuffer(x, "<i8") for x in row] for batch in batches for row in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        if found:
            rep, at = np.unique(np.concatenate([r for r, _ in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)
            for k in range(0, len(rep), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(rep[k : k + 50_000], pa.int64()), pa.array(n[k : k + 50_000], pa.int64())], ["rep", "lone"])

    sent = map_batches(texts.select("rep", "text"), pack, "bucket int, hashes binary, reps binary").repartition(buckets, "bucket")
    counted = map_partitions(sent, count, "to long, reps binary, counts binary")
    return map_partitions(counted.repartition(buckets, "to"), add_up, "rep long, lone long")


def may_have_partner(members: DataFrame, percent: int) -> DataFrame:
    """Of ``members`` (key, ..., n_shingles, most) those that may have a partner, another member, in their bucket.

    ``most`` is the largest set that a member can be similar enough to, with what it has to share: with I shingles that
    any other has, 100 * I >= percent * (n + m - I) bounds the other's size m. Of each size in a bucket its two largest
    ``most`` are listed, so that a member is held against the others and not against itself; a list is as short as sizes
    that differ.
    """
    alike = members.groupBy("key", "n_shingles", "most").agg(F.count(F.lit(1)).alias("n"))
    top = F.slice(F.sort_array(F.collect_list(F.struct("most", "n")), asc=False), 1, 2)  # of at most n_shingles + 1 values
    sizes = alike.groupBy("key", "n_shingles").agg(top.alias("top"))
    first = F.col("top")[0]
    second = F.when(first["n"] > 1, first["most"]).otherwise(F.get("top", F.lit(1))["most"])
    sizes = sizes.select("key", F.struct("n_shingles", first["most"].alias("most"), second.alias("next")).alias("size"))
    sizes = shared_table(sizes.groupBy("key").agg(F.collect_list("size").alias("sizes")), "bucket-sizes")

    def fits(e: Column) -> Column:
        others = F.when((e["n_shingles"] == F.col("n_shingles")) & (e["most"] == F.col("most")), e["next"]).otherwise(e["most"])
        alone = (e["n_shingles"] == F.col("n_shingles")) & e["next"].isNull()
        near = (100 * e["n_shingles"] >= percent * F.col("n_shingles")) & (100 * F.col("n_shingles") >= percent * e["n_shingles"])
        return ~alone & near & (e["n_shingles"] <= F.col("most")) & F.coalesce(F.col("n_shingles") <= others, F.lit(False))

    return members.join(sizes, "key").where(F.exists("sizes", fits)).drop("sizes")


def _survivors(rows: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs of rows of two blocks, as one row and its partners: in different components, not ruled out by sizes or by
    the estimate, alike in this band and none before it."""
    own, comp, n, most = (rows.column(c).to_numpy() for c in ("own", "component", "n_shingles", "most"))
    band, i, j = (rows.column(c)[0].as_py() for c in ("band", "i", "j"))
    regs = _register_rows(rows.column("registers").combine_chunks())
    first, second = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for p in first:
        q = second[(comp[second] != comp[p]) & (n[second] <= most[p]) & (n[p] <= most[second]) & ((second > p) if i == j else True)]
        q = q[(regs[q, band * ROWS : (band + 1) * ROWS] == regs[p, band * ROWS : (band + 1) * ROWS]).all(1)]
        if not len(q):
            continue
        same = ((regs[q] == regs[p]) & (regs[q] != EMPTY)).reshape(len(q), BANDS, ROWS)
        empty = (regs[q] == EMPTY) & (regs[p] == EMPTY)
        alike = (same | empty.reshape(len(q), BANDS, ROWS)).all(2) & same.any(2)
        q = q[alike.argmax(1) == band]
        if len(q):
            q = q[may_reach(regs[p][None], regs[q], np.full(len(q), float(n[p])), n[q].astype(np.float64), percent)]
            if len(q):
                yield p, q


def in_mixed_buckets(rest: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components, with the number of ``blocks`` that the bucket is cut into."""
    sums = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return rest.join(shared_table(sums.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed-buckets"), "key")


def star_merges(rest: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(component, wider): components that links of each bucket's members with the one that has the most room for partners
    merge. Of copies of one text that is one with few changes, which is similar to most of those that are similar to any;
    the pairs are as many as the members."""
    room = F.struct((F.col("n_shingles") - F.col("most")).alias("lack"), "rep", "n_shingles", "most", "component")
    lead = shared_table(rest.groupBy("key").agg(F.min(room).alias("lead")), "star-leaders")
    fits = (F.col("component") != F.col("lead.component")) & (F.col("n_shingles") <= F.col("lead.most")) & (F.col("lead.n_shingles") <= F.col("most"))
    pairs = rest.join(lead, "key").where(fits).select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"), F.col("lead.component").alias("ca"), F.col("component").alias("cb"))
    pairs = shared_table(pairs.distinct(), "star-pairs")
    links = confirmed(pairs.select("a", "b").distinct(), classes, texts, words, percent)
    return merges(pairs.join(links, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")))


def merges(links: DataFrame) -> DataFrame:
    """(component, wider): what becomes of components that ``links`` (a, b) join."""
    return shared_table(components(links).select(F.col("node").alias("component"), F.col("component").alias("wider")), "merged-components")


def widened(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """``labels`` (node, component) after ``merged`` (component, wider). A component without labels is a node by itself."""
    wide = labels.join(merged, "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
    return wide.union(merged.select(F.col("component").alias("node"), F.col("wider").alias("component"))).distinct()


def settled(members: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, several: DataFrame, words: int, percent: int) -> DataFrame:
    """``labels`` (node, component) with all links between classes of one bucket that are still in different components.

    Members that can't have a partner go first, then those that a bucket's most central member links. Large buckets are
    cut into blocks, and a task compares two blocks. A first pass finds the members that may have a link, and a second
    one confirms pairs on full sets. A pair is looked at in the first band in which it agrees only; of confirmed pairs
    those that join two components of the task are emitted, as these components, so what leaves a task is fewer rows than
    entered it. Only components are linked from then on, not their members anew. ``several`` (rep) are ids with unlike
    texts, each of which counts as if it shared all its shingles.
    """
    rest = members.where("rep <> leader").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("band", "key", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
    rest = in_mixed_buckets(shared_table(rest, "bucket-members"))
    rest = shared_table(rest.drop("blocks"), "mixed-members")
    known = texts_of(texts, rest.select(F.col("rep").alias("doc_id"))).withColumnRenamed("doc_id", "rep")
    lone = shared_table(lone_shingles(known, words).join(several, "rep", "left_anti"), "lone-shingles")
    shared = F.col("n_shingles") - F.coalesce("lone", F.lit(0))
    most = F.floor(shared * (100 + percent) / percent - F.col("n_shingles") + 1e-6).cast("long")
    rest = rest.join(lone, "rep", "left").select("band", "key", "rep", "n_shingles", "component", most.alias("most"))
    rest = shared_table(may_have_partner(shared_table(rest, "sized-members"), percent), "open-bucket-members")
    rest = shared_table(in_mixed_buckets(rest), "open-bucket-members")
    found, n_open = [], rest.count()
    while n_open and len(found) < STARS:
        merged = star_merges(rest, classes, known.withColumnRenamed("rep", "doc_id"), words, percent)
        if merged.isEmpty():
            break
        found.append(merged)
        rest = rest.drop("blocks").join(merged, "component", "left").withColumn("component", F.coalesce("wider", "component")).drop("wider")
        rest = shared_table(in_mixed_buckets(shared_table(rest, "star-members")), "open-bucket-members")
        before, n_open = n_open, rest.count()
        if n_open > 0.8 * before:
            break
    if n_open:
        found.append(merges(block_links(rest, classes, known, words, percent)))
    return shared_table(functools.reduce(widened, found, labels), "labels") if found else labels


def block_links(rest: DataFrame, classes: DataFrame, known: DataFrame, words: int, percent: int) -> DataFrame:
    """Components (a, b) that links between members ``rest`` of one bucket join, found block by block."""
    n = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = classes.select("rep", "n_shingles", "registers")

    def by_blocks(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def find(rows: pa.Table) -> pa.RecordBatch:
        keep = np.zeros(rows.num_rows, bool)
        for p, q in _survivors(rows, percent):
            keep[p] = True
            keep[q] = True
        return rows.select(LAYOUT).filter(pa.array(keep)).combine_chunks().to_batches(max_chunksize=1 << 30)[0] if keep.any() else _nothing(rows)

    def _nothing(rows: pa.Table) -> pa.RecordBatch:
        schema = rows.select(LAYOUT).schema
        return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)

    def confirm(rows: pa.Table) -> pa.RecordBatch:
        comp = rows.column("component").to_pylist()
        text = rows.column("text").combine_chunks()
        root = {c: c for c in comp}
        sets: dict[int, set] = {}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        def of(k: int) -> set:
            if k not in sets:
                sets[k] = set(next(shingle_sets(text.slice(k, 1), words)).tolist())
            return sets[k]

        found = []
        for p, qs in _survivors(rows, percent):
            for q in qs.tolist():
                a, b = top(comp[p]), top(comp[q])
                if a == b:
                    continue
                same = len(of(p) & of(q))
                if 100 * same >= percent * (len(of(p)) + len(of(q)) - same):
                    root[max(a, b)] = min(a, b)
                    found.append((comp[p], comp[q]))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    layout = "key long, i int, j int, own int, band int, rep long, component long, n_shingles long, most long"
    laid = (
        rest.join(signed, ["rep", "n_shingles"])
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "rep", "component", "n_shingles", "most", "registers")
    )
    open_rows = shared_table(map_partitions(by_blocks(laid), _by_group(find), layout), "open-members")
    full = open_rows.join(signed, ["rep", "n_shingles"]).join(known, "rep").select(*open_rows.columns, "registers", "text")
    return map_partitions(by_blocks(full), _by_group(confirm), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id linked with it through others), kept.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of their shingle sets.
    """
    signed = shared_table(signatures(docs, id_col, text_col, words), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    reps = shared_table(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    classes = shared_table(
        usable.join(reps, "set_key").where("doc_id = rep").select("rep", "n_shingles", "registers").dropDuplicates(["rep", "registers"]), "class-registers"
    )
    bands = band_rows(classes)
    # The smallest set leads: with a passage that many share, it is the likeliest to be similar to any of them.
    least = F.min(F.struct("n_shingles", "rep")).alias("least")
    buckets = shared_table(bands.groupBy("key").agg(least, F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("key", F.col("least.rep").alias("leader"), F.col("least.n_shingles").alias("leader_n")), "buckets")
    members = shared_table(bands.join(buckets, "key"), "members")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    fits = (100 * F.col("n_shingles") >= percent * F.col("leader_n")) & (100 * F.col("leader_n") >= percent * F.col("n_shingles"))
    first = confirmed(members.where("rep <> leader").where(fits).select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), classes, texts, words, percent)
    # Rows that repeat an id with different texts join their classes.
    owned = usable.select("doc_id", "set_key").distinct().join(reps, "set_key").select("doc_id", "rep")
    least = shared_table(owned.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("hi")).where("b < hi").drop("hi"), "repeated-ids")
    first = first.union(owned.join(least, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b"))
    labels = shared_table(components(first), "labels")
    labels = settled(members, labels, classes, texts, least.select(F.col("doc_id").alias("rep")), words, percent)
    rows = signed.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that with the smallest id.

    Of rows that repeat whole, in every column, one stays; other rows that share an id are one document and stay together.
    """
    found = shared_table(near_duplicates(docs, id_col, text_col, words, percent), "near-duplicates")
    rest = docs.join(found.where("not kept").select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    again = shared_table(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_col)), "repeated-rows")
    if again.isEmpty():
        return rest
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = rest.join(again, id_col, "left_semi").select(F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256).alias("digest"), whole.alias("row")).dropDuplicates(["digest"])
    return rest.join(again, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(repeated.select("row.*"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among ``documents``, linked at a similarity of 0.85 of five-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
link AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS doc_id, least(a, b) AS c FROM link UNION SELECT link.a, reach.c FROM reach JOIN link ON link.b = reach.doc_id),
comp AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
