"""Removal of repeated passages: bytes covered by a string of 50 bytes that also starts in an earlier document.

To find such strings among all documents without sorting every suffix of the corpus:

1. Anchors. Each window of 50 bytes is given the 20-byte gram within it whose hash is smallest (the last of equal
   ones), so equal windows have equal anchors, and consecutive windows mostly share theirs (one anchor in 15 bytes).
2. Shared anchors. Anchor hashes meet in buckets, packed by input batch; those that stand in two different texts are
   reported back to the texts. One that several texts of a batch share is sent to its bucket once.
3. Contexts. The windows of one shared anchor and the bytes they cover are its context. Equal contexts are merged with
   the smallest document that has them; in later documents such contexts are covered whole.
4. Suffix array. The different contexts of one anchor are cut to the windows that can be shared at all (by the longest
   extensions to the left and to the right that any other context has), merged again, and sorted by a suffix array
   built by linear grouping over them. Runs of suffixes with equal windows give the earliest document of each window.
5. The covered spans of each document are joined and cut out.

Contexts of one anchor beyond ``most_contexts`` are dealt over several tasks, and the earliest documents of their
windows are then merged by a grouped aggregation over window digests, which is exact too.

Texts go by numbers of 64 bits that no two different texts share: they are hashes, and where SHA-256 tells texts of one
hash apart, all texts of that hash get others (``text_names``). Hashes of grams only bring candidates together: the grams
themselves, contexts and windows are compared by their bytes (known contexts by 128 bits of SHA-256 within their anchor,
windows of groups dealt over tasks by digests of 128 bits). Anchors are dealt to buckets by the bytes of the input, so a
task holds as much at any input.

Defined results: null text counts as empty; of equal texts those with a larger id lose everything if they have 50
bytes; rows that share an id are no earlier than each other; rows with a null id neither lose bytes nor take any from
others; long texts are cut whole, in pieces of 1 MB. Empty tables give no rows. Only the id and text columns are read, others
may have any names.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import buckets_for, clear_shared, dealt, shared_table, table, whole_text, written
from tabwright.llm.shingles import mix, powers, text_slices
from tabwright.llm.suffix_array import suffix_array

GRAM = 20
SUFFIX_BITS = np.uint64((1 << 48) - 1)
PIECE = 1 << 20
PLACE_BITS = np.uint64((1 << 21) - 1)
_RNG = np.random.Generator(np.random.PCG64(20240310))
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 1 << 61)) * 8 + 5
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK_SYMBOLS = 1 << 16
MOST_ROWS = 1 << 15  # of a batch; places in it are kept as numbers of 16 bits
MOST_CLASHES = 10_000


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results have been written, here and on all executors: its cleaner does
    so once the driver has collected what refers to them. Without this the results are the same, on more disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per run of windows with one anchor: the anchor's hash and place, the first window and how many windows."""
    found: list[tuple] = []
    for low in range(0, len(text) - length + 1, PIECE):
        part = text[low : low + PIECE + length - 1]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[part] * powers(_BASE, n)[:n], out=sums[1:])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * powers(_INVERSE, n)[: n - GRAM + 1])
        places = np.arange(len(grams), dtype=np.uint64)
        least = _slide((grams & ~PLACE_BITS) | (PLACE_BITS - places), length - GRAM + 1)
        at = (PLACE_BITS - (least & PLACE_BITS)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        found.append((grams[at[begin]], at[begin] + low, begin + low, np.diff(np.append(begin, len(at)))))
    if not found:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _short(hashes: np.ndarray) -> bytes:
    """The low 48 bits of each hash, six bytes apiece."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def packed_anchors(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """Of rows (t, text): per batch and bucket the anchors as packed numbers; ``known`` ones are shared within the batch."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, MOST_ROWS) for b in batches for k in range(0, b.num_rows, MOST_ROWS)):
            names = batch.column(0).to_numpy()
            hashes, owner = [], []
            for first, offsets, data in text_slices(batch.column(1)):
                for k in range(len(offsets) - 1):
                    found = np.unique(anchors(data[offsets[k] : offsets[k + 1]], length)[0])
                    hashes.append(found)
                    owner.append(np.full(len(found), first + k, np.int64))
            if not hashes:
                continue
            f, own = np.concatenate(hashes), np.concatenate(owner)
            order = np.lexsort((names[own], f))
            f, own = f[order], own[order]
            new_f = np.concatenate(([True], f[1:] != f[:-1]))
            new = new_f | np.concatenate(([True], names[own[1:]] != names[own[:-1]]))  # one entry per hash and text
            f, own, new_f = f[new], own[new], new_f[new]
            group = np.cumsum(new_f) - 1
            many = np.bincount(group, minlength=1)[group] > 1 if len(f) else np.empty(0, bool)
            out = []
            for known, keep in ((False, new_f), (True, many)):
                fs, os, flag = f[keep], own[keep], many[keep]
                if not len(fs):
                    continue
                bucket = ((fs >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64) if not known else os % buckets
                order = np.argsort(bucket, kind="stable")
                fs, os, flag, bucket = fs[order], os[order], flag[order], bucket[order]
                cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                for low, high in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                    users, idx = np.unique(os[low:high], return_inverse=True)
                    out.append((int(bucket[low]), known, _short(fs[low:high]), idx.astype("<u2").tobytes(), names[users].astype("<i8").tobytes(), np.packbits(flag[low:high]).tobytes()))
                    if len(out) >= 4096:
                        yield _packed(out)
                        out = []
            if out:
                yield _packed(out)

    return rows.mapInArrow(pack, "bucket int, known boolean, fs binary, idx binary, ts binary, flags binary")


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "known", "fs", "idx", "ts", "flags"])


def shared_anchors(packed: DataFrame, buckets: int) -> DataFrame:
    """(t, fs): per text t the packed anchors that another text has too.

    What a bucket reports goes back packed by the bucket of the text, so that the rows between are as many as the blocks
    of a shuffle, however many texts and buckets there are.
    """

    def by_text(t: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, runs = dealt(t, buckets)
        t, f = t[order], f[order]
        names, hashes = [t[a:b].astype("<i8").tobytes() for _, a, b in runs], [_short(f[a:b]) for _, a, b in runs]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int64()), pa.array(names, pa.binary()), pa.array(hashes, pa.binary())], ["to", "ts", "fs"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, ts, flags, first, known_f, known_t = [], [], [], [], [], []
        for batch in batches:
            for bucket, known, f, idx, t, flag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(t, "<i8")[np.frombuffer(idx, "<u2")]
                if known:
                    known_f.append(_long(f))
                    known_t.append(own)
                    continue
                fs.append(_long(f))
                ts.append(own)
                flags.append(np.unpackbits(np.frombuffer(flag, np.uint8), count=len(own)).astype(bool))
                first.append(np.full(len(own), bucket, np.int32))
        if known_f:
            yield from by_text(np.concatenate(known_t), np.concatenate(known_f))
        if not fs:
            return
        f, t, flag, bucket = (np.concatenate(x) for x in (fs, ts, flags, first))
        order = np.lexsort((f, bucket))
        f, t, flag, bucket = f[order], t[order], flag[order], bucket[order]
        group = np.cumsum(np.concatenate(([True], (f[1:] != f[:-1]) | (bucket[1:] != bucket[:-1])))) - 1
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        shared = (np.minimum.reduceat(t, start) < np.maximum.reduceat(t, start)) | np.maximum.reduceat(flag, start)
        keep = shared[group] & ~flag  # the flagged are known to their own batch
        yield from by_text(t[keep], f[keep])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.frombuffer(t, "<i8"), _long(f)) for batch in batches for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        if not found:
            return
        t, f = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(t, kind="stable")
        t, f = t[order], f[order]
        cuts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        ends = np.append(cuts[1:], len(t))
        for k in range(0, len(cuts), 20_000):
            lows, highs = cuts[k : k + 20_000], ends[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(t[lows], pa.int64()), pa.array([_short(f[a:b]) for a, b in zip(lows, highs, strict=True)], pa.binary())], ["t", "fs"])

    reported = packed.repartition(buckets, "bucket").mapInArrow(meet, "to long, ts binary, fs binary")
    return reported.repartition(buckets, "to").mapInArrow(gather, "t long, fs binary")


def contexts(rows: DataFrame, length: int) -> DataFrame:
    """Of rows (t, doc, text, packed shared anchors): a row (f, ctx, offset, t, doc, begin, windows) per shared anchor."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["f", "ctx", "place", "t", "doc", "begin", "windows"]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        out: list[list] = [[] for _ in names]
        for batch in batches:
            for t, doc, text, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted = np.unique(_long(shared))
                f, at, begin, count = anchors(np.frombuffer(text, np.uint8), length)
                keep = np.isin(f & SUFFIX_BITS, wanted)
                f, at, begin, count = f[keep], at[keep], begin[keep], count[keep]
                out[0] += f.view(np.int64).tolist()
                out[1] += [text[a : a + n + length - 1] for a, n in zip(begin.tolist(), count.tolist(), strict=True)]
                out[2] += (at - begin).tolist()
                out[3] += [t] * len(f)
                out[4] += [doc] * len(f)
                out[5] += begin.tolist()
                out[6] += count.tolist()
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                    out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return rows.select("t", "doc", "text", "fs").mapInArrow(cut, "f long, ctx binary, place int, t long, doc long, begin long, windows int")


def _reach(parts: list[bytes], group: list[int], width: int) -> np.ndarray:
    """For each part the longest prefix that it has in common with another part of its group."""
    order = sorted(range(len(parts)), key=lambda k: (group[k], parts[k]))
    matrix = np.frombuffer(b"".join(parts[k].ljust(width, b"\xff") for k in order), np.uint8).reshape(len(parts), width)
    size = np.array([len(parts[k]) for k in order])
    g = np.array([group[k] for k in order])
    differ = matrix[1:] != matrix[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    common = np.minimum(common, np.minimum(size[1:], size[:-1])) * (g[1:] == g[:-1])
    best = np.zeros(len(parts), np.int64)
    best[order] = np.maximum(np.append(common, 0), np.append(0, common))
    return best


def earliest_windows(strings: list[tuple[int, bytes, int]], docs: list[int], length: int) -> list[list[int]]:
    """Per string (group, bytes, place of the anchor gram) and window in it: the earliest document with that window.

    All strings of a group have the same gram at their place, so it enters the suffix array as one symbol of the
    group's own; strings of different groups never match. Windows must contain the gram.
    """
    text: list[int] = []
    starts: list[int] = []
    reduced = length - GRAM + 1
    for group, data, place in strings:
        starts.append(len(text))
        text += [b + 2 for b in data[:place]]
        text.append(300 + group)
        text += [b + 2 for b in data[place + GRAM :]]
        text.append(1)
    text.append(0)
    order = np.array(suffix_array(text))
    symbols = np.array(text)
    first = np.full(len(text), -1, np.int64)  # of a window's start: its string
    result = [[docs[k]] * (len(data) - length + 1) for k, (_, data, _) in enumerate(strings)]
    for k, s in enumerate(starts):
        first[s : s + len(result[k])] = k
    order = order[first[order] >= 0]
    if len(order) < 2:
        return result
    rows = symbols[order[:, None] + np.arange(reduced)]
    run = np.cumsum(np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))) - 1
    owner = first[order]
    least = np.minimum.reduceat(np.array(docs)[owner], np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))))
    for position, k, doc in zip(order.tolist(), owner.tolist(), least[run].tolist(), strict=True):
        result[k][position - starts[k]] = doc
    return result


def _settle(rows: list[tuple], length: int) -> Iterator[tuple]:
    """Of contexts (f, ctx, place, doc) with whole groups: (f, ctx, begin, end) runs of windows that an earlier document has."""
    groups: dict[tuple[int, bytes], int] = {}
    group = [groups.setdefault((f, ctx[place : place + GRAM]), len(groups)) for f, ctx, place, _ in rows]
    side = length - GRAM
    left = _reach([r[1][: r[2]][::-1] for r in rows], group, side)
    right = _reach([r[1][r[2] + GRAM :] for r in rows], group, side)
    cut: dict[tuple, int] = {}
    docs: list[int] = []
    at: list[tuple[int, int, int] | None] = []
    for k, (_, ctx, place, doc) in enumerate(rows):
        low, high = place - int(left[k]), place + GRAM + int(right[k])
        if high - low < length:
            at.append(None)  # no other context reaches far enough
            continue
        key = (group[k], ctx[low:high], place - low)
        where = cut.setdefault(key, len(docs))
        if where == len(docs):
            docs.append(doc)
        docs[where] = min(docs[where], doc)
        at.append((where, low, high))
    strings = list(cut)
    earliest: list[list[int]] = []
    begin, symbols = 0, 0
    for k in range(len(strings) + 1):  # whole groups go into one suffix array
        if k == len(strings) or symbols > CHUNK_SYMBOLS and strings[k][0] != strings[k - 1][0]:
            if k > begin:
                earliest += earliest_windows(strings[begin:k], docs[begin:k], length)
            begin, symbols = k, 0
        if k < len(strings):
            symbols += len(strings[k][1]) - GRAM + 2
    for (f, ctx, place, doc), where in zip(rows, at, strict=True):
        if where is None:
            continue
        k, low, _ = where
        start = None
        for w, least in enumerate([*earliest[k], doc]):
            if least < doc and start is None:
                start = w
            elif least >= doc and start is not None:
                yield f, ctx, low + start, low + w
                start = None


def covered_runs(unsettled: DataFrame, length: int, most_contexts: int) -> DataFrame:
    """(f, ctx, runs): for contexts (f, ctx, place, doc, n) of anchors with several, their windows in earlier documents."""
    n = int(unsettled.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if len(held) >= 4096 and row[0] != held[-1][0]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            found: Iterable[tuple] = list(_settle(rows, length))
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], ["f", "ctx", "low", "high"])

    rows = unsettled.select("f", "ctx", "place", "doc", "n")
    whole = rows.where(F.col("n") <= most_contexts).repartition(n, "f").sortWithinPartitions("f").mapInArrow(settle, "f long, ctx binary, low int, high int")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of contexts whose anchor has too many for one task: earliest documents within this task's share."""
        for group in groups(batches):
            seen: dict[tuple, int] = {}
            index: dict[tuple[int, bytes], int] = {}
            for f, ctx, place, doc in group:
                key = (index.setdefault((f, ctx[place : place + GRAM]), len(index)), ctx, place)
                seen[key] = min(seen.get(key, doc), doc)
            strings = sorted(seen)
            least: list[list[int]] = []
            for k in range(0, len(strings), 1024):
                part = strings[k : k + 1024]
                least += earliest_windows(part, [seen[s] for s in part], length)
            of = {v: f for (f, _), v in index.items()}
            out = [(of[g], ctx, w, hashlib.blake2b(ctx[w : w + length], digest_size=16).digest(), doc) for (g, ctx, _), found in zip(strings, least, strict=True) for w, doc in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64()), strict=True)], ["f", "ctx", "w", "digest", "least"])

    large = rows.where(F.col("n") > most_contexts)
    if large.isEmpty():
        return whole
    parted = large.withColumn("part", F.pmod(F.xxhash64("ctx"), F.ceil(F.col("n") / most_contexts))).repartition(n, "f", "part").sortWithinPartitions("f")
    each = shared_table(parted.mapInArrow(windows, "f long, ctx binary, w int, digest binary, least long"), "dealt-windows")
    earliest = shared_table(each.groupBy("f", "digest").agg(F.min("least").alias("earliest")), "earliest-windows")
    own = large.select("f", "ctx", "doc")
    found = each.join(earliest, ["f", "digest"]).join(own, ["f", "ctx"]).where("earliest < doc").select("f", "ctx", F.col("w").alias("low"), (F.col("w") + 1).alias("high"))
    return whole.union(found)


def text_names(rows: DataFrame, hashed: Callable[[int], Column] = lambda seed: F.xxhash64(F.lit(seed), "text")) -> tuple[DataFrame, DataFrame]:
    """``rows`` (doc_id, text) with a number ``t`` that equal texts share and others don't, and (t, first, n_bytes) per text
    that has an id: the smallest id, and its bytes.

    Texts whose hash another text has too get their next hash instead, until no two share one. At 10^10 texts a few do.
    """
    named, clashing = hashed(0), []
    for seed in range(1, 9):
        held = rows.where("doc_id is not null").select("doc_id", named.alias("t"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
        texts = shared_table(held.groupBy("t", "digest").agg(F.min("doc_id").alias("first"), F.min("n_bytes").alias("n_bytes")), "texts")
        clashes = [r.t for r in texts.groupBy("t").count().where("count > 1").limit(MOST_CLASHES + 1).collect()]
        if not clashes:
            return rows.withColumn("t", named), texts.drop("digest")
        if len(clashes) > MOST_CLASHES:
            break
        named = F.when(named.isin(clashes), hashed(seed)).otherwise(named)
    raise RuntimeError("more texts share a hash than chance allows")


def repeated_spans(docs: DataFrame, texts: DataFrame, length: int, most_contexts: int) -> DataFrame:
    """(t, spans): byte spans covered by earlier documents, for rows (doc_id, t, text) and their ``texts`` (t, first, n_bytes)."""
    spark = docs.sparkSession
    buckets = buckets_for(spark, texts.agg(F.sum("n_bytes")).first()[0] or 0)
    long_enough = docs.where((F.octet_length("text") >= length) & F.col("doc_id").isNotNull())
    before = len(written(spark))
    lists = shared_table(shared_anchors(packed_anchors(long_enough.select("t", "text"), length, buckets), buckets), "shared-anchors")
    release_shuffles(spark)
    wanted = shared_table(lists.join(texts, "t").select("t", F.col("first").alias("doc_id"), "fs"), "anchor-lists")
    rows = long_enough.select("t", "doc_id", "text").join(wanted, ["t", "doc_id"]).withColumnRenamed("doc_id", "doc")
    placed = shared_table(contexts(rows, length), "contexts")
    clear_shared(spark, written(spark)[before:-1])  # all but the contexts themselves, which are stored
    release_shuffles(spark)
    firsts = shared_table(placed.groupBy("f", "ctx", "place").agg(F.min("doc").alias("doc")), "first-contexts")
    release_shuffles(spark)
    many = shared_table(firsts.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors-with-contexts")
    runs = shared_table(covered_runs(firsts.join(many, "f"), length, most_contexts), "covered-runs")
    release_shuffles(spark)
    key = F.substring(F.unhex(F.sha2("ctx", 256)), 1, 16).alias("c")
    runs = runs.groupBy("f", key).agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    known = shared_table(firsts.select("f", key, F.col("doc").alias("first")).join(runs, ["f", "c"], "left"), "known-contexts")
    clear_shared(spark, written(spark)[before + 1 : -1])
    release_shuffles(spark)
    whole = F.array(F.struct(F.lit(0).alias("low"), F.col("windows").alias("high")))
    hit = F.explode(F.when(F.col("doc") > F.col("first"), whole).otherwise(F.col("runs"))).alias("run")
    found = placed.select("f", key, "t", "doc", "begin", "windows").join(known, ["f", "c"]).where("doc > first or runs is not null").select("t", "begin", hit)
    span = F.struct((F.col("begin") + F.col("run.low")).alias("begin"), (F.col("begin") + F.col("run.high") - 1 + length).alias("end"))
    spans = shared_table(found.select("t", span.alias("span")).groupBy("t").agg(F.collect_list("span").alias("spans")), "spans")
    release_shuffles(spark)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, most_contexts: int = 200_000, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the bytes that remain."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    rows, texts = text_names(rows)
    rows = rows.select("doc_id", "t", F.col("text").cast("binary").alias("text"))
    spans = repeated_spans(rows, texts, length, most_contexts)
    info = shared_table(texts.select("t", "first").join(spans, "t", "left"), "text-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, first, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs: list[list[int]] = []
                if doc is not None and first is not None and doc > first:
                    runs = [[0, len(text)]] if len(text) >= length else []
                elif doc is not None:
                    for begin, end in sorted((s["begin"], s["end"]) for s in found or ()):
                        if runs and begin <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], end)
                        else:
                            runs.append([begin, end])
                kept, at = [], 0
                for begin, end in runs:
                    kept.append(text[at:begin])
                    at = end
                rest = b"".join([*kept, text[at:]])
                out.append((doc, len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest if keep_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = rows.join(info, "t", "left").select("doc_id", "text", "first", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if keep_text else done.drop("kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has, taken out of every document."""
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Every window of 50 bytes of every document, as its bytes.
OP10_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, array_slice(b, s, s + 49) AS w FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS s FROM d)),
hit AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY w) AS first FROM w) WHERE doc_id > first),
run AS (SELECT doc_id, s, sum(CASE WHEN s - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM hit)),
span AS (SELECT doc_id, k, min(s) AS lo, max(s) + 49 AS hi FROM run GROUP BY doc_id, k),
piece AS (SELECT doc_id, lo, hi, hex(array_slice(b, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) + 1, lo - 1)) AS kept FROM span JOIN d USING (doc_id)),
sums AS (SELECT doc_id, sum(hi - lo + 1)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(CASE WHEN lo > 1 THEN kept ELSE '' END, '' ORDER BY lo) AS kept, max(hi) AS hi FROM piece GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || CASE WHEN coalesce(hi, 0) < n THEN hex(array_slice(b, coalesce(hi, 0) + 1, n)) ELSE '' END)) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""
