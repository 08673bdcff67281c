"""Topics of texts, learned without labels: clusters of term vectors.

A text's vector holds the square roots of the shares of its words in ``WIDTH`` hashed places, in steps of 1 / ``ONE``; from it
the mean vector of its language goes, so that clusters are about what is said and not about the language it is said in.
Means and centres are found over all documents (``sample``: over about so many, those of smallest draws): k-means, whose rounds are
jobs over written vectors. Starts are drawn: the first at random, each next one in proportion to its squared distance from
those before. Every document, whole, then gets its nearest centre. Topics are named t0, t1, ... from the largest to the smallest.

All are whole numbers, and doubles hold their products and sums exactly, so the order in which rows come or are added up makes no
difference. The driver holds centres only; means of languages are a table, which is joined.

Defined results: a text without words has topic "none"; of equally near centres the first counts. With fewer distinct vectors
than topics there are fewer topics, with none only "none".
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import map_batches, map_partitions, shared_table
from tabwright.llm.shingles import text_slices, word_bounds, word_hashes

WIDTH, ONE, ROUNDS = 256, 65_535, 30
NO_TOPIC = "none"


def term_vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text its number of words and its vector."""
    counts, rows = [], []
    for _, offsets, data in text_slices(texts):
        starts, ends = word_bounds(offsets, data)
        n = len(offsets) - 1
        owner = np.searchsorted(offsets, starts, "right") - 1
        place = (word_hashes(data, starts, ends) % np.uint64(WIDTH)).astype(np.int64)
        terms = np.bincount(owner * WIDTH + place, minlength=n * WIDTH).reshape(n, WIDTH)
        total = terms.sum(1)
        counts.append(total)
        rows.append(np.sqrt(terms / np.maximum(total, 1)[:, None]).astype(np.float32))
    if not rows:
        return np.empty(0, np.int64), np.empty((0, WIDTH), np.float32)
    return np.concatenate(counts), np.concatenate(rows)


def packed(vectors: np.ndarray) -> pa.Array:
    """Vectors as two bytes a place."""
    return pa.array([r.tobytes() for r in np.rint(vectors.astype(np.float64) * ONE).astype("<u2")], pa.binary())


def unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of whole numbers, as doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), WIDTH).astype(np.float64)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)


def language_means(rows: DataFrame) -> DataFrame:
    """(lang, mean): whole numbers of four bytes a place; a task adds up its languages, and those of one language follow each other
    in the second step."""

    def add(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        if len(batch):
            langs, code = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            sums = np.zeros((len(langs), WIDTH))
            np.add.at(sums, code, unpacked(batch.column(1), "<u2"))
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs.tolist(), pa.string()), "n": np.bincount(code), "sums": pa.array([s.astype("<i8").tobytes() for s in sums], pa.binary())})

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        lang, n, sums = None, 0, np.zeros(WIDTH, np.int64)
        row = lambda: pa.RecordBatch.from_pydict({"lang": pa.array([lang], pa.string()), "mean": pa.array([(sums // n).astype("<i4").tobytes()], pa.binary())})
        for batch in batches:
            for name, k, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n and name != lang:
                    yield row()
                    n, sums = 0, np.zeros(WIDTH, np.int64)
                lang, n, sums = name, n + k, sums + np.frombuffer(own, "<i8")
        if n:
            yield row()

    sums = map_batches(rows.select("lang", "vector"), add, "lang string, n long, sums binary")
    return map_partitions(sums.repartition("lang").sortWithinPartitions("lang"), divide, "lang string, mean binary")


def _start(rows: DataFrame, centres: np.ndarray) -> np.ndarray | None:
    """One more start, drawn in proportion to the squared distance from ``centres``; none if all vectors are centres."""
    step = len(centres)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        best, chosen = np.inf, None
        for batch in batches:
            if len(batch):
                x = unpacked(batch.column(1), "<i4")
                far = ((x**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * x @ centres.T).min(1) if step else np.ones(len(x))
                chance = np.modf(np.array(batch.column(0)) * 9_973.0 * (step + 1) + step * 0.6180339887)[0]  # of its own for each step
                wait = np.where(far > 0, -np.log1p(-chance) / np.maximum(far, 1), np.inf)
                k = int(wait.argmin())
                if wait[k] < best:
                    best, chosen = float(wait[k]), x[k].astype("<i4").tobytes()
        if chosen is not None:
            yield pa.RecordBatch.from_pydict({"wait": [best], "vector": pa.array([chosen], pa.binary())})

    found = map_partitions(rows, draw, "wait double, vector binary").agg(F.min(F.struct("wait", "vector")).alias("first")).first().first
    return None if found is None else np.frombuffer(found.vector, "<i4").astype(np.float64)


def _sums(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors are nearest to each centre, and their sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        n, sums = np.zeros(len(centres), np.int64), np.zeros((len(centres), WIDTH))
        for batch in batches:
            if len(batch):
                x = unpacked(batch.column(0), "<i4")
                own = nearest(x, centres)
                n += np.bincount(own, minlength=len(centres))
                sums += (own[None] == np.arange(len(centres))[:, None]).astype(np.float64) @ x
        yield pa.RecordBatch.from_pydict({"j": pa.array(range(len(centres)), pa.int32()), "values": pa.array([[int(k), *map(int, s)] for k, s in zip(n, sums, strict=True)], pa.list_(pa.int64()))})

    parts = map_partitions(rows.select("vector"), add, "j int, values array<long>").select("j", F.posexplode("values"))
    out = np.zeros((len(centres), WIDTH + 1), np.int64)
    for r in parts.groupBy("j", "pos").agg(F.sum("col").alias("s")).collect():  # a number per centre and place
        out[r.j, r.pos] = r.s
    return out[:, 0], out[:, 1:]


def fit_topics(rows: DataFrame, n_topics: int) -> np.ndarray:
    """Up to ``n_topics`` centres, the ones of most vectors first, from all of ``rows`` (draw, vector less its language's mean)."""
    centres = np.empty((0, WIDTH))
    while len(centres) < n_topics and (start := _start(rows, centres)) is not None:
        centres = np.vstack([centres, start])
    for _ in range(ROUNDS if len(centres) else 0):
        n, sums = _sums(rows, centres)
        moved = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centres).astype(np.float64)
        if (moved == centres).all():
            break
        centres = moved
    return centres[np.argsort(-_sums(rows, centres)[0], kind="stable")] if len(centres) else centres


def centred(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Means of languages, and (draw, vector) of rows with words less the mean of their language; both written once."""
    rows = rows.where("tokens > 0").select("lang", "draw_topic", "vector")
    means = shared_table(language_means(rows), "topic-means")

    def less(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        if len(batch):
            x = unpacked(batch.column(1), "<u2") - unpacked(batch.column(2), "<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())], ["draw", "vector"])

    return means, shared_table(map_batches(rows.join(means, "lang").select("draw_topic", "vector", "mean"), less, "draw double, vector binary"), "topic-vectors")


def topic_names(counts: np.ndarray, x: np.ndarray, centres: np.ndarray) -> list[str]:
    if not len(centres) or not len(x):
        return [NO_TOPIC] * len(x)
    return [f"t{j}" if n else NO_TOPIC for j, n in zip(nearest(x, centres).tolist(), counts.tolist(), strict=True)]
