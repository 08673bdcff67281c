"""Ranked lexical search: a hierarchical max tree over document ranges per term, searched best first.

``lexical_index`` turns documents into ranges of at most ``RANGE`` documents, one row each: ids, lengths, and for each term
the documents that hold it and how often. That is a projection of the documents, written once; nothing is shuffled.

``search`` reads it for a set of items. N, L and the items' document frequencies are sums over the index. A task takes its
ranges in groups; for each term of the items it builds a tree of largest impacts, with a level of ranges, of ``FAN`` nodes
in a range, and of documents. An item's bound for a node is the sum of its terms' weights times the node's impacts; at a
document it is the score. The search opens the node of the highest bound first, range, node or document, until ten
documents are found and all bounds left are lower than the tenth score. Nodes with an equal bound are opened, as a
document of a smaller id may lie below. A task hands on ten rows per item at most, and its tenth score is the
threshold for its next group. A first pass over one range in ``FIRST_OF`` finds scores that the tenth can't be lower
than, with which all tasks begin; it saves work only, every range is searched.

Ranges are rows of some hundred kilobytes, so they are stored, read and handed to Python by ``ROWS_AT_ONCE``: what a task holds
doesn't grow with its share of the index. A group holds up to ``GROUP_BYTES`` of trees. Items are searched in blocks of up to ``BLOCK_BYTES`` of text, which tasks hold;
the index is the same for all. No key is hot: nothing is dealt by term, and the rows dealt by item are ten a task.

Terms are maximal runs of digits, letters and non-ASCII characters, with A to Z lower-cased. Defined results: null, or a
text without terms, is no document (it isn't counted), and no item; texts of any length are indexed whole (a long one ends
its range); repeated rows are documents of their own; null ids come after all others among equal scores; every row of
items is ranked for itself, also where ids repeat or are null; without documents or items there are no rows; other columns may
have any names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.llm.common import batches_of, map_partitions, shared_table, table

FAN = 16
RANGE = FAN * FAN
#: A range is closed once it has so many pairs of term and document.
RANGE_PAIRS = 1 << 18
GROUP_BYTES, BLOCK_BYTES, FIRST_OF = 48 << 20, 4 << 20, 32
#: Rows of the index in a row group and in a batch.
ROWS_AT_ONCE = 8
#: By byte: what isn't part of a term becomes a blank, A to Z become a to z.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "drawn int, n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, terms array<string>, held array<int>, docs binary, counts binary"
FOUND = "item long, doc_id long, score long"


def terms_of(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").translate(FOLDED).split()


def _range_row(docs: list[tuple[int | None, int, Counter]]) -> pa.RecordBatch:
    """One range of (id, length, how often each term)."""
    at, out = {}, []
    for k, (_, _, counts) in enumerate(docs):
        for term, n in counts.items():
            out.append((at.setdefault(term, len(at)), k, n))
    found = np.array(out, np.int64).reshape(-1, 3)
    found = found[np.argsort(found[:, 0], kind="stable")]
    drawn = hash((tuple(d[0] for d in docs[:4]), len(out))) % FIRST_OF
    columns = [
        pa.array([drawn], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([sum(d[1] for d in docs)], pa.int64()), pa.array([[d[0] for d in docs]], pa.list_(pa.int64())), pa.array([[d[1] for d in docs]], pa.list_(pa.int64())),
        pa.array([[t.decode(errors="replace") for t in at]], pa.list_(pa.string())), pa.array([np.bincount(found[:, 0], minlength=len(at))], pa.list_(pa.int32())),
        pa.array([found[:, 1].astype(np.uint8).tobytes()], pa.binary()), pa.array([found[:, 2].astype(np.int32).tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])


def lexical_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents, as a table in the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held, pairs = [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(text.as_py())
                if not words:
                    continue
                held.append((i, len(words), Counter(words)))
                pairs += len(held[-1][2])
                if len(held) == RANGE or pairs >= RANGE_PAIRS:
                    yield _range_row(held)
                    held, pairs = [], 0
        if held:
            yield _range_row(held)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    with batches_of(docs.sparkSession, RANGE):
        return shared_table(map_partitions(rows, build, INDEX), "lexical", ROWS_AT_ONCE)


@dataclass
class Query:
    """An item: its terms by their places in the block's vocabulary, and their weights times how often they stand in it."""

    item: int
    terms: np.ndarray
    weights: np.ndarray


class Trees:
    """The trees of one range, for the terms of a block that it holds; the row after the last is that of terms it doesn't."""

    def __init__(self, row: dict, vocabulary: dict[str, int], n: int, total: int) -> None:
        places = np.array([vocabulary.get(t, -1) for t in row["terms"]], np.int64)
        held = np.array(row["held"], np.int64)
        known = places >= 0
        self.ids: list[int | None] = row["doc_ids"]
        take = np.repeat(known, held)
        docs = np.frombuffer(row["docs"], np.uint8)[take]
        times = np.frombuffer(row["counts"], np.int32)[take].astype(np.int64)
        norms = np.array([25 + 75 * x * n // total for x in row["lengths"]], np.int64)
        rows = int(known.sum())
        self.documents = np.zeros((rows + 1, RANGE), np.int32)  # impacts are below a million
        self.documents[np.repeat(np.arange(rows), held[known]), docs] = 1_000_000_000 * times // (1000 * times + 8 * norms[docs])
        self.nodes = self.documents.reshape(rows + 1, FAN, FAN).max(axis=2)
        self.top = self.nodes.max(axis=1)
        self.place = np.full(len(vocabulary), rows, np.int32)
        self.place[places[known]] = np.arange(rows)
        self.n_bytes = self.documents.nbytes + self.nodes.nbytes + self.place.nbytes


def _key(i: int | None) -> float | int:
    """Larger for smaller ids; null ids are last."""
    return -math.inf if i is None else -i


class Best:
    """The highest scores of an item so far, and the score below which no further one counts."""

    def __init__(self, k: int, least: int = 1) -> None:
        self.k, self.least, self.held = k, least, []

    def add(self, score: int, i: int | None) -> None:
        entry = (score, _key(i))
        if len(self.held) < self.k:
            heapq.heappush(self.held, entry)
        elif entry > self.held[0]:
            heapq.heapreplace(self.held, entry)
        if len(self.held) == self.k:
            self.least = max(self.least, self.held[0][0])

    def rows(self) -> list[tuple[int, int | None]]:
        return [(s, None if key == -math.inf else -key) for s, key in self.held if s >= self.least]


def best_first(query: Query, trees: list[Trees], best: Best) -> int:
    """Search one item in a group of ranges; how many nodes were opened."""
    places = [t.place[query.terms] for t in trees]
    heap = [(-int(query.weights @ t.top[p]), -1, k) for k, (t, p) in enumerate(zip(trees, places, strict=True))]
    heap = [h for h in heap if -h[0] >= best.least]
    heapq.heapify(heap)
    opened = 0
    while heap and -heap[0][0] >= best.least:
        _, node, k = heapq.heappop(heap)
        opened += 1
        t, p = trees[k], places[k]
        if node < 0:
            bounds = query.weights @ t.nodes[p]
            for c in np.flatnonzero(bounds >= best.least).tolist():
                heapq.heappush(heap, (-int(bounds[c]), c, k))
        else:
            scores = query.weights @ t.documents[p, node * FAN : (node + 1) * FAN]
            for c in np.flatnonzero(scores >= best.least).tolist():
                best.add(int(scores[c]), t.ids[node * FAN + c])
    return opened


def _found(index: DataFrame, queries: list[Query], vocabulary: dict[str, int], n: int, total: int, k: int, least: dict[int, int], group_bytes: int) -> DataFrame:
    """(item, doc_id, score): up to ``k`` rows of a task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        best = [Best(k, least.get(q.item, 1)) for q in queries]
        group: list[Trees] = []

        def searched() -> None:
            for q, b in zip(queries, best, strict=True):
                best_first(q, group, b)
            group.clear()

        for batch in batches:
            for r in range(len(batch)):
                group.append(Trees({c: batch.column(i)[r].as_py() for i, c in enumerate(batch.schema.names)}, vocabulary, n, total))
                if sum(t.n_bytes for t in group) > group_bytes:
                    searched()
        searched()
        rows = [(q.item, i, s) for q, b in zip(queries, best, strict=True) for s, i in b.rows()]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return map_partitions(index.select("doc_ids", "lengths", "terms", "held", "docs", "counts"), run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _document_frequencies(index: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for r in range(len(batch)):
                places = np.array([vocabulary.get(t, -1) for t in batch.column(0)[r].as_py()], np.int64)
                held = np.array(batch.column(1)[r].as_py(), np.int64)
                df[places[places >= 0]] += held[places >= 0]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["place", "df"])

    counts = np.zeros(len(vocabulary), np.int64)
    for r in map_partitions(index.select("terms", "held"), count, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).collect():  # the block's vocabulary at most
        counts[r.place] = r.df
    return counts


def search(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each item's ``k`` documents of the highest scores above 0: item_id, rank, doc_id, score."""
    schema = "item_id long, rank int, doc_id long, score long"
    spark = index.sparkSession
    n, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    given = items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    given = shared_table(given.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    n_bytes = given.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if not n or not n_bytes:
        return spark.createDataFrame([], schema)
    blocks, parts = -(-n_bytes // block_bytes), []
    for b in range(blocks):
        vocabulary: dict[str, int] = {}
        counted = []
        for r in given.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect():  # about block_bytes
            counts = Counter(t.decode(errors="replace") for t in terms_of(r.text))
            if counts:
                counted.append((r.item, counts, [vocabulary.setdefault(t, len(vocabulary)) for t in counts]))
        if not counted:
            continue
        with batches_of(spark, ROWS_AT_ONCE):
            weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in _document_frequencies(index, vocabulary).tolist()], np.int64)
            queries = [Query(i, np.array(p), weights[p] * np.array(list(c.values()))) for i, c, p in counted]
            seen = _ranked(_found(index.where("drawn = 0"), queries, vocabulary, n, total, k, {}, group_bytes), k)
            least = {r.item: r.score for r in seen.where(F.col("rank") == k).collect()}  # a row per item of the block
            parts.append(shared_table(_ranked(_found(index, queries, vocabulary, n, total, k, least, group_bytes), k), "ranked"))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(given.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search(lexical_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


#: Every document's score for every item.
OP11_SQL = r"""
WITH t AS MATERIALIZED (SELECT i, doc_id, w, count(*) AS tf FROM (
  SELECT row_number() OVER () AS i, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents) GROUP BY ALL),
d AS (SELECT i, sum(tf)::BIGINT AS n FROM t GROUP BY i),
s AS (SELECT count(*) AS n_all, sum(n)::BIGINT AS l_all FROM d),
m AS (SELECT i, 25 + (75 * n * n_all) // l_all AS m FROM d, s),
f AS (SELECT w, floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM t, s GROUP BY w, n_all),
q AS (SELECT b, item_id, w, count(*) AS k FROM (
  SELECT row_number() OVER () AS b, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY ALL),
r AS (SELECT b, item_id, doc_id, sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN f USING (w) JOIN t USING (w) JOIN m USING (i) GROUP BY b, item_id, i, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id))::INT AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
