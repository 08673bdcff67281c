import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tabwright.llm.common import batches_of, map_batches
from tabwright.llm.ranked_search import FAN, RANGE, ROWS_AT_ONCE, Best, Query, Trees, best_first, lexical_index, op11_ranked_search, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """Every document's score for every item, term by term."""
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n_all, l_all = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 25 + (75 * n * n_all) // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms(text) if c[w])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    assert got(op11_ranked_search(spark, sf_dir)) == brute(docs, items)


def test_awkward(spark, awkward, awkward_docs, no_docs):
    docs = [r[:2] for r in awkward]
    items = [(1, awkward[0][1]), (2, None), (3, ""), (4, "x"), (None, "one TWO two"), (5, "nowhere"), (5, "one two"), (5, "one two"), (6, " \t"), (7, docs[15][1]), (8, "é")]
    given = spark.createDataFrame([(i, t, 1, "d", 2) for i, t in items], "item_id long, text string, item long, term string, doc_id long")
    index = lexical_index(awkward_docs)
    assert got(search(index, given)) == brute(docs, items)
    assert got(search(index, given, k=2, group_bytes=1, block_bytes=60_000)) == brute(docs, items, 2)
    assert search(index, given.limit(0)).count() == 0 and search(index, given.where("item_id = 2")).count() == 0 and search(index, given.where("item_id = 6")).count() == 0
    assert search(lexical_index(no_docs), given).count() == 0


@pytest.mark.parametrize("group_bytes", [1, 1 << 30])
def test_ties_over_ranges(spark, group_bytes):
    """Thousands of copies over many ranges and tasks: the smallest ids of equal scores, whichever range they are in."""
    rng = random.Random(3)
    docs = [(k, rng.choice(["a b c d", "a b", "b", "c c c", "d e f g h", f"z{k}"])) for k in range(6000)]
    rng.shuffle(docs)
    items = [(1, "a"), (2, "a b b"), (3, "c"), (4, "h z5 z17"), (5, "z9 z9 z10")]
    index = lexical_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert index.count() >= 6000 // RANGE
    assert got(search(index, spark.createDataFrame(items, "item_id long, text string"), group_bytes=group_bytes)) == brute(docs, items)


def test_few_nodes_are_opened():
    """One document of a range matches well: its node is opened, the others aren't."""
    n = RANGE
    rows = {"terms": ["rare", "often"], "held": [1, n], "docs": np.array([77, *range(n)], np.uint8).tobytes(), "counts": np.array([1] * (n + 1), np.int32).tobytes(), "doc_ids": list(range(n)), "lengths": [10] * n}
    trees = Trees(rows, {"rare": 0, "often": 1}, n, 10 * n)
    best = Best(1)
    assert best_first(Query(0, np.array([0, 1]), np.array([5000, 1])), [trees], best) == 2
    assert best.rows()[0][1] == 77
    assert best_first(Query(0, np.array([1]), np.array([1])), [trees], best := Best(1)) == 1 + FAN and best.rows()[0][1] == 0


def test_few_ranges_are_held_at_once(spark):
    """However many ranges a file of the index has, readers decode and Python gets a few at a time."""
    index = lexical_index(spark.range(RANGE * 20).selectExpr("id AS doc_id", "concat('a b', id) AS text").coalesce(1))
    groups = [pq.ParquetFile(f.removeprefix("file://").replace("file:", "")).metadata for f in index.inputFiles()]
    rows = [m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)]
    assert sum(rows) == 20 and max(rows) <= ROWS_AT_ONCE
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sized = map_batches(index.select("n_docs").coalesce(1), lambda batch: [pa.RecordBatch.from_pydict({"n": [len(batch)]})], "n long")
    with batches_of(spark, ROWS_AT_ONCE):
        seen = [r.n for r in sized.collect()]
    assert sum(seen) == 20 and max(seen) <= ROWS_AT_ONCE and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
