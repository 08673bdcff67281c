import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from tabwright.llm.sharding import assign_shards, carried_names, chunk_of, group_shards, levelled, longest_first, op9_sharding


def check(rows, got, shards=24):
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, where = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        where[r.text_crc32, r["size"]].add(r.shard)
    assert all(0 <= s < shards for s in slots)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(s) == 1 for s in where.values())
    loads, groups = Counter(), Counter()
    for r in got:
        loads[r.shard] += r["size"]
        groups[r.text_crc32, r["size"]] += r["size"]
    return [loads[s] for s in range(shards)], max(groups.values(), default=0)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = op9_sharding(spark, sf_dir)
    loads, largest = check(rows, out.collect())
    assert max(loads) - min(loads) <= largest
    assert out.select("law", "grown_shard").distinct().collect() == [("bytes", None)]


@pytest.mark.parametrize("shards", [1, 5])
def test_awkward(spark, awkward, awkward_docs, no_docs, shards):
    rows = [r[:2] for r in awkward]
    check(rows, assign_shards(awkward_docs, shards, chunk_rows=2).collect(), shards)
    assert assign_shards(no_docs).count() == 0
    kept = assign_shards(awkward_docs, shards, carry=["text", "words", "n", "first"])
    assert kept.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "text", "words", "n", "first"]
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, awkward_docs.select("doc_id", "text").collect()))


def test_hot_group(spark):
    """A third of all rows has one text; the other shards still share the rest evenly."""
    rows = [(k, "same text" if k % 3 == 0 else f"text {k} " + "x" * (k % 50)) for k in range(3000)]
    loads, largest = check(rows, assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8, chunk_rows=50).collect(), 8)
    rest = sorted(loads)[:-1] if max(loads) == largest else loads
    assert max(rest) - min(rest) < 0.05 * sum(loads) / 8


def heap_over_all(sizes, shards):
    """LPT with a heap over every single group: loads, and how many groups of each size a shard has."""
    heap, got = [(0, k) for k in range(shards)], defaultdict(lambda: [0] * shards)
    for size in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        got[size][k] += 1
        heapq.heappush(heap, (load + size, k))
    return [load for load, _ in sorted(heap, key=lambda x: x[1])], dict(got)


def test_longest_first():
    assert dict(longest_first([(5, 1), (4, 1), (3, 3)], 2)) == {5: [1, 0], 4: [0, 1], 3: [1, 2]}
    assert dict(longest_first([], 3)) == {}
    rng = random.Random(5)
    for shards in (1, 2, 7, 24):
        for most in (3, 40, 2000):
            sizes = [rng.choice([8, 9, rng.randrange(8, 60), rng.randrange(8, 5000)]) for _ in range(most)] + [9] * most * 3
            assert dict(longest_first(sorted(Counter(sizes).items(), reverse=True), shards)) == heap_over_all(sizes, shards)[1]
    loads = [7, 3, 3, 10]
    assert levelled(loads, 4, 6) == [1, 2, 2, 1] and levelled(loads, 4, 1) == [0, 1, 0, 0]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_as_a_heap_over_all_groups(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    loads, _ = check(rows, assign_shards(docs, chunk_rows=50).collect())
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 8
    assert loads == heap_over_all(groups.values(), 24)[0]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6, "s", "c"), (2, "b", 7, 8, "t", "d")], "doc_id int, text string, shard int, slot int, size string, text_crc32 string")
    got = assign_shards(docs, 2, carry=["text", "shard", "slot", "size", "text_crc32"])
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "text", "shard_given", "slot_given", "size_given", "text_crc32_given"]
    assert sorted(tuple(r)[5:] for r in got.collect()) == [("a", 5, 6, "s", "c"), ("b", 7, 8, "t", "d")]
    assert carried_names(["Size", "size_given"]) == {"Size": "Size_given_given", "size_given": "size_given"}


def test_null_ids_are_spread(spark):
    """Rows without an id but with texts of their own: chunks stay small, slots have no gaps."""
    rows = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('text ', id) AS text")
    got = assign_shards(rows, 4, chunk_rows=500)
    per = got.groupBy("shard").agg({"slot": "max", "doc_id": "count", "size": "count"}).collect()
    assert sum(r["count(size)"] for r in per) == 20_000 and all(r["max(slot)"] + 1 == r["count(size)"] for r in per)
    key = F.md5(F.md5(F.col("text").cast("binary")).cast("binary"))
    chunks = rows.groupBy(chunk_of(key, F.lit(40)).alias("c")).count().collect()
    assert len(chunks) == 40 and max(r["count"] for r in chunks) < 700


def test_schedule_by_pieces(spark):
    """A schedule that goes to a table by pieces is the one that fits into a piece, whether the last piece is full or not."""
    rng = random.Random(3)
    groups = spark.createDataFrame([(f"{rng.randrange(1 << 32):08x}{k}", rng.choice([9, 10, rng.randrange(8, 90)])) for k in range(2_000)], "group_key string, bytes long")
    whole = sorted(group_shards(groups, 5, 100).collect())
    n = groups.select("bytes").distinct().count()
    for piece in (1 + n // 4, n, n // 2, n + 1):
        assert sorted(group_shards(groups, 5, 100, piece).collect()) == whole
    assert len(whole) == 2_000 and {r.shard for r in whole} == set(range(5))
    assert group_shards(groups.limit(0), 5, 100).count() == 0
