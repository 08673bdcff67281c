import hashlib
import os
import random
import re
import tempfile

from tabwright.llm.exact_dedup import ContentTable, exact_duplicates, grace_dedup, op2_exact_dedup, reduce_stream


def brute(rows):
    norm = [re.sub(r"[ \t-\r]+", " ", t or "") for _, t in rows]
    ids: dict = {}
    for (i, _), t in zip(rows, norm, strict=True):
        ids.setdefault(t, []).append(i)
    keep = {t: min((i for i in v if i is not None), default=None) for t, v in ids.items()}
    return sorted(map(str, [(i, keep[t], len(ids[t]), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm, strict=True)]))


def test_awkward(awkward, awkward_docs, no_docs):
    assert sorted(str(tuple(r)) for r in exact_duplicates(awkward_docs).collect()) == brute([r[:2] for r in awkward])
    assert exact_duplicates(no_docs).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(str(tuple(r)) for r in op2_exact_dedup(spark, sf_dir).collect()) == brute(rows)


def entries(n, seed=1):
    rng = random.Random(seed)
    for _ in range(n):
        text = str(rng.randrange(300)).encode() * rng.randrange(1, 3)
        yield hashlib.sha256(text).digest(), text, rng.choice([None, rng.randrange(1000)]), 1


def merged(found):
    out: dict = {}
    for _, text, least, rows in found:
        old, n = out.get(text, (None, 0))
        out[text] = (min((x for x in (old, least) if x is not None), default=None), n + rows)
    return out


def test_spills_and_recursion():
    want = merged(entries(5000))
    for room in (1, 1000, 20_000, 1 << 30):
        found = list(grace_dedup(entries(5000), room))
        assert len(found) == len(want) and merged(found) == want
        assert merged(reduce_stream(entries(5000), room)) == want
    assert not [f for f in os.listdir(tempfile.gettempdir()) if f.startswith("grace-")]


def test_colliding_digests():
    same = [(b"\0" * 32, f"text {k % 7}".encode(), k, 1) for k in range(70)]
    for room in (1, 1 << 20):
        found = list(grace_dedup(same, room))
        assert sorted((c, k, n) for _, c, k, n in found) == [(f"text {k}".encode(), k, 10) for k in range(7)]
    table = ContentTable(4)
    for entry in same:
        assert table.add(*entry, 1 << 20)
    assert len(table.entries) == 7
