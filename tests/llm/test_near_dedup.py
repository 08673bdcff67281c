import random
import re

import numpy as np
import pyarrow as pa

from tabwright.llm import near_dedup
from tabwright.llm.components import components
from tabwright.llm.near_dedup import estimate, keep_one_each, near_duplicates, op3_near_dedup, registers
from tabwright.llm.shingles import shingle_sets


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, percent=85):
    """(doc_id, n_shingles, component, kept) by comparing all pairs; rows of one id are one node."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    out = [(i, len(s), None if i is None else top(i) if s else i) for i, s in sets]
    return sorted(map(str, [(i, n, c, i == c) for i, n, c in out]))


def found(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_awkward(awkward, awkward_docs, no_docs):
    assert found(near_duplicates(awkward_docs)) == brute([r[:2] for r in awkward])
    assert near_duplicates(no_docs).count() == 0
    kept = keep_one_each(awkward_docs)
    assert kept.columns == awkward_docs.columns
    # Each group's smallest id once, rows without id, and what is linked with nothing; 50 has the texts of 5 and of 22.
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [-1, 2, 6, 7, 8, 10, 20, 21, 30, 31, 40]


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op3_near_dedup(spark, sf_dir)) == brute(rows)


def test_families(spark, monkeypatch):
    """A passage with tails of many lengths: chains of links, and many pairs just below the threshold."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for k in range(90):
        rows.append((k, f"{passage} {' '.join(rng.choice(words) for _ in range(rng.randrange(14)))}"))
    rows += [(100 + k, passage.replace("w1", "v1", k)) for k in range(12)]
    rng.shuffle(rows)
    assert found(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_far_copies(spark, monkeypatch):
    """Copies of one text with so many words changed that most have no partner, in several lengths."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(11)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for k in range(160):
        words = list(base[: rng.choice([140, 145, 150])])
        for at in rng.sample(range(len(words)), rng.choice([1, 2, 3, 4, 5])):
            words[at] = rng.choice([f"own{k}x{at}", f"twin{k // 2}x{at}", "same"])
        rows.append((k, " ".join(words)))
    rows += [(-5, rows[3][1] + " more"), (-5, rows[7][1] + " other"), (-5, rows[8][1].replace("w", "v")), (170, rows[8][1].replace("w", "v") + " end")]
    assert found(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_lone_shingles(spark):
    rows = [(1, b"a b c d e f"), (2, b"b c d e f g"), (3, b"q r"), (4, b""), (5, b"x y z x y z x y z")]
    assert {r.rep: r.lone for r in near_dedup.lone_shingles(spark.createDataFrame(rows, "rep long, text binary").repartition(3), 5).collect()} == {1: 1, 2: 1, 3: 1, 5: 3}


def test_may_have_partner(spark):
    """Members are held against the others of their bucket, never against themselves."""
    rows = [(1, 1, 100, 100), (1, 2, 100, 95), (1, 3, 97, 90), (2, 4, 100, 90), (2, 5, 90, 100), (2, 6, 50, 200), (3, 7, 100, 99), (4, 8, 100, 100), (4, 9, 100, 100)]
    rng = random.Random(8)
    rows += [(10 + rng.randrange(60), 100 + k, n := rng.randrange(20, 30), n + rng.randrange(-4, 3)) for k in range(300)]
    df = spark.createDataFrame(rows, "key long, rep long, n_shingles long, most long")

    def partners(x, y):
        return x[0] == y[0] and x[1] != y[1] and x[2] <= y[3] and y[2] <= x[3] and 100 * min(x[2], y[2]) >= 85 * max(x[2], y[2])

    want = {x[1] for x in rows if any(partners(x, y) for y in rows)}
    assert {r.rep for r in near_dedup.may_have_partner(df, 85).collect()} == want and want & set(range(10)) == {4, 5, 8, 9}


def test_estimate():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.85, 0.95):
        got = []
        for _ in range(60):
            both, own = int(1000 * share), int(1000 * (1 - share) / 2)
            pool = rng.integers(0, 1 << 63, both + 2 * own, dtype=np.uint64) * np.uint64(2)
            x, y = np.sort(pool[: both + own]), np.sort(np.concatenate([pool[:both], pool[both + own :]]))
            got.append(estimate(registers(x)[None], registers(y)[None], np.array([float(len(x))]), np.array([float(len(y))]))[0][0])
        assert abs(np.mean(got) - share) < 0.02


def test_shingle_sets():
    rng = random.Random(5)
    texts = ["", " ", "a", "A b", "a b c d e", "a b c d e f", "É x y z w v"] + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(30))) for _ in range(200)]
    sets = list(shingle_sets(pa.array([t.encode() for t in texts], pa.binary())))
    named: dict = {}
    for text, got in zip(texts, sets, strict=True):
        want = shingles(text)
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()
        named.setdefault(frozenset(want), got.tobytes())
        assert named[frozenset(want)] == got.tobytes()
    assert len(set(named.values())) == len(named)


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(100, 160)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5)]
    root = {x: x for p in links for x in p}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
