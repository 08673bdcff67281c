import hashlib
import math
import random

import numpy as np
import pytest

from tabwright.llm.elkan import Bounds, cluster_vectors, op12_clusters


def brute(rows, k=8, rounds=10, dims=64, seed=3):
    """Every distance of every round, in Python's whole numbers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j))
    for _ in range(rounds):
        at = [nearest(v) for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = [nearest(v) for _, v in kept]
    away = [far(v, centroids[a]) for (_, v), a in zip(kept, at, strict=True)]
    said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    within = [sum(d for d, a in zip(away, at, strict=True) if a == j) for j in range(len(centroids))]
    return sorted(str((i, a, d, within[a], sum(away), said[a])) for (i, _), a, d in zip(kept, at, away, strict=True))


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(op12_clusters(spark, sf_dir)) == brute(rows)


def awkward_vectors(dims):
    rng = random.Random(5)
    grid = lambda: [rng.randrange(-2, 3) / 1024 for _ in range(dims)]  # noqa: E731 (few values: many ties)
    rows = [(k, grid()) for k in range(300)]
    same = grid()
    rows += [(1000 + k, same) for k in range(150)] + [(7, same), (7, same), (None, grid()), (None, same), (-3, [0.0] * dims), (-4, [-0.0] * dims)]
    rows += [(2000, None), (2001, []), (2002, grid()[1:]), (2003, [*grid(), 0.0]), (2004, [None, *grid()[1:]]), (2005, [math.nan, *grid()[1:]]), (2006, [math.inf, *grid()[1:]])]
    return rows


@pytest.mark.parametrize("dims", [2, 64])
def test_awkward(spark, dims):
    rows = awkward_vectors(dims)
    df = spark.createDataFrame([(i, v, 1, "x", None, 5) for i, v in rows], "vec_id long, embedding array<float>, cluster int, vector string, kind int, n long").repartition(5)
    assert got(cluster_vectors(df, rounds=4, dims=dims)) == brute(rows, rounds=4, dims=dims)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert cluster_vectors(spark.createDataFrame([], schema)).count() == 0
    assert cluster_vectors(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    for n in (1, 3):
        rows = [(k, [float(k), 1.0]) for k in range(n)]
        assert got(cluster_vectors(spark.createDataFrame(rows, schema), rounds=2, dims=2)) == brute(rows, rounds=2, dims=2)


def test_large_components(spark):
    rows = [(k, [s * 131071.5, 0.001 * k]) for k in range(6) for s in (1, -1)]
    assert got(cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, rounds=2, dims=2)) == brute(rows, 3, 2, 2)
    with pytest.raises(Exception, match="beyond"):
        cluster_vectors(spark.createDataFrame([(1, [131072.0, 0.0])], "vec_id long, embedding array<double>"), dims=2).collect()


@pytest.mark.parametrize("seed", range(20))
def test_bounds_miss_no_tie(seed):
    """Rounds over whole-number vectors with many ties against all distances; far fewer distances are computed than there are."""
    rng = np.random.default_rng(seed)
    spread = int(rng.choice([2, 50, 100_000_000]))
    rows = rng.integers(-spread, spread, (400, 3)).astype(np.int32) + (rng.integers(0, 4, (400, 1)) * spread // 3).astype(np.int32)
    centroids = rows[:9].astype(np.int64)
    cluster, upper, lower, before, computed = np.zeros(400, np.int64), np.full(400, np.inf, np.float32), np.zeros((400, 9), np.float32), None, 0
    for _ in range(12):
        computed += Bounds(centroids, before).assign(rows, cluster, upper, lower)
        gap = rows.astype(np.int64)[:, None, :] - centroids[None]
        exact = (gap * gap).sum(axis=2)
        assert (cluster == exact.argmin(axis=1)).all()
        assert (upper.astype(float) >= np.sqrt(exact[np.arange(400), cluster])).all() and (lower.astype(float) <= np.sqrt(exact)).all()
        before, centroids = centroids, np.array([rows[cluster == j].sum(axis=0, dtype=np.int64) // max(1, (cluster == j).sum()) if (cluster == j).any() else centroids[j] for j in range(9)])
    assert computed < 0.8 * 12 * 9 * 400
