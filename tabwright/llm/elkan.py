"""Centroid clustering with Elkan's bounds, in exact integers.

Each vector keeps an upper bound of its distance to its own centroid and a lower bound of that to every other. A round
shifts the bounds by how far the centroids have moved; a distance is only computed where neither the lower bound nor half
the distance between the two centroids lies above the upper bound. Bounds are 32-bit floats rounded outward (upper ones up,
lower ones down, after each operation), and only what lies strictly above prunes, so an equally near centroid of a
smaller number is never missed. Distances that are computed, sums and the final distances are whole numbers.

A round is one job: tasks read vectors with their bounds, write them again, and write one row of sums per cluster beside
them. The driver gets ``k`` rows of sums, never vectors, and holds the centroids. Vectors and bounds lie in the shared
folder (the table before is deleted once the next is written), so a lost executor costs its tasks. Nothing is
shuffled by cluster but a task's sums, so a cluster that holds all vectors is no hot key.

Defined results: a vector that is null, has other than ``dims`` components, or one that is null, NaN or infinite is left
out; a component x becomes floor(1024 * x); beyond 2^27 either way it is refused with an error, as squared distances
would not fit 64 bits. Null ids count as empty when the first centroids are drawn; among rows alike in id the smaller
vector comes first; repeated rows are vectors of their own. With fewer vectors than ``k`` there are as many centroids as
vectors; an empty table gives no rows. Ties go to the smaller centroid; a centroid without vectors stays. Other columns
may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import clear_shared, map_partitions, new_folder, table

SCALE, DIMS, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, 3
MOST = 1 << 27
#: kind 0: a vector (as 4-byte whole numbers) with its cluster, distance and bounds (upper, then lower ones); kind 1: sums of a cluster in a task.
STATE = "kind int, vec_id long, vector binary, cluster int, distance long, bounds binary, n long, inertia decimal(38,0), sums array<decimal(38,0)>"
_SUM, _F32 = pa.decimal128(38, 0), np.float32


def up(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats that are no smaller, with room for one rounding of what was computed in 64 bits."""
    return np.nextafter(np.asarray(x, np.float64).astype(_F32), _F32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats that are no larger; not below 0."""
    return np.maximum(np.nextafter(np.asarray(x, np.float64).astype(_F32), _F32(-np.inf)), _F32(0))


def squared(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number vectors to one of them, exact."""
    gap = rows.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", gap, gap)


class Bounds:
    """What a round needs to know about its centroids: where they are, how far they moved, how far they are apart."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None) -> None:
        k = len(centroids)
        self.centroids = centroids
        self.moved = None if before is None else up(np.sqrt([float(squared(before[j : j + 1], centroids[j])[0]) for j in range(k)]))
        apart = np.sqrt(np.array([squared(centroids, c) for c in centroids], np.float64))
        self.half = down(np.asarray(down(apart), np.float64) / 2)
        np.fill_diagonal(self.half, np.inf)
        self.nearest = self.half.min(axis=1)

    def assign(self, rows: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """One round over vectors, in place; how many distances were computed."""
        if self.moved is not None:
            upper[:] = up(upper.astype(np.float64) + self.moved[cluster])
            lower[:] = down(lower.astype(np.float64) - self.moved)
        open_ = np.flatnonzero(upper >= self.nearest[cluster]) if len(self.centroids) > 1 else np.empty(0, np.int64)
        if not len(open_):
            return 0
        own, x = cluster[open_], rows[open_]
        exact = np.full((len(open_), len(self.centroids)), np.iinfo(np.int64).max)
        computed = len(open_)
        for j in np.unique(own):
            at = np.flatnonzero(own == j)
            exact[at, j] = squared(x[at], self.centroids[j])
        tight = up(np.sqrt(exact[np.arange(len(own)), own].astype(np.float64)))
        low = lower[open_]
        low[np.arange(len(own)), own] = down(np.sqrt(exact[np.arange(len(own)), own].astype(np.float64)))
        for j, c in enumerate(self.centroids):
            at = np.flatnonzero((own != j) & (low[:, j] <= tight) & (self.half[own, j] <= tight))
            exact[at, j] = squared(x[at], c)
            low[at, j] = down(np.sqrt(exact[at, j].astype(np.float64)))
            computed += len(at)
        best = exact.argmin(axis=1)  # the first of equal ones
        cluster[open_], lower[open_] = best, low
        upper[open_] = up(np.sqrt(exact[np.arange(len(own)), best].astype(np.float64)))
        return computed


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    flat = np.ascontiguousarray(values)
    width = flat.shape[1] * flat.itemsize
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _rows(values: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Binary values of one width as rows of an array that may be written."""
    first = np.frombuffer(values.buffers()[1], np.int32)[values.offset]
    return np.frombuffer(values.buffers()[2], dtype, len(values) * width, first).reshape(len(values), width).copy()


def _state(ids: pa.Array, rows: np.ndarray, cluster: np.ndarray, distance: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    n = len(rows)
    columns = [pa.array(np.zeros(n, np.int32)), ids, _fixed(rows), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), _fixed(bounds), pa.nulls(n, pa.int64()), pa.nulls(n, _SUM), pa.nulls(n, pa.list_(_SUM))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STATE.split(", ")])


def _sums(n: np.ndarray, inertia: list[int], sums: list[list[int]]) -> pa.RecordBatch:
    at = np.flatnonzero(n)
    columns = [pa.array(np.ones(len(at), np.int32)), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.array(at, pa.int32()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary())]
    columns += [pa.array(n[at], pa.int64()), pa.array([inertia[j] for j in at], _SUM), pa.array([sums[j] for j in at], pa.list_(_SUM))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STATE.split(", ")])


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(vec_id, x): the vectors that count, in whole numbers."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = (F.size(v) == dims) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    whole = F.transform(v, lambda x: F.when(F.abs(x) < MOST / SCALE, F.floor(x * SCALE).cast("int")).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST // SCALE}")).cast("int")))
    return df.where(F.coalesce(sound, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole.alias("x"))


def _first(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes: ``k`` rows."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in vectors.orderBy(drawn, "x").limit(k).select("x").collect()], np.int64)


def _moved(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of means."""
    totals = stored.where("kind = 1").select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # k * dims rows
    moved = centroids.copy()
    for r in totals:
        moved[r.cluster, r.d] = int(r.s) // r.n
    return moved


def _round(before: DataFrame, bounds: Bounds, dims: int, begun: bool, last: bool) -> DataFrame:
    k = len(bounds.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        n, inertia, sums = np.zeros(k, np.int64), [0] * k, [[0] * dims for _ in range(k)]
        for batch in batches:
            if not len(batch):
                continue
            if begun:
                rows, held = _rows(batch.column(1), np.int32, dims), _rows(batch.column(3), _F32, k + 1)
                cluster, upper, lower = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), held[:, 0].copy(), held[:, 1:].copy()
            else:
                rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(batch), dims)
                cluster, upper, lower = np.zeros(len(batch), np.int64), np.full(len(batch), np.inf, _F32), np.zeros((len(batch), k), _F32)
            bounds.assign(rows, cluster, upper, lower)
            distance = np.zeros(len(batch), np.int64)
            for j in np.unique(cluster):
                at = cluster == j
                n[j] += int(at.sum())
                if last:
                    distance[at] = squared(rows[at], bounds.centroids[j])
                    inertia[j] += sum(map(int, distance[at])) if int(distance[at].max()) > 1 << 40 else int(distance[at].sum())
                else:
                    sums[j] = [a + int(b) for a, b in zip(sums[j], rows[at].sum(axis=0, dtype=np.int64), strict=True)]
            kept = rows[:, :0] if last else rows
            yield _state(batch.column(0), kept, cluster, distance, np.column_stack([upper, lower])[:, : 0 if last else k + 1])
        yield _sums(n, inertia, sums)

    columns = ["vec_id", "vector", "cluster", "bounds"] if begun else ["vec_id", "x"]
    return map_partitions((before.where("kind = 0") if begun else before).select(*columns), run, STATE)


def cluster_vectors(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector that counts: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = df.sparkSession
    vectors = whole_vectors(df, id_col, vector_col, dims)
    centroids, before, stored, path = _first(vectors, k, seed), None, vectors, None
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    for r in range(rounds + 1):
        made = _round(stored, Bounds(centroids, before), dims, r > 0, r == rounds)
        new = new_folder(spark, "elkan")
        made.write.option("compression", "zstd").parquet(new)
        if path:
            clear_shared(spark, [path])
        stored, path = spark.read.schema(made.schema).parquet(new), new
        if r < rounds:
            before, centroids = centroids, _moved(stored, centroids)
    inertia = {r.cluster: int(r.s) for r in stored.where("kind = 1").groupBy("cluster").agg(F.sum("inertia").alias("s")).collect()}  # k rows
    total, digest = sum(inertia.values()), [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    said = spark.createDataFrame([(j, inertia.get(j, 0), total, d) for j, d in enumerate(digest)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return stored.where("kind = 0").select("vec_id", "cluster", "distance").join(F.broadcast(said), "cluster").select(*[c.split()[0] for c in schema.split(", ")])  # k rows


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Every distance of every round; exact, without bounds."""
    parts = [
        f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
),
long AS MATERIALIZED (SELECT i, d, v[d] AS x FROM kept, (SELECT unnest(range(1, {DIMS + 1})) AS d)),
c0 AS MATERIALIZED (
  SELECT j, d, v[d] AS y FROM (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept) ORDER BY h, v LIMIT {CLUSTERS}),
    (SELECT unnest(range(1, {DIMS + 1})) AS d)
)"""
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT i, arg_min(j, (s, j)) AS j, min(s) AS s FROM (SELECT i, j, sum((x - y) * (x - y)) AS s FROM long JOIN c{r} USING (d) GROUP BY i, j) GROUP BY i)")
        if r < ROUNDS:
            mean = "(t - ((t % n + n) % n)) // n"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, c.d, coalesce(m, y) AS y FROM c{r} c LEFT JOIN (SELECT j, d, ({mean})::BIGINT AS m FROM (SELECT j, d, sum(x) AS t, count(*) AS n FROM long JOIN a{r} USING (i) GROUP BY j, d)) USING (j, d))")
    return f"""
WITH {", ".join(parts)},
said AS (SELECT j, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS digest FROM c{ROUNDS} GROUP BY j)
SELECT vec_id, j::INT AS cluster, s::BIGINT AS distance, (sum(s) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(s) OVER ())::BIGINT AS inertia, digest AS centroid_sha256
FROM kept JOIN a{ROUNDS} USING (i) JOIN said USING (j)
"""


OP12_SQL = _sql()
