"""Operator 12, centroid clustering of integer vectors, centroids filtered by an n-simplex projection.

Vectors are integers, floor(scale * x), so every distance, tie and centroid is exact. A few of the first centroids are
the pivots of the whole run. A vector's distances to them, taken once, place it as the apex over the simplex that the
pivots span: as many coordinates as pivots, the last its height above their hull. The apexes are cached beside the
vectors. Each round places the centroids in the same way; two apexes' distance, with the heights on one side of the hull or
on either side, bounds the distance of vector and centroid from below and above. The centroid of the smallest lower bound is compared
first; of the others, those whose lower bound passes neither the smallest upper bound nor that distance. Comparisons are in
integers, ties go to the smaller number. Rounding of the bounds is covered by a slack.

A round is one pass over the cached rows: each task adds up its vectors by cluster, so one row for each cluster and task is
shuffled, and `k` rows of sums reach the driver, which divides them in whole numbers. No cluster's vectors are ever
brought together, however large it is.

The first centroids are the kept vectors with the smallest sha256 of salt + id, rows of one id by their components. Rows that
repeat are vectors each. A null id is kept and clustered, but is first centroid only where too few ids are not null.
Vectors that are null, of another length than `dims`, or with null or non-finite components are left out. Fewer
vectors than `k` give fewer clusters; an empty table gives no rows. Other columns are ignored, whatever their names.
Components are taken exactly; one beyond 64 bits, or a squared distance beyond them, raises an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import checkpoint

#: Components up to this size are compared in 64-bit integers (with 64 of them, sums stay below 2**62), others in Python's.
SMALL = 2**27
#: Pairs of a vector and a centroid that are compared at once.
PAIRS = 1 << 16


class Simplex:
    """The simplex over pivots: its vertices' coordinates, and apexes of vectors over it.

    Pivots are taken from the candidates one by one, each the farthest from the hull of those before, so the simplex is
    never flat; candidates that add no height are left out.
    """

    def __init__(self, candidates: np.ndarray, most: int):
        chosen, rest, axes = [0], candidates - candidates[0], []
        first = 0.0
        while len(chosen) < min(most, len(candidates)):
            height = np.linalg.norm(rest, axis=1)
            i = int(height.argmax())
            first = first or float(height[i])
            if not np.isfinite(height[i]) or height[i] <= 1e-3 * first or height[i] == 0:
                break
            axes.append(rest[i] / height[i])
            rest = rest - np.outer(rest @ axes[-1], axes[-1])
            chosen.append(i)
        self.pivots = candidates[chosen]
        offsets = self.pivots[1:] - self.pivots[0]
        self.base = np.tril(offsets @ np.array(axes).T) if axes else np.zeros((0, 0))
        self.squares = (self.base**2).sum(1)

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """One row of coordinates for each vector, from its distances to the pivots; the last is the height."""
        with np.errstate(over="ignore", invalid="ignore"):
            d = np.stack([((vectors - p) ** 2).sum(1) for p in self.pivots], 1)
            flat = np.linalg.solve(self.base, ((d[:, :1] - d[:, 1:] + self.squares) / 2).T).T if len(self.base) else np.zeros((len(vectors), 0))
            return np.column_stack([flat, np.sqrt(np.maximum(0, d[:, 0] - (flat**2).sum(1)))])


def bounds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of the vectors with apexes x to those with apexes y."""
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.zeros((len(x), len(y)))
        for j in range(x.shape[1] - 1):
            flat += (x[:, j, None] - y[None, :, j]) ** 2
        a, b = x[:, -1, None], y[None, :, -1]
        slack = 1e-6 * (np.abs(x).max(initial=0) + np.abs(y).max(initial=0))
        return np.sqrt(flat + (a - b) ** 2) - slack, np.sqrt(flat + (a + b) ** 2) + slack


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), in 64 bits where no component is beyond SMALL, else in Python's integers."""
    if np.abs(x).max(initial=0) * scale < SMALL:
        return np.floor(x * scale).astype(np.int64)
    if np.abs(x).max() >= 2.0**62 / scale:
        raise ArithmeticError("a component leaves 64 bits")
    return np.array([[math.floor(Fraction(float(c)) * scale) for c in row] for row in x], object).reshape(x.shape)


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, placed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the nearest centroid (of several the first) and the squared distance; and how many pairs were compared."""
    small = vectors.dtype != object and centroids.dtype != object
    v, w = (vectors, centroids) if small else (vectors.astype(object), centroids.astype(object))

    def squares(i: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([((v[i[n : n + PAIRS]] - w[c[n : n + PAIRS]]) ** 2).sum(1) for n in range(0, len(i), PAIRS)])

    low, high = (np.nan_to_num(x, nan=n) for x, n in zip(bounds(apexes, placed), (0, np.inf), strict=True))
    first = low.argmin(1)
    most = np.minimum(high.min(1), np.sqrt(squares(np.arange(len(v)), first).astype(np.float64)) * (1 + 1e-9))
    i, c = np.nonzero(low <= most[:, None])
    d = squares(i, c)
    best = np.minimum.reduceat(d, np.searchsorted(i, np.arange(len(v))))
    at = np.flatnonzero(d == best[i])
    at = at[np.unique(i[at], return_index=True)[1]]
    if not small and max(best) >= 2**63:
        raise ArithmeticError("a squared distance leaves 64 bits")
    return c[at].astype(np.int32), best.astype(np.int64), len(i)


def _kept(table: DataFrame, id_column: str, vector_column: str, dims: int) -> DataFrame:
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return table.where((F.size(vector) == dims) & finite).select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), vector.alias("vector"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def cluster(table: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, pivots: int = 32, salt: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = table.sparkSession
    context = spark.sparkContext
    kept = _kept(table, id_column, vector_column, dims)
    seeds = kept.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "vector").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = integers(np.array([r["vector"] for r in seeds]), scale).astype(object)
    simplex = Simplex(centroids.astype(np.float64), pivots)
    width = len(simplex.pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apexes = simplex.apexes(integers(_matrix(b.column(1), dims), scale).astype(np.float64))
            ends = np.arange(0, apexes.size + 1, width, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, apexes.ravel())], ["vec_id", "vector", "apex"])

    cached = checkpoint(kept.mapInArrow(place, "vec_id long, vector array<double>, apex array<double>"))

    def assigned(b: pa.RecordBatch, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vectors = integers(_matrix(b.column(1), dims), scale)
        now = now.astype(np.int64) if max(abs(int(x)) for x in now.flat) < SMALL else now
        to, distance, _ = nearest(vectors, _matrix(b.column(2), width), now, simplex.apexes(now.astype(np.float64)))
        return vectors, to, distance

    def sums(now):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((k, dims), object), np.zeros(k, np.int64)
            for b in batches:
                if b.num_rows:
                    vectors, to, _ = assigned(b, now.value)
                    count += np.bincount(to, minlength=k)
                    for c in np.unique(to):
                        total[c] += vectors[to == c].sum(0).astype(object)
            full = np.flatnonzero(count)
            exact = pa.array([[int(x) for x in total[c]] for c in full], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(count[full]), exact], ["cluster", "n", "sums"])

        return cached.mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")

    for _ in range(rounds):
        parts = sums(context.broadcast(centroids))
        whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(dims)))
        centroids = centroids.copy()
        for r in whole.collect():  # k rows at most
            centroids[r["cluster"]] = [int(r[f"s{j}"]) // r["n"] for j in range(dims)]
    last = context.broadcast(centroids)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, to, distance = assigned(b, last.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(to), pa.array(distance)], ["vec_id", "cluster", "distance"])

    final = checkpoint(cached.mapInArrow(label, "vec_id long, cluster int, distance long"))
    inertia = {r["cluster"]: int(r["total"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, n, sum(inertia.values()), digest[c]) for c, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, salt: str = "2:") -> str:
    """The same rows in SQL: one step of assigning and one of averaging for each round."""
    assign = lambda name, before: f"""{name} AS MATERIALIZED (
  SELECT id, first(c ORDER BY d, c) AS c, min(d) AS d FROM (
    SELECT v.id, m.c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM vectors v CROSS JOIN {before} m)
  GROUP BY id)"""  # noqa: E731
    steps = []
    for r in range(rounds):
        steps.append(assign(f"a{r}", f"m{r}"))
        steps.append(f"""m{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(n.x, o.x) AS x FROM m{r} o LEFT JOIN (
    SELECT c, list(q ORDER BY j) AS x FROM (
      SELECT c, j, ((sum(x[j]) - ((sum(x[j]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS q
      FROM a{r} JOIN vectors USING (id) CROSS JOIN range(1, {dims + 1}) t(j) GROUP BY c, j) GROUP BY c) n USING (c))""")
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id), x) - 1 AS c, x FROM vectors QUALIFY c < {k}),
{", ".join(steps)},
{assign("last", f"m{rounds}")}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m{rounds}.x, ',')) AS centroid_sha256
FROM last JOIN vectors USING (id) JOIN m{rounds} USING (c)
"""


CLUSTER_SQL = cluster_sql()
