"""Operator 9, near-duplicate vectors by product quantisation: inverted lists, residual codes, exact cosines.

Equal vectors of a label are one class first. A coarse quantiser (k-means) puts each class in the inverted list of
its nearest centroid; what remains is coded by one codeword for each subspace. Both are fitted on a bounded sample
of vectors (the index only; every vector is in it); the number of lists grows as the square root of the largest
label's rows, up to `MOST_LISTS`.

A pair within the threshold's distance r in two lists lies within r of the plane between their centroids, on either
side, and each distance to the other's centroid is within r of the range of distances that its list has. A vector
probes the lists for which this holds, of a higher number than its own, so each pair meets once. In a list only the members
that could link back to the vector's own list are held against it: distances from the vector to codes come from a
table for each subspace; a code's known error e makes the test (table distance <= r + e) lossless, and the survivors'
cosines are computed in double precision. So no link is lost.

The members of a list and the vectors that probe it are cut into parts of bounded size, a unit of work for each pair
of parts. A unit gives the number of links of each class and edges to the smallest member of each component within
it, never all pairs.

Vectors that are null, zero, or hold null or non-finite components, and those with a null label or id, link with
nothing: their component is themselves. Vectors of different lengths never link. Equal rows (of one id too) are one
class; n_links counts other ids, so a repeated row adds nothing. Rows that repeat an id with different vectors are one
node of the components, are not compared with each other, and count once for each of their vectors that links.
Other columns are ignored, whatever their names. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import checkpoint
from verdict.operators.components import components as connected_components

_ID, _LABEL, _VECTOR = "vec_id", "label", "vector"
MOST_LISTS = 4096


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centroids of the rows of x; one that loses all its rows stays where it is."""
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest = _squares(x, centroids).argmin(1)
        sums, counts = np.zeros_like(centroids), np.bincount(nearest, minlength=len(centroids))
        np.add.at(sums, nearest, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of y."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)


class Quantiser:
    """Coarse centroids and, for each subspace of the residuals, codewords."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codewords: int, seed: int = 1):
        self.centroids = _kmeans(sample, min(lists, len(sample)), 8, seed)
        residual = sample - self.centroids[_squares(sample, self.centroids).argmin(1)]
        edges = np.linspace(0, sample.shape[1], subspaces + 1).astype(int)
        self.slices = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]
        self.codebooks = [_kmeans(residual[:, s], min(codewords, len(sample)), 6, seed + i) for i, s in enumerate(self.slices)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For unit vectors: the list, the distance to its centroid, the code and the code's error."""
        far = _squares(x, self.centroids)
        to = far.argmin(1)
        residual = x - self.centroids[to]
        code = np.stack([_squares(residual[:, s], b).argmin(1) for s, b in zip(self.slices, self.codebooks, strict=True)], 1).astype(np.uint8)
        spelled = np.concatenate([b[code[:, i]] for i, b in enumerate(self.codebooks)], 1)
        return to, np.sqrt(far[np.arange(len(x)), to]), code, np.linalg.norm(residual - spelled, axis=1)

    def could_link(self, x: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
        """Which lists may hold a vector within reach of unit vectors x of lists own: those whose plane is near enough."""
        far = _squares(x, self.centroids)
        return far - far[np.arange(len(x)), own][:, None] <= 2 * reach * np.sqrt(_squares(self.centroids[own], self.centroids)) + 1e-9

    def table_distances(self, x: np.ndarray, at: int, code: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the codes of list `at`, by table lookup."""
        residual, out = x - self.centroids[at], np.zeros((len(x), len(code)), np.float32)
        for i, (s, b) in enumerate(zip(self.slices, self.codebooks, strict=True)):
            out += _squares(residual[:, s], b).astype(np.float32)[:, code[:, i]]
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _joined(rows: np.ndarray, columns: np.ndarray, row_ids: np.ndarray, column_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node that occurs in the links to the smallest node of its component there."""
    nodes, ends = np.unique(np.concatenate([row_ids[rows], column_ids[columns]]), return_inverse=True)
    a, b = ends[: len(rows)], ends[len(rows) :]
    least = np.arange(len(nodes))
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            break
        least = new
    moved = least != np.arange(len(nodes))
    return nodes[moved], nodes[least[moved]]


def _classes(table: DataFrame, id_column: str, vector_column: str, label_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (id, label, vector: null if it can't link), the distinct ones that can link, and the classes of equal vectors: their smallest id and number of ids."""
    vector = F.col(f"`{vector_column}`")
    kind = dict(table.dtypes)[vector_column]
    numbers = vector if kind in ("array<float>", "array<double>") else vector.cast("array<double>")
    rows = table.select(F.col(f"`{id_column}`").cast("long").alias(_ID), F.col(f"`{label_column}`").alias(_LABEL), numbers.alias(_VECTOR))
    fit = F.forall(_VECTOR, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(_VECTOR, lambda x: x != 0)
    rows = rows.withColumn(_VECTOR, F.when(fit & F.col(_LABEL).isNotNull() & F.col(_ID).isNotNull(), F.col(_VECTOR)))
    ids = rows.where(F.col(_VECTOR).isNotNull()).groupBy(_LABEL, _VECTOR, _ID).agg(F.lit(1))
    return rows, ids.select(_ID, _LABEL, _VECTOR), ids.groupBy(_LABEL, _VECTOR).agg(F.min(_ID).alias("node"), F.count(F.lit(1)).alias("size"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of a batch whose vectors have one length, and these vectors in double precision, for each length."""
    lengths = batch.column(_VECTOR).value_lengths().to_numpy()
    for n in np.unique(lengths):
        own = batch.filter(pa.array(lengths == n))
        yield own, own.column(_VECTOR).flatten().to_numpy().astype(np.float64).reshape(len(own), n)


def links(classes: DataFrame, *, threshold: float = 0.98, sample_rows: int = 8192, lists: int | None = None, subspaces: int = 8, codewords: int = 64, block: int = 4096) -> DataFrame:
    """Of classes (label, vector, node, size): rows (node, n, to): n linked ids of other classes (0 in edges), and edges node - to.

    threshold: a cosine above 0. lists: how many inverted lists; unset, half the square root of the largest label's rows.
    """
    spark = classes.sparkSession
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    sizes = classes.groupBy(F.size(_VECTOR).alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    length, count = (sizes[0]["n"], sizes[0]["count"]) if sizes else (1, 0)
    largest = classes.groupBy(_LABEL).count().agg(F.max("count")).first()[0] or 1
    lists = min(MOST_LISTS, lists or max(1, round(largest**0.5 / 2)))
    wanted = max(sample_rows, 16 * lists)
    drawn = classes.where(F.size(_VECTOR) == length).select(_VECTOR).sample(min(1.0, wanted / max(1, count)), 1).limit(2 * wanted).collect()
    sample = _unit(np.array([r[0] for r in drawn], np.float64)) if drawn else np.eye(1, length)
    shared = spark.sparkContext.broadcast(Quantiser(sample, lists, subspaces, codewords))
    kinds = dict(classes.dtypes)
    coded = f"{_LABEL} {kinds[_LABEL]}, {_VECTOR} {kinds[_VECTOR]}, node long, size long, n int, list int, away double, code binary, error double"
    names = [x.split(" ")[0] for x in coded.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            for own, x in _by_length(batch):
                to, away, error = np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros(len(x))
                code = [b""] * len(x)
                if x.shape[1] == q.centroids.shape[1]:
                    to, away, packed, error = q.encode(_unit(x))
                    code = [c.tobytes() for c in packed]
                of = np.full(len(x), x.shape[1], np.int32)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(of), pa.array(to.astype(np.int32)), pa.array(away), pa.array(code, pa.binary()), pa.array(error)], names)

    members = checkpoint(classes.select(_LABEL, _VECTOR, "node", "size").mapInArrow(encode, coded))
    ranges = {r["list"]: (r["least"], r["most"]) for r in members.where(F.col("n") == length).groupBy("list").agg(F.min("away").alias("least"), F.max("away").alias("most")).collect()}
    annuli = spark.sparkContext.broadcast(np.array([ranges.get(i, (10.0, -10.0)) for i in range(len(shared.value.centroids))]))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            for own, x in _by_length(batch):
                at = [[i] for i in own.column("list").to_pylist()]
                if x.shape[1] == q.centroids.shape[1]:
                    near = q.could_link(_unit(x), own.column("list").to_numpy(), reach)
                    d = np.sqrt(_squares(_unit(x), q.centroids))
                    near &= (d <= annuli.value[:, 1] + reach) & (d >= annuli.value[:, 0] - reach)
                    row, to = np.nonzero(near)
                    cuts = np.searchsorted(row, np.arange(1, len(x)))
                    at = [[a[0], *t[t > a[0]].tolist()] for a, t in zip(at, np.split(to, cuts), strict=True)]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(at, pa.list_(pa.int32()))], [*names, "at"])

    asked = members.mapInArrow(probes, f"{coded}, at array<int>").withColumn("at", F.explode("at"))
    key = [_LABEL, "n", "at"]
    of_list = members.groupBy(_LABEL, "n", F.col("list").alias("at")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("m_parts"))
    of_probes = asked.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / (4 * block)).cast("int").alias("q_parts"))
    dealt = asked.join(of_list.join(of_probes, key), key)
    part = lambda salt, parts: F.pmod(F.xxhash64("node", F.lit(salt)), parts).cast("int")
    dealt = dealt.withColumn("m", F.when(F.col("at") == F.col("list"), part(1, F.col("m_parts"))).otherwise(F.lit(-1))).withColumn("q", part(2, F.col("q_parts")))
    up_to = lambda parts: F.sequence(F.lit(0), parts - 1)
    as_query = F.transform(up_to(F.col("m_parts")), lambda i: F.struct(i.alias("i"), F.col("q").alias("j")))
    as_member = F.when(F.col("m") >= 0, F.transform(up_to(F.col("q_parts")), lambda j: F.struct(F.col("m").alias("i"), j.alias("j")))).otherwise(F.filter(as_query, lambda x: F.lit(False)))
    units = dealt.withColumn("unit", F.explode(F.array_distinct(F.concat(as_query, as_member)))).select(*key, "unit.i", "unit.j", "m", "q", "node", "size", "list", "code", "error", _VECTOR)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    groups = units.repartition(tasks, *key, "i", "j").sortWithinPartitions(*key, "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _runs(batches, 5):
            found = _linked(unit, shared.value, threshold, reach)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "n", "to"])

    return groups.mapInArrow(compare, "node long, n long, to long")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows that agree in the first columns, from batches that are sorted by them."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = list(zip(*(c.to_pylist() for c in batch.columns[:keys]), strict=True))
        edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and ids[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = ids[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _linked(unit: pa.Table, q: Quantiser, threshold: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The links of a unit's members (m = i) with the vectors that probe their list (q = j): node, number of ids, edge."""
    unit = unit.combine_chunks()
    at, i, j = (unit.column(c)[0].as_py() for c in ("at", "i", "j"))
    node, size, own = (unit.column(c).to_numpy() for c in ("node", "size", "list"))
    vectors = unit.column(_VECTOR).chunk(0).flatten().to_numpy().astype(np.float64).reshape(len(node), -1)
    member, query = np.flatnonzero(unit.column("m").to_numpy() == i), np.flatnonzero(unit.column("q").to_numpy() == j)
    norms, coded = np.linalg.norm(vectors, axis=1), vectors.shape[1] == q.centroids.shape[1]
    if coded:
        unit_vectors = _unit(vectors)
        codes = np.stack([np.frombuffer(c, np.uint8) for c in unit.column("code").take(pa.array(member)).to_pylist()])
        limit = ((reach + unit.column("error").to_numpy()[member]) ** 2 * (1 + 1e-5) + 1e-6).astype(np.float32)
        back = q.could_link(unit_vectors[member], own[member], reach)
    first, second = [], []
    for a in np.unique(own[query]):
        asked = query[own[query] == a]
        held = np.flatnonzero(back[:, a]) if coded and a != at else np.arange(len(member))
        if not len(held):
            continue
        for start in range(0, len(asked), 1024):
            part = asked[start : start + 1024]
            near = q.table_distances(unit_vectors[part], at, codes[held]) <= limit[held] if coded else np.ones((len(part), len(held)), bool)
            near &= node[part, None] < node[member[held]] if a == at else node[part, None] != node[member[held]]
            x, y = np.nonzero(near)
            x, y = part[x], member[held][y]
            for k in range(0, len(x), 65536):
                u, v = x[k : k + 65536], y[k : k + 65536]
                hit = np.einsum("ij,ij->i", vectors[u], vectors[v]) / norms[u] / norms[v] >= threshold
                first.append(u[hit])
                second.append(v[hit])
    x, y = (np.concatenate(v) if v else np.zeros(0, int) for v in (first, second))
    if not len(x):
        return None
    counts = (np.bincount(x, size[y], len(node)) + np.bincount(y, size[x], len(node))).astype(np.int64)
    some = counts > 0
    nodes, to = _joined(x, y, node, node)
    return np.concatenate([node[some], nodes]), np.concatenate([counts[some], np.zeros(len(nodes), np.int64)]), np.concatenate([node[some], to])


def near_duplicates(table: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", **how) -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) of every vector."""
    rows, ids, classes = _classes(table, id_column, vector_column, label_column)
    classes = checkpoint(classes)
    found = checkpoint(links(classes, **how))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.select(F.col("node").alias("a"), F.col("to").alias("b"))
    several = ids.groupBy(_ID).count().where("count > 1").select(_ID)
    if not several.isEmpty():  # what an id's vectors link with is reached through the id
        edges = edges.unionByName(ids.join(several, _ID).join(classes, [_LABEL, _VECTOR]).select(F.col(_ID).alias("a"), F.col("node").alias("b")))
    parts = connected_components(edges)
    known = classes.join(counts, "node", "left").join(parts, "node", "left")
    known = known.select(_LABEL, _VECTOR, (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    whole = rows.join(known, [_LABEL, _VECTOR], "left")
    component = F.coalesce("component", _ID)
    return whole.select(F.col(_ID).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col(_ID), F.lit(True)).alias("kept"))


DEDUP_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reached AS (
  SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(least(e.vec_id, r.least), e.vec_id) AS component_id,
       coalesce(least(e.vec_id, r.least), e.vec_id) = e.vec_id AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(DISTINCT b) AS n FROM linked GROUP BY a) n ON e.vec_id = n.a
LEFT JOIN (SELECT a, min(b) AS least FROM reached GROUP BY a) r ON e.vec_id = r.a
"""
