"""Operator 6, exact top-k search by inner product, in the three phases of the uniform threshold algorithm.

Vectors become integers, floor(scale * x). A score is the sum of `parts` partial scores, one for each equal slice
of the dimensions. Rows lie in blocks, queries in blocks, and each pair of blocks is a unit of work.

1. Each unit gives, for each query, its k best scores among the first rows of the block (an eighth of them): local
   lists. The k-th best of all lists bounds a query's k-th best score from below.
2. This bound, the cutoff, goes out with the queries. A unit adds slice after slice; a score so far plus the product of the
   lengths of what is left of both vectors bounds a score from above. Rows and queries without a pair that may reach
   its cutoff are left out of the next slice.
3. Once few pairs are left, their remaining slices are added pair by pair; scores that reach the cutoff are ranked, ties
   to the smaller id.

Products are taken in double precision only where every partial sum is an integer below 2**53, else in Python
integers, so scores are exact; one beyond 64 bits raises an error. A query's own row is no candidate (same id).
Rows with a null id, a null vector, null or non-finite components, or another length than the query's take no part;
repeated ids are candidates each, and rows that repeat a query's id are ranked as one query, scores of both together. With
fewer than k candidates a query has all of them. Other columns are ignored, whatever their names. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdict.llm.common import checkpoint

#: Rows of a block of candidates and of a block of queries at most, on average; the share of a block's rows in local lists.
ROWS, QUERIES, SHARE = 16384, 512, 8
#: The cutoff of a query that has none.
NONE = -(2**63)


def _integers(vectors: np.ndarray) -> np.ndarray:
    """Doubles where sums of products stay exact in them, else Python integers."""
    most = float(np.abs(vectors).max()) if vectors.size else 0.0
    return vectors if most * most * max(1, vectors.shape[1]) < 2.0**53 else np.array([[int(x) for x in v] for v in vectors], object).reshape(vectors.shape)


def _blocks(rows: DataFrame, name: str, count: int, dealt_by: Column) -> DataFrame:
    """One row for each block of rows: their ids, the lengths of their vectors, the vectors' components and the cutoffs, in the same order."""
    block = F.pmod(F.xxhash64(dealt_by), F.lit(count))
    packed = rows.groupBy(block.alias(name)).agg(F.collect_list(F.struct("id", "vector", "cutoff")).alias("rows"))
    take = lambda c: F.transform("rows", lambda r: r[c])
    return packed.select(name, take("id").alias("ids"), F.transform("rows", lambda r: F.size(r["vector"])).alias("sizes"), F.flatten(take("vector")).alias("flat"), take("cutoff").alias("cutoffs"))


def search(table: DataFrame, is_query: Column, *, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 10, scale: int = 1024, parts: int = 4, rows_in_block: int = ROWS, queries_in_block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows of each query (a row for which is_query holds)."""
    named = table.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.transform(F.col(f"`{vector_column}`"), lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.transform(F.col(f"`{vector_column}`"), lambda x: x.cast("double")).alias("raw"))
    fit = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fitting = named.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & fit).drop("raw")
    rows = checkpoint(fitting.withColumn("cutoff", F.lit(NONE)))
    queries = rows.where("is_query").select("id", "vector")
    n, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = -(-n // rows_in_block) or 1, -(-n_queries // queries_in_block) or 1
    # The rows are read from a checkpoint, so each has the same place there every time; equal rows go to different blocks.
    candidates = checkpoint(_blocks(rows, "row_block", row_blocks, F.monotonically_increasing_id())).drop("cutoffs")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long")))

    def work(queries: DataFrame, phase, schema: str) -> DataFrame:
        """phase(ids, vectors, query ids, query vectors, cutoffs) for each pair of blocks."""
        asked = _blocks(queries, "query_block", query_blocks, F.struct("id", "vector")).select(F.col("ids").alias("q_ids"), F.col("sizes").alias("q_sizes"), F.col("flat").alias("q_flat"), "cutoffs", everywhere.alias("row_block"))
        pairs = asked.join(candidates, "row_block").drop("row_block")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for x in frame.itertuples(index=False):
                    for length in np.unique(x.q_sizes):
                        ids, vectors, _ = _of_length(x.ids, x.sizes, x.flat, length)
                        q_ids, q_vectors, at = _of_length(x.q_ids, x.q_sizes, x.q_flat, length)
                        if len(ids):
                            yield phase(ids, vectors, q_ids, q_vectors, np.asarray(x.cutoffs, np.int64)[at])

        return pairs.repartition(row_blocks * query_blocks).mapInPandas(run, schema)

    bounds = work(queries.withColumn("cutoff", F.lit(NONE)), lambda *x: _bounds(*x, k=k), "query_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    cutoffs = bounds.withColumn("at", F.row_number().over(best)).where(F.col("at") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cutoff"))
    again = queries.join(cutoffs, "id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(NONE)))
    found = work(again, lambda *x: _reaching(*x, parts=parts), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _of_length(ids, sizes, flat, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids and vectors of the rows of a block whose vectors have this length, and which rows they are."""
    sizes, flat = np.asarray(sizes), np.asarray(flat, np.float64)
    at = np.flatnonzero(sizes == length)
    if len(at) < len(sizes):
        flat = flat[np.repeat(sizes == length, sizes)]
    return np.asarray(ids, np.int64)[at], flat.reshape(len(at), length), at


def _pair(vectors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = _integers(np.vstack([vectors, queries]))
    return both[: len(vectors)], both[len(vectors) :]


def _bounds(ids, vectors, query_ids, queries, _, *, k: int) -> pd.DataFrame:
    """Phase 1: the k best scores of each query among the first rows."""
    few = max(k + 1, len(ids) // SHARE)
    v, q = _pair(vectors[:few], queries)
    scores, out = q @ v.T, []
    for i, query in enumerate(query_ids):
        own = scores[i, ids[:few] != query]
        out += [(int(query), int(x)) for x in (np.sort(own)[::-1][:k] if own.dtype == object or len(own) <= k else -np.partition(-own, k - 1)[:k])]
    return pd.DataFrame(out, columns=["query_id", "score"])


def _reaching(ids, vectors, query_ids, queries, cutoffs, *, parts: int) -> pd.DataFrame:
    """Phases 2 and 3: the scores that reach the cutoff of their query."""
    v, q = _pair(vectors, queries)
    edges = np.linspace(0, v.shape[1], parts + 1).astype(int)
    rows, asked = np.arange(len(v)), np.arange(len(q))  # those that still have a pair
    least, score = cutoffs.astype(np.float64), np.zeros((len(q), len(v)), v.dtype)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        score = score + q[asked, a:b] @ v[rows, a:b].T
        if b == edges[-1] or v.dtype == object:
            continue
        rest = np.outer(np.linalg.norm(q[asked, b:], axis=1), np.linalg.norm(v[rows, b:], axis=1))
        open_ = score + rest * (1 + 1e-9) + 1 >= least[asked, None]
        if open_.mean() < 1 / 8:
            i, j = np.nonzero(open_)
            i, j, known = asked[i], rows[j], score[i, j]
            whole = [known[n : n + 65536] + np.einsum("ij,ij->i", q[i[n : n + 65536], b:], v[j[n : n + 65536], b:]) for n in range(0, len(i), 65536)]
            return _named(ids, query_ids, cutoffs, i, j, np.concatenate(whole) if whole else known)
        keep_q, keep_v = open_.any(1), open_.any(0)
        asked, rows, score = asked[keep_q], rows[keep_v], score[np.ix_(keep_q, keep_v)]
    i, j = np.nonzero(score >= (cutoffs.astype(object) if v.dtype == object else least)[asked, None])
    return _named(ids, query_ids, cutoffs, asked[i], rows[j], score[i, j])


def _named(ids, query_ids, cutoffs, i, j, scores) -> pd.DataFrame:
    """The pairs of queries i and rows j that are not of one id and reach the cutoff."""
    out = [(int(query_ids[a]), int(ids[b]), int(s)) for a, b, s in zip(i, j, scores, strict=True) if int(s) >= int(cutoffs[a]) and query_ids[a] != ids[b]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


SEARCH_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
