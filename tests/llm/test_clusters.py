import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.oracle import connect, rows
from verdict.llm import centroid_clusters as cc
from verdict.llm import registry


def brute(table, k, rounds, dims, scale=256, salt="2:"):
    """Lloyd's rounds in plain integers."""
    kept = [(i, v) for i, v in table if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(Fraction(x) * scale) for x in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, hashlib.sha256(f"{salt}{kept[n][0]}".encode()).hexdigest() if kept[n][0] is not None else "", kept[n][1]))
    centroids = [ints[n] for n in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for v in ints]

    for _ in range(rounds):
        to = assign()
        for n in range(len(centroids)):
            own = [v for v, (_, c) in zip(ints, to, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    to = assign() if ints else []
    total = {n: sum(d for d, c in to if c == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, total[c], sum(total.values()), digest[c]) for (i, _), (d, c) in zip(kept, to, strict=True)]


def run(spark, table, **how):
    df = spark.createDataFrame([(i, v, "a", 1, "b") for i, v in table], "vec_id long, embedding array<double>, cluster string, distance int, apex string")
    return [tuple(r) for r in cc.cluster(df.repartition(3), **how).collect()]


def plain(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("k", "dims"), [(7, 6), (40, 64), (3, 1)])
def test_agrees_with_plain_rounds(spark, k, dims):
    rng = random.Random(k)
    middle = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    table = [(i, [m + rng.gauss(0, 0.1) for m in middle[i % 5]]) for i in range(150)]
    table += [(5, table[5][1]), (5, [0.5] * dims), (None, [0.25] * dims), (None, table[5][1])]  # repeated rows, repeated and null ids
    table += [(900, None), (901, []), (902, [1.0] * (dims + 1)), (903, [None] * dims), (904, [float("nan")] * dims), (905, [float("inf")] * dims)]
    assert plain(run(spark, table, k=k, dims=dims)) == plain(brute(table, k, 5, dims))


def test_ties_and_equal_vectors(spark):
    table = [(i, [float(i % 2), 0.0]) for i in range(20)] + [(50 + i, [0.5, 0.0]) for i in range(5)]
    got = run(spark, table, k=10, dims=2)
    assert plain(got) == plain(brute(table, 10, 5, 2))
    same = [(i, [0.125, -3.0]) for i in range(9)]
    assert {r[1] for r in run(spark, same, k=4, dims=2)} == {0}


def test_huge_components(spark):
    table = [(i, [float(i) * 2**22, -(2.0**20), 0.1]) for i in range(8)]
    assert plain(run(spark, table, k=3, dims=3)) == plain(brute(table, 3, 5, 3))
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [1e300, 0.0]), (2, [-1e300, 0.0])], k=1, dims=2)


def test_few_and_no_rows(spark):
    assert plain(run(spark, [(3, [1.0, 2.0])], k=40, dims=2)) == plain(brute([(3, [1.0, 2.0])], 40, 5, 2))
    assert run(spark, [(3, None)], dims=2) == []


def test_sql_on_a_small_table(spark, small):
    df = registry.op12_centroid_clusters(spark, small)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    relation = connect(small).execute(cc.CLUSTER_SQL)
    assert got == rows([c[0] for c in relation.description], relation.fetchall())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 8), st.integers(1, 6))
def test_bounds_hold(seed, dims, pivots):
    """Distances lie between the bounds, also of vectors that equal a pivot or lie in the hull."""
    draw = np.random.default_rng(seed)
    x = np.floor(draw.normal(0, 200, (30, dims)))
    simplex = cc.Simplex(x[:10], pivots)
    low, high = cc.bounds(simplex.apexes(x), simplex.apexes(x))
    true = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert (low <= true).all() and (true <= high).all()


def test_bounds_filter():
    """In clustered data few centroids are left to compare."""
    draw = np.random.default_rng(3)
    middle = draw.normal(0, 50, (40, 64))
    x = np.floor(middle[draw.integers(0, 40, 2000)] + draw.normal(0, 4, (2000, 64))).astype(np.int64)
    c = np.floor(middle).astype(np.int64)
    simplex = cc.Simplex(c.astype(float), 16)
    to, d, compared = cc.nearest(x, simplex.apexes(x.astype(float)), c, simplex.apexes(c.astype(float)))
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (to == every.argmin(1)).all() and (d == every.min(1)).all()
    assert compared < 40 * 2000 / 10
