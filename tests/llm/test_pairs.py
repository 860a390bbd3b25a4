import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdict.llm import exact_topk, jaccard_join, registry, vector_dedup
from verdict.operators.components import components as connected_components


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    own = [(i, sets(t)) for i, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            (i, x), (j, y) = own[a], own[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in own}


def corpus(seed, families=6, members=14):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return rows + [None, "", "  ", "one", "ONE", "one two", "long " * 3000]


@pytest.mark.parametrize("block", [4, 2048])
def test_joins_agree_with_brute_force(spark, block):
    rows = list(enumerate(corpus(block)))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs, block=block).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize(("block", "most"), [(6, 10**6), (2048, 300)])
def test_dense_family_below_the_threshold(spark, block, most):
    """Copies of one text that share keys, most of which do not link: nothing is lost, also between blocks."""
    rng = random.Random(block)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(5)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert 3 < len({c for _, c in want.values()}) < 60
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs, block=block, most=most).collect()}
    assert got == want


def test_very_long_texts_link(spark):
    base = [f"w{i}" for i in range(12_000)]
    near = base[:11_000] + [f"v{i}" for i in range(1000)]
    docs = spark.createDataFrame([(5, " ".join(base)), (2, " ".join(near)), (9, " ".join(base[:6000]))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {5: 2, 2: 2, 9: 9}


def test_group_gives_spanning_links_only():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 500, np.uint64)
    sets = [np.unique(np.concatenate([base[:480], rng.integers(0, 2**63, 20, np.uint64)])) for _ in range(300)]
    assert len(jaccard_join.Group(sets, np.arange(300), 75).links()) == 299
    far = [np.unique(np.concatenate([base[:420], rng.integers(0, 2**63, 80, np.uint64)])) for _ in range(300)]
    assert jaccard_join.Group(far, np.arange(300), 75).links() == []


def test_one_row_of_each_component_stays(spark):
    rows = [(7, "a b c d e f", 1), (None, "a b c d e f", 2), (3, "A B c d e f", 3), (3, "A B c d e f", 4), (3, "other words here", 5), (None, "q", 6), (None, "q", 7), (1, None, 8), (1, None, 9), (2, " ", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int").withColumn("again", F.col("h")).withColumn("k", F.col("h"))
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"]) for r in kept.collect())
    assert got == sorted([("3", "A B c d e f"), ("3", "other words here"), ("None", "q"), ("1", None), ("1", None), ("2", " ")], key=str)
    assert jaccard_join.keep_one(docs.where("false")).count() == 0


def test_join_edges(spark):
    docs = spark.createDataFrame([(7, "a b c d e f"), (None, "a b c d e f"), (3, "A B c d e f"), (3, "A B c d e f"), (None, "q")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(7, 3), (None, 3), (3, 3), (3, 3), (None, None)], key=str)
    assert jaccard_join.near_duplicates(docs.where("false")).count() == 0


def test_tree_drops_no_pair():
    texts = [t for t in corpus(3, 8, 20) if t]
    own = sorted((jaccard_join.shingles(t) for t in texts), key=len)
    for address in (6, 8, 12):
        tree = jaccard_join.SignatureTree(np.array([len(x) for x in own]), np.stack([jaccard_join.bitmap(x, address) for x in own]))
        found = {(int(i), int(j)) for x in tree.leaves(75, lambda a, b: False) for i, j in zip(*x, strict=True)}
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                shared = len(np.intersect1d(own[i], own[j]))
                if jaccard_join.enough(shared, len(own[i]), len(own[j]), 75):
                    assert (i, j) in found


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (1, 900), (900, 1)]
    got = dict(connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {i: 100 for i in range(100, 161)} | {1: 1, 900: 1}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score long")


def test_search_agrees_with_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1)], 0, 1) for i in range(230)]
    rows += [(300, None, 0, 1), (301, [1.0, None] * 4, 0, 1), (302, [float("nan")] * 8, 0, 1), (303, [float("inf")] * 8, 0, 1), (None, [1.0] * 8, 0, 1), (304, [1.0] * 3, 0, 1), (400, [2.0] * 3, 0, 1)]
    table = vectors(spark, rows)
    got = sorted(tuple(r) for r in exact_topk.search(table, table["vec_id"] % 100 == 0, k=10, rows_in_block=40, queries_in_block=2).collect())
    ok = [(i, np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(int).tolist()) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in ok:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b))[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert exact_topk.search(table.where("false"), table["vec_id"] == 0).count() == 0


def test_search_with_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(11)
    rows = [(i // 2 * 2 if i < 40 else i, [float(x) for x in rng.normal(size=6).round(2)], 0, 1) for i in range(120)]
    rows += rows[:3]
    table = vectors(spark, rows)
    wide = table.select("*", *(F.lit(1).alias(c) for c in ("id", "vector", "raw", "cutoff", "is_query", "rank")))
    got = sorted(tuple(r) for r in exact_topk.search(wide, F.col("vec_id") % 20 == 0, k=5, rows_in_block=16, queries_in_block=3).collect())
    whole = [(i, np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(int)) for i, v, *_ in rows]
    want = []
    for query in {i for i, _ in whole if i % 20 == 0}:
        best = sorted((-int(a @ b), j) for i, a in whole if i == query for j, b in whole if j != query)[:5]
        want += [(query, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_large_scores_are_exact(spark):
    table = vectors(spark, [(0, [2.0e6, 1.0], 0, 1), (1, [2.0e6, 1.0], 0, 1), (2, [2.0e6, 2.0], 0, 1)])
    got = [tuple(r) for r in exact_topk.search(table, table["vec_id"] == 0).collect()]
    big = (1024 * 2000000) ** 2
    assert got == [(0, 1, 2, big + 2 * 1024**2), (0, 2, 1, big + 1024**2)]


def test_vector_links_agree_with_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        rows += [(len(rows) + k, [float(x) for x in centre + rng.normal(size=16) * rng.choice([0, 0.05, 0.12, 0.2])], c % 3, 1) for k in range(12)]
    n = len(rows)
    rows += [(n, [0.0] * 16, 0, 1), (n + 1, None, 0, 1), (n + 2, rows[0][1], None, 1), (n + 3, rows[0][1], 0, 1), (n + 4, rows[0][1][:4], 0, 1), (n + 5, [float("nan")] * 16, 0, 1)]
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_dedup.near_duplicates(vectors(spark, rows), lists=6, block=16, codewords=8).collect()}
    ok = [(i, np.array(v, np.float32).astype(float), label) for i, v, label, _ in rows if v is not None and label is not None and all(np.isfinite(x) for x in v) and any(v)]
    links, parent = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x, p) in enumerate(ok):
        for j, y, q in ok[:a]:
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[i], links[j] = links[i] + 1, links[j] + 1
                u, v = find(i), find(j)
                parent[max(u, v)] = min(u, v)
    assert got == {i: (links[i], find(i), find(i) == i) for i in links}
    assert vector_dedup.near_duplicates(vectors(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("name", ["op6_exact_topk", "op7_chat_format", "op8_source_mix", "op9_vector_dedup"])
def test_query_agrees_with_sql(spark, small, name):
    from oracle import same

    same(spark, small, registry.queries()[name], registry.oracle_sql()[name])


def test_vectors_that_repeat_ids_and_clashing_columns(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a), (1, a), (2, a), (2, a), (3, b), (4, b), (4, a), (None, a)]
    table = spark.createDataFrame([(i, v, 0, *[9] * 7) for i, v in rows], "vec_id long, embedding array<float>, label int, node int, size int, n int, list int, at int, code int, vector int")
    got = sorted({tuple(r)[:3] for r in vector_dedup.near_duplicates(table).where("vec_id is not null").collect()})
    assert got == [(1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 1, 1), (4, 2, 1)]  # 3 reaches 1 through 4
    assert vector_dedup.near_duplicates(table).count() == len(rows)
