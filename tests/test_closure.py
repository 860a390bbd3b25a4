"""Closure: against brute force, and ways followed one by one only between nodes of cycles."""

import random

from verdict.operators import graphs


def _brute(edges, nodes, roots):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = []
    for root in roots:
        seen, todo = {root}, [root]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        missing = sum(x not in nodes for x in seen)
        cycle = any(root in after.get(x, ()) for x in seen)
        out.append((root, len(seen) - 1, missing, "CYCLE" if cycle else "MISSING" if missing else "COMPLETE"))
    return sorted(out)


def test_sets_are_built_upwards(spark, monkeypatch):
    starts = []
    monkeypatch.setattr(graphs, "reachable", lambda edges, start, most=None, whole=graphs.reachable: starts.append(start.count()) or whole(edges, start, most))
    for seed, (n, m) in enumerate(((12, 14), (30, 28), (25, 0))):
        draw = random.Random(seed)
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]
        edges += [*edges[:3], *((i, i // 2) for i in range(40, 60)), (200, 40), (7, 300)]
        nodes, roots = set(range(n)) | set(range(20, 60, 3)), [*range(64), 200, 300, 500]
        out = graphs.closure(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(x,) for x in nodes], "node long"), spark.createDataFrame([(x,) for x in roots], "root long"))
        assert sorted(map(tuple, out.collect())) == _brute(edges, nodes, roots)
    # Edges without cycles need no such ways at all, others only from nodes on cycles or between them, not from each root.
    assert len(starts) <= 2 and all(s <= 30 for s in starts)
