"""Connected components and reachability by DataFrame fixpoints."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.functions.checkpoints import checkpoint


#: Rounds of a fixpoint whose parts stay apart.
PARTS = 16


def _mark(df: DataFrame, *columns: str) -> tuple:
    """What tells two row sets apart, whatever their order."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) is connected to.

    Large-star and small-star steps in turn, each checkpointed, until the edges no longer change.
    """
    edges = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    before = None
    while (mark := _mark(edges, "a", "b")) != before and mark[0]:
        before = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def reachable(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(root, node): everything that edges (a, b) lead to from each start node (root), the root itself included.

    A fixpoint with distinct rows, so cycles end; each round only follows what the last one found. It goes on until a round finds
    nothing; with `most`, a longer way is an error.
    """
    return _fixpoint(edges, start.select("root", F.col("root").alias("node")).distinct(), most)


def _fixpoint(edges: DataFrame, start: DataFrame, most: int | None, spread: bool = False) -> DataFrame:
    """With `spread`, what a round finds is never broadcast: rounds over one root are many, and the driver would get each of them."""
    apart = (lambda df: df.hint("merge")) if spread else (lambda df: df)
    found = checkpoint(start)
    fresh = found
    for n in count(1) if most is None else range(1, most + 1):
        reached = apart(fresh).join(edges.select(F.col("a").alias("node"), F.col("b").alias("_to")), "node").select("root", F.col("_to").alias("node")).distinct()
        fresh = checkpoint(apart(reached).join(found, ["root", "node"], "left_anti"))
        if fresh.isEmpty():
            return found
        # What each round finds is kept as a part of its own, not written again with all before; only long chains are put together.
        found = found.unionByName(fresh)
        if n % PARTS == 0:
            found = checkpoint(found)
    raise RuntimeError("REACHABILITY_LIMIT")


def reached(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(node): the start nodes (node) and everything that edges (a, b) lead to from any of them; each node once."""
    one = start.select(F.lit(0).alias("root"), "node").distinct()
    return _fixpoint(edges, one, most, spread=True).select("node")


def led_to(edges: DataFrame) -> DataFrame:
    """(graph, root, node): everything that one or more edges (graph, a, b) lead to from each node; a node of a cycle leads to itself.

    By doubling: `ways` are those of exactly 2**n edges, `found` those of up to as many. The rounds are the logarithm of the longest way.
    A round that finds nothing has found all.
    """
    found = checkpoint(edges.select("graph", F.col("a").alias("root"), F.col("b").alias("node")).distinct())
    ways = found
    while True:
        by_middle = ways.select("graph", "root", F.col("node").alias("_m"))
        onward = lambda df: by_middle.join(df.select("graph", F.col("root").alias("_m"), "node"), ["graph", "_m"]).select("graph", "root", "node").distinct()  # noqa: B023, E731
        fresh = checkpoint(onward(found).join(found, ["graph", "root", "node"], "left_anti"))
        if fresh.isEmpty():
            return found
        ways, found = checkpoint(onward(ways)), found.unionByName(fresh)
