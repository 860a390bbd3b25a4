"""Lineage, dependency closure and replacement chains over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdict.functions.checkpoints import checkpoint, written
from verdict.operators.components import reachable, reached

DEPTH = 32


def lineage(nodes: DataFrame, node: str, parent: str, depth: int = DEPTH) -> DataFrame:
    """(node, ancestor, distance) of every node, itself at 0, up to `depth`; a cycle ends where it closes.

    One join for each level, of the chains that still go on; a chain carries the nodes that it has passed.
    """
    up = checkpoint(nodes.select(F.col(node).alias("ancestor"), F.col(parent).alias("next")))
    chains = up.select(F.col("ancestor").alias("node"), "ancestor", "next", F.lit(0).alias("distance"), F.array("ancestor").alias("path"))
    found = chains.select("node", "ancestor", "distance")
    for distance in range(1, depth + 1):
        ahead = chains.select("node", F.col("next").alias("ancestor"), "path").where("ancestor is not null and not array_contains(path, ancestor)")
        moved = ahead.join(up, "ancestor")
        chains = checkpoint(moved.select("node", "ancestor", "next", F.lit(distance).alias("distance"), F.array_append("path", F.col("ancestor")).alias("path")))
        if chains.isEmpty():
            break
        found = found.unionByName(chains.select("node", "ancestor", "distance"))
    return found


def closure(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """For each root how many nodes it depends on, at any distance, and its problems: MISSING targets and CYCLE through it.

    edges: (a, b), a depends on b; nodes: those that exist; roots: column root. With `depth`, a longer way is an error. Without, what each
    node of the edges depends on is built once (`dependencies`), from the ends of ways upwards.
    """
    known = nodes.select(F.col("node"), F.lit(1).alias("_known"))
    if depth is None:
        counted, cyclic = dependencies(edges, nodes)
        own = roots.select("root").distinct().join(known.distinct().withColumnRenamed("node", "root"), "root", "left")
        counted = own.join(counted.withColumnRenamed("node", "root"), "root", "left")
        none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        counted = counted.select("root", none("n_dependencies").alias("n_dependencies"), (none("n_missing") + F.col("_known").isNull().cast("long")).alias("n_missing"))
        cyclic = cyclic.select(F.col("node").alias("root"), F.lit(True).alias("_cycle"))
    else:
        within = reachable(edges, roots, depth)
        counted = within.join(known, "node", "left").groupBy("root").agg((F.count(F.lit(1)) - 1).alias("n_dependencies"), F.count_if(F.col("_known").isNull()).alias("n_missing"))
        back = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        cyclic = within.join(back, ["root", "node"], "left_semi").select("root").distinct().withColumn("_cycle", F.lit(True))
    out = counted.join(cyclic, "root", "left")
    state = F.when(F.coalesce("_cycle", F.lit(False)), "CYCLE").when(F.col("n_missing") > 0, "MISSING").otherwise("COMPLETE")
    return out.select("root", "n_dependencies", "n_missing", state.alias("state"))


def dependencies(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n_dependencies, n_missing) of every node that edges (a, b) lead on from, itself left out; (node) of those on a cycle.

    A node takes what its targets depend on as soon as all of them are known, so each set is made once and goes up each edge once. What is
    left then are cycles and nodes above them: nodes that no other of these leads to are put off, the rest (on cycles or between
    them) gets its ways by a fixpoint, and the nodes above follow. A node's set is one row.
    """
    edges = edges.select("a", "b").where("a is not null").distinct()
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    known = nodes.select(F.col("node").alias("b"), F.lit(False).alias("_gone")).distinct()
    edges = written(edges.join(degree, "a").join(known, "b", "left").select("a", "b", "degree", F.coalesce("_gone", F.lit(True)).alias("gone")))
    one = lambda c: F.array(c)
    none = F.array().cast(f"array<{edges.schema['b'].dataType.simpleString()}>")

    def sets(rows: DataFrame, by: list[str], *more) -> DataFrame:
        united = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        return rows.groupBy(*by).agg(*more, united("members"), united("gone"))

    def lifted(known: DataFrame) -> DataFrame:
        """What the nodes (node, members, gone) give to each that depends on them."""
        rows = edges.withColumnRenamed("gone", "_gone").join(known.withColumnRenamed("node", "b"), "b")
        return rows.select("a", "degree", F.lit(1).cast("long").alias("n"), F.array_append("members", F.col("b")).alias("members"), F.when(F.col("_gone"), F.array_append("gone", F.col("b"))).otherwise(F.col("gone")).alias("gone"))

    def settle(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
        """The nodes that can be known, round by round, and what is held for those that can't."""
        parts = []
        while True:
            held = written(sets(rows, ["a", "degree"], F.sum("n").alias("n")))
            ready = held.where("n = degree").select(F.col("a").alias("node"), "members", "gone")
            waiting = held.where("n < degree")
            if ready.isEmpty():
                return parts, waiting
            parts.append(ready)
            rows = lifted(ready).unionByName(waiting)

    ends = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
    first = ends.select("a", "degree", F.lit(1).cast("long").alias("n"), one("b").alias("members"), F.when(F.col("gone"), one("b")).otherwise(none).alias("gone"))
    parts, waiting = settle(first)
    open_ = reduce(lambda left, part: left.join(part.select(F.col("node").alias("a")), "a", "left_anti"), [reduce(DataFrame.unionByName, parts)] if parts else [], edges)
    core = checkpoint(open_.join(open_.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
    size = core.count()
    while size:
        core = checkpoint(core.join(core.select(F.col("b").alias("a")).distinct(), "a", "left_semi"))
        before, size = size, core.count()
        if size == before:
            break
    cyclic = core.select(F.col("a").alias("node")).limit(0)
    if size:
        inside = core.select(F.col("a").alias("root")).distinct()
        ways = reachable(core, inside)
        back = core.select(F.col("a").alias("node"), F.col("b").alias("root"))
        cyclic = checkpoint(ways.join(back, ["root", "node"], "left_semi").select(F.col("root").alias("node")).distinct())
        exist = nodes.select(F.col("node"), F.lit(True).alias("_known")).distinct()
        held = waiting.select(F.col("a").alias("node"), "members", "gone")
        own = inside.withColumnRenamed("root", "node").join(held, "node", "left").join(exist, "node", "left")
        empty = lambda c: F.coalesce(c, none)
        own = own.select("node", F.array_append(empty("members"), F.col("node")).alias("members"), F.when(F.col("_known").isNull(), F.array_append(empty("gone"), F.col("node"))).otherwise(empty("gone")).alias("gone"))
        met = sets(ways.join(own, "node"), ["root"])
        met = written(met.select(F.col("root").alias("node"), *(F.array_remove(c, F.col("root")).alias(c) for c in ("members", "gone"))))
        above, _ = settle(lifted(met).unionByName(waiting).join(inside.withColumnRenamed("root", "a"), "a", "left_anti"))
        parts += [met, *above]
    counts = [p.select("node", F.size("members").alias("n_dependencies"), F.size("gone").alias("n_missing")) for p in parts]
    return reduce(DataFrame.unionByName, counts), cyclic


def affected(edges: DataFrame, changed: DataFrame, roots: DataFrame) -> DataFrame:
    """The roots that depend, at any distance, on a changed node: (root)."""
    up = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    hit = reached(up, changed.select("node")).select(F.col("node").alias("root"))
    return roots.join(hit.hint("merge"), "root", "left_semi")


def replacements(editions: DataFrame, replaced: DataFrame) -> DataFrame:
    """(edition, current, state) of each edition (column edition) under edges (previous, next).

    APPLIED: one chain leads to `current`. COMPETING: an edition on the way has two successors. CYCLIC: the way comes
    back. Both taint every edition whose way leads there, and `current` is null then.
    """
    edges = replaced.select("previous", "next").distinct()
    fork = edges.groupBy("previous").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("previous").alias("node"), F.lit(True).alias("_fork"))
    one = edges.groupBy("previous").agg(F.min("next").alias("to"))
    # Pointer doubling: after r rounds each edition points 2**r steps ahead, or to where its way ends. A round moves only those whose way
    # still goes on; one that brings none to an end leaves ways that all come back.
    way = editions.join(one.withColumnRenamed("previous", "edition"), "edition", "left").join(fork.withColumnRenamed("node", "edition"), "edition", "left")
    forked = F.coalesce("_fork", F.lit(False))
    way = checkpoint(way.select("edition", F.when(~forked, F.col("to")).alias("to"), forked.alias("competing")))
    moving, settled = way.where("to is not null"), way.where("to is null")
    while True:
        ahead = settled.withColumn("_goes_on", F.lit(False)).unionByName(moving.withColumn("_goes_on", F.lit(True)))
        moved = moving.join(ahead.select(F.col("edition").alias("to"), F.col("to").alias("_far"), F.col("competing").alias("_competing"), "_goes_on"), "to", "left")
        moved = checkpoint(moved.select("edition", F.coalesce("_far", "to").alias("to"), (F.col("competing") | F.coalesce("_competing", F.lit(False))).alias("competing"), F.coalesce("_goes_on", F.lit(False)).alias("_moving")))
        ended, moving = moved.where("not _moving").drop("_moving"), moved.where("_moving").drop("_moving")
        if ended.isEmpty():
            break
        settled = settled.unionByName(ended)
    way = settled.unionByName(moving)
    ends = one.select(F.col("previous").alias("to"), F.lit(True).alias("_goes_on"))
    done = way.join(ends, "to", "left").select("edition", F.coalesce("to", "edition").alias("node"), "competing", (F.col("to").isNull() | F.col("_goes_on").isNull()).alias("done"))
    state = F.when(F.col("competing"), "COMPETING").when(~F.col("done"), "CYCLIC").otherwise("APPLIED")
    return done.select("edition", F.when(state == "APPLIED", F.col("node")).alias("current"), state.alias("state"))


def layers(edges: DataFrame) -> DataFrame:
    """(graph, node, layer, rank) of every node of the edges (graph, a, b): graphs peeled from those without edges into them.

    A node's layer is the longest way to it; rank orders the nodes of a layer by their last predecessor's rank, then by node. Nodes on
    a cycle or behind one have neither. One round for each layer, over the nodes that are left and the edges out of the last layer.
    """
    edges = checkpoint(edges.select("graph", "a", "b").distinct())
    into = edges.groupBy("graph", F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("left"))
    nodes = edges.select("graph", F.col("a").alias("node")).unionByName(into.select("graph", "node")).distinct()
    left = checkpoint(into)
    by_node = Window.partitionBy("graph").orderBy("node")
    last = nodes.join(into, ["graph", "node"], "left_anti").select("graph", "node", F.lit(0).alias("layer"), F.row_number().over(by_node).alias("rank"))
    found, layer = checkpoint(last), 0
    last = found
    while not last.isEmpty() and not left.isEmpty():
        layer += 1
        met = edges.join(last.withColumnRenamed("node", "a"), ["graph", "a"]).groupBy("graph", F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.max("rank").alias("_last"))
        left = checkpoint(left.join(met, ["graph", "node"], "left").select("graph", "node", (F.col("left") - F.coalesce("_n", F.lit(0))).alias("left"), "_last"))
        ready = Window.partitionBy("graph").orderBy("_last", "node")
        last = checkpoint(left.where("left = 0").select("graph", "node", F.lit(layer).alias("layer"), F.row_number().over(ready).alias("rank")))
        left = left.where("left > 0").select("graph", "node", "left")
        found = found.unionByName(last)
    return found.unionByName(left.select("graph", "node", F.lit(None).cast("int").alias("layer"), F.lit(None).cast("int").alias("rank")))
