"""Queries of graphs: lineage, closure, affected roots, replacement chains, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.operators import graphs
from verdict.operators.components import components as connected
from verdict.sources.tables import table


def _parents(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as a forest: the parent has a third of the key; some keys close cycles."""
    key = F.col("c_custkey")
    parent = F.when(key % 97 == 0, key + 1).when(key % 97 == 1, key - 1).when(key >= 3, F.floor(key / 3))
    return table(spark, folder, "customer").select(key.alias("node"), parent.cast("bigint").alias("parent"))


def lineage_recursive(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.lineage(_parents(spark, folder), "node", "parent").groupBy("node").agg(F.max("distance").alias("depth"), F.min("ancestor").alias("least"), F.count(F.lit(1)).alias("n"))


def _dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """Parts depend on parts of half and a third of their key; every 50th also on one far above, which may not exist."""
    key = F.col("p_partkey")
    targets = F.transform(F.array_compact(F.array(F.when(key > 1, F.floor(key / 2)), F.when(key > 2, F.floor(key / 3)), F.when(key % 50 == 0, key * 2))), lambda x: x.cast("bigint"))
    return table(spark, folder, "part").select(key.alias("a"), F.explode(targets).alias("b"))


def _roots(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("root"))


def closure_cycle(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "part").select(F.col("p_partkey").alias("node"))
    return graphs.closure(_dependencies(spark, folder), nodes, _roots(spark, folder))


def affected_roots(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that depend on one that came back in a large lot."""
    changed = table(spark, folder, "lineitem").where("l_returnflag = 'R' and l_quantity >= 50").select(F.col("l_partkey").alias("node"))
    return graphs.affected(_dependencies(spark, folder), changed, _roots(spark, folder))


def components(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts as aliases of each other: suppliers linked by dear lines of the same part."""
    dear = table(spark, folder, "lineitem").where("l_quantity >= 48").select("l_partkey", "l_suppkey").distinct()
    hub = dear.groupBy("l_partkey").agg(F.min("l_suppkey").alias("b"))
    edges = dear.join(hub, "l_partkey").select(F.col("l_suppkey").alias("a"), "b")
    own = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("node"))
    return own.join(connected(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def replacement_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as editions: most are replaced by the one ten keys on; some fork, some lead back."""
    editions = table(spark, folder, "orders").select(F.col("o_orderkey").alias("edition"))
    step = lambda rows, by: rows.select(F.col("edition").alias("previous"), (F.col("edition") + by).alias("next"))
    edges = step(editions.where("edition % 7 <> 0"), 10).unionByName(step(editions.where("edition % 90 = 5"), 20)).unionByName(step(editions.where("edition % 210 = 0"), -20))
    edges = edges.join(editions.select(F.col("edition").alias("next")), "next", "left_semi")
    out = graphs.replacements(editions, edges)
    return out.select("edition", F.coalesce("current", F.lit(-1)).alias("current"), "state")


QUERIES = {f.__name__: f for f in (lineage_recursive, closure_cycle, affected_roots, components, replacement_chains)}

_DEPENDS = """
e AS (
  SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1
  UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2
  UNION ALL SELECT p_partkey, p_partkey * 2 FROM part WHERE p_partkey % 50 = 0),
r AS (SELECT p_partkey AS root, p_partkey AS node FROM part UNION SELECT r.root, e.b FROM r JOIN e ON r.node = e.a)"""

SQL = {
    "lineage_recursive": """
WITH RECURSIVE p AS (
  SELECT c_custkey AS n, CASE WHEN c_custkey % 97 = 0 THEN c_custkey + 1 WHEN c_custkey % 97 = 1 THEN c_custkey - 1 WHEN c_custkey >= 3 THEN c_custkey // 3 END AS p FROM customer),
c AS (
  SELECT n AS node, n AS ancestor, p AS next, 0 AS distance, [n] AS path FROM p
  UNION ALL SELECT c.node, p.n, p.p, c.distance + 1, list_append(c.path, p.n) FROM c JOIN p ON c.next = p.n WHERE c.distance < 32 AND NOT list_contains(c.path, p.n))
SELECT node, max(distance) AS depth, min(ancestor) AS least, count(*) AS n FROM c GROUP BY node""",
    "closure_cycle": f"""
WITH RECURSIVE {_DEPENDS},
n AS (SELECT root, count(*) - 1 AS n_dependencies, count(*) FILTER (p_partkey IS NULL) AS n_missing FROM r LEFT JOIN part ON node = p_partkey GROUP BY root),
c AS (SELECT DISTINCT r.root FROM r JOIN e ON e.a = r.node AND e.b = r.root)
SELECT n.root, n_dependencies, n_missing, CASE WHEN c.root IS NOT NULL THEN 'CYCLE' WHEN n_missing > 0 THEN 'MISSING' ELSE 'COMPLETE' END AS state FROM n LEFT JOIN c ON n.root = c.root""",
    "affected_roots": f"WITH RECURSIVE {_DEPENDS} SELECT DISTINCT root FROM r WHERE node IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 50)",
    "components": """
WITH RECURSIVE d AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 48),
e AS (SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM d x JOIN d y ON x.l_partkey = y.l_partkey),
r AS (SELECT s_suppkey AS node, s_suppkey AS other FROM supplier UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a)
SELECT node, min(other) AS component FROM r GROUP BY node""",
    "replacement_chains": """
WITH RECURSIVE x AS (SELECT o_orderkey AS k FROM orders),
s AS (SELECT k AS p, k + 10 AS n FROM x WHERE k % 7 <> 0 UNION SELECT k, k + 20 FROM x WHERE k % 90 = 5 UNION SELECT k, k - 20 FROM x WHERE k % 210 = 0),
e AS (SELECT p, n FROM s WHERE n IN (SELECT k FROM x)),
o AS (SELECT p, min(n) AS n, count(*) > 1 AS fork FROM e GROUP BY p),
w AS (
  SELECT k AS edition, k AS node, 0 AS step, FALSE AS fork, FALSE AS loop, [k] AS path FROM x
  UNION ALL SELECT w.edition, CASE WHEN o.fork THEN w.node ELSE o.n END, w.step + 1, o.fork, list_contains(w.path, o.n) AND NOT o.fork, list_append(w.path, o.n)
  FROM w JOIN o ON w.node = o.p WHERE NOT w.fork AND NOT w.loop),
l AS (SELECT edition, max_by(node, step) AS node, max_by(fork, step) AS fork, max_by(loop, step) AS loop FROM w GROUP BY edition)
SELECT edition, CASE WHEN fork OR loop THEN -1 ELSE node END AS current, CASE WHEN fork THEN 'COMPETING' WHEN loop THEN 'CYCLIC' ELSE 'APPLIED' END AS state FROM l""",
}
