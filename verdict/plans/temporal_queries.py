"""Queries of histories, intervals, versions and plain relational work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdict.operators import temporal
from verdict.sources.tables import table


def status_asof_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's status at the end of four days; the history has the grain of a day, so ties occur."""
    history = table(spark, folder, "events").select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at"), "event_type")
    days = F.array(*(F.lit(d).cast("date") for d in ("2023-12-31", "2024-01-05", "2024-01-15")), F.lit(None).cast("date"))
    probes = history.select("user_id").distinct().select("user_id", F.explode(days).alias("day"))
    out = temporal.status_as_of(probes, history, ["user_id"], "day", "at", "event_type", F.lit("current"))
    return out.select("user_id", F.col("day").cast("string").alias("day"), "as_of")


def interval_open_ended(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by customers whose terms held on the day; terms without an end are open."""
    key = F.col("c_custkey")
    day = lambda text: F.lit(text).cast("date")
    terms = table(spark, folder, "customer").select("c_custkey", F.when(key % 3 != 0, day("1996-01-01")).alias("start"), F.when(key % 4 != 0, day("1999-12-31")).alias("stop"))
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("day"))
    out = orders.join(terms, "c_custkey")
    return out.groupBy("c_custkey").agg(F.count_if(temporal.within(F.col("day"), F.col("start"), F.col("stop"))).alias("n_within"), F.count(F.lit(1)).alias("n"))


def scope_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Orders under changes for a status, a priority, both or neither; the most specific one in force counts."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
    rows = [(None, None, "1995-01-01", "1997-12-31", "base"), ("F", None, "1996-01-01", None, "f"), (None, "1-URGENT", None, "1999-12-31", "urgent"), ("F", "1-URGENT", "1997-01-01", "1998-12-31", "both"), ("P", None, "1996-01-01", None, "p1"), ("P", None, "1998-01-01", None, "p2")]
    changes = spark.createDataFrame(rows, "o_orderstatus string, o_orderpriority string, start string, stop string, choice string")
    changes = changes.withColumn("start", F.col("start").cast("date")).withColumn("stop", F.col("stop").cast("date"))
    out = temporal.overlay(orders, changes, ["o_orderstatus", "o_orderpriority"], "day", "start", "stop", "choice")
    return out.select("o_orderkey", "choice", F.coalesce("specificity", F.lit(-1)).alias("specificity"), "state")


def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").cast("string").alias("day"))
    return temporal.latest(orders, ["o_custkey"], [F.col("day").desc(), F.col("o_orderkey").desc()])


def prior_history_count(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return orders.select("o_orderkey", temporal.prior_count(orders, ["o_custkey"], "day").cast("double").alias("n_prior"))


def keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.keyset_page(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 500, 25)


def semi_anti_joins(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with orders but no open one, by exists and not exists."""
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return customers.join(orders, "c_custkey", "left_semi").join(orders.where("o_orderstatus = 'O'"), "c_custkey", "left_anti")


def top_per_group(spark: SparkSession, folder: str) -> DataFrame:
    """The two dearest lines of each supplier and flag, and how many there are."""
    by = Window.partitionBy("l_suppkey", "l_returnflag")
    place = F.row_number().over(by.orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"))
    lines = table(spark, folder, "lineitem").withColumn("place", place).withColumn("n", F.count(F.lit(1)).over(by))
    return lines.where("place <= 2").select("l_suppkey", "l_returnflag", "place", "l_extendedprice", "n")


def filtered_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("l_quantity") > 25).alias("n_large"),
        F.count_distinct("l_suppkey").alias("n_suppliers"),
        F.bool_and(F.col("l_discount") <= 0.1).alias("all_small"),
        F.bool_or(F.col("l_tax") > 0.07).alias("some_taxed"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"),
    )
    return lines.where("n > 10")


def ordered_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's statuses, distinct and in order, and the status of the first order."""
    orders = table(spark, folder, "orders")
    return orders.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.min_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("first_status"))


def set_refinement_except(spark: SparkSession, folder: str) -> DataFrame:
    """Which suppliers differ between two sets of lines, in either direction."""
    lines = table(spark, folder, "lineitem")
    a, b = lines.where("l_quantity > 49").select("l_suppkey", "l_partkey"), lines.where("l_discount > 0.09").select("l_suppkey", "l_partkey")
    one, two = a.exceptAll(b).distinct().subtract(b.distinct()), b.subtract(a)
    return one.withColumn("side", F.lit("first")).unionByName(two.withColumn("side", F.lit("second"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def union_of_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals over several tables in one union, summed by day."""
    orders = table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    lines = table(spark, folder, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"))
    counts = orders.groupBy("day").agg(F.count(F.lit(1)).alias("n")).unionByName(lines.groupBy("day").agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy(F.col("day").cast("string").alias("day")).agg(F.sum("n").alias("n"))


def unique_match_join(spark: SparkSession, folder: str) -> DataFrame:
    """Parts whose name, type and brand lead to exactly one other part key of the same size."""
    part = table(spark, folder, "part").select("p_partkey", "p_size", F.replace("p_name", F.lit(" "), F.lit("")).alias("name"), "p_type")
    groups = part.groupBy("name", "p_type", "p_size").agg(F.count_distinct("p_partkey").alias("n"), F.min("p_partkey").alias("only"))
    return groups.where("n = 1").select("name", "p_type", "p_size", "only")


def flagship_join(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue by nation and year over six tables."""
    t = lambda n: table(spark, folder, n)
    revenue = (F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))).cast("decimal(24,4)")
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name", F.year("o_orderdate").alias("year")).agg(F.sum(revenue).cast("double").alias("revenue"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (status_asof_ties, interval_open_ended, scope_overlay, latest_version, prior_history_count, keyset_page, semi_anti_joins, top_per_group, filtered_aggregates, ordered_lists, set_refinement_except, union_of_counts, unique_match_join, flagship_join)}

SQL = {
    "status_asof_ties": """
WITH h AS (SELECT user_id, date_trunc('day', ts)::DATE AS at, event_type FROM events),
p AS (SELECT user_id, unnest([DATE '2023-12-31', DATE '2024-01-05', DATE '2024-01-15', NULL]) AS day FROM (SELECT DISTINCT user_id FROM events)),
l AS (SELECT p.user_id, p.day, max(h.at) AS at FROM p JOIN h ON p.user_id = h.user_id AND h.at <= p.day GROUP BY 1, 2),
s AS (SELECT l.user_id, l.day, count(DISTINCT event_type) AS n, min(event_type) AS one FROM l JOIN h ON l.user_id = h.user_id AND l.at = h.at GROUP BY 1, 2)
SELECT p.user_id, p.day::VARCHAR AS day, CASE WHEN p.day IS NULL THEN 'current' WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'conflicting' ELSE one END AS as_of
FROM p LEFT JOIN s ON p.user_id = s.user_id AND p.day = s.day""",
    "interval_open_ended": """
SELECT c_custkey, count(*) FILTER ((c_custkey % 3 = 0 OR o_orderdate::DATE >= DATE '1996-01-01') AND (c_custkey % 4 = 0 OR o_orderdate::DATE <= DATE '1999-12-31')) AS n_within, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey""",
    "scope_overlay": """
WITH c(status, priority, start, stop, choice) AS (VALUES
  (NULL, NULL, DATE '1995-01-01', DATE '1997-12-31', 'base'), ('F', NULL, DATE '1996-01-01', NULL, 'f'), (NULL, '1-URGENT', NULL, DATE '1999-12-31', 'urgent'),
  ('F', '1-URGENT', DATE '1997-01-01', DATE '1998-12-31', 'both'), ('P', NULL, DATE '1996-01-01', NULL, 'p1'), ('P', NULL, DATE '1998-01-01', NULL, 'p2')),
m AS (
  SELECT o_orderkey, choice, (status IS NOT NULL)::INT + (priority IS NOT NULL)::INT AS depth
  FROM orders JOIN c ON coalesce(status = o_orderstatus, TRUE) AND coalesce(priority = o_orderpriority, TRUE)
    AND coalesce(start <= o_orderdate::DATE, TRUE) AND coalesce(o_orderdate::DATE <= stop, TRUE)),
t AS (SELECT *, max(depth) OVER (PARTITION BY o_orderkey) AS top FROM m),
g AS (SELECT o_orderkey, top, count(DISTINCT choice) AS n, min(choice) AS one FROM t WHERE depth = top GROUP BY 1, 2)
SELECT o.o_orderkey, CASE WHEN n = 1 THEN one END AS choice, coalesce(top, -1)::INTEGER AS specificity,
  CASE WHEN n IS NULL THEN 'NONE' WHEN n > 1 THEN 'COMPETING' ELSE 'APPLIED' END AS state
FROM orders o LEFT JOIN g ON o.o_orderkey = g.o_orderkey""",
    "latest_version": """
SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus, o_orderdate::DATE::VARCHAR AS day FROM orders
ORDER BY o_custkey, o_orderdate::DATE DESC, o_orderkey DESC""",
    "prior_history_count": """
SELECT o_orderkey, nullif(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 0)::DOUBLE AS n_prior FROM orders""",
    "keyset_page": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 26",
    "semi_anti_joins": """
SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')""",
    "top_per_group": """
SELECT l_suppkey, l_returnflag, (row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey))::INTEGER AS place,
  l_extendedprice, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS n FROM lineitem QUALIFY place <= 2""",
    "filtered_aggregates": """
SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_quantity > 25) AS n_large, count(DISTINCT l_suppkey) AS n_suppliers,
  bool_and(l_discount <= 0.1::DOUBLE) AS all_small, bool_or(l_tax > 0.07::DOUBLE) AS some_taxed, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10""",
    "ordered_lists": """
SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, (array_agg(o_orderstatus ORDER BY o_orderdate, o_orderkey))[1] AS first_status
FROM orders GROUP BY o_custkey""",
    "set_refinement_except": """
WITH a AS (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 49), b AS (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_discount > 0.09::DOUBLE)
SELECT 'first' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) HAVING count(*) > 0
UNION ALL SELECT 'second', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) HAVING count(*) > 0""",
    "union_of_counts": """
SELECT day::VARCHAR AS day, sum(n)::BIGINT AS n FROM (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1
  UNION ALL SELECT l_shipdate::DATE, count(*) FROM lineitem GROUP BY 1) GROUP BY 1""",
    "unique_match_join": """
SELECT replace(p_name, ' ', '') AS name, p_type, p_size, min(p_partkey) AS only FROM part GROUP BY 1, 2, 3 HAVING count(DISTINCT p_partkey) = 1""",
    "flagship_join": """
SELECT r_name, n_name, year(o_orderdate)::INTEGER AS year, sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)))::DOUBLE AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY 1, 2, 3""",
}
