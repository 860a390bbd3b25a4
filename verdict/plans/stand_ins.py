"""Facts, receipts and histories over the generated tables: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.functions.facts import fact
from verdict.operators.temporal import prior_count
from verdict.plans.rules import Field
from verdict.sources.tables import table

FIELDS = {
    "Event.day": Field("date", ("date",)),
    "Event.kind": Field("string", (), ("F", "O", "P")),
    "Event.amount": Field("decimal", ("amount", "currency")),
    "Event.days": Field("integer", ("days",)),
    "Event.reduced": Field("boolean"),
    "History.count": Field("integer", ("occurrences",)),
    "Contract.start": Field("date", ("date",)),
}


def column(field: str) -> Column:
    """The fact column of a field."""
    return F.col(field.replace(".", "_").lower())


def order_facts(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each order with a fact for each field; some lack a value, are stale, disputed or not confirmed."""
    key = F.col("o_orderkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
    orders = orders.withColumn("prior", prior_count(orders, ["o_custkey"], "day"))
    user = F.lit("user")
    by_priority = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "user").when(F.col("o_orderpriority") == "3-MEDIUM", "ai_structured").when(F.col("o_orderpriority") == "5-LOW", "conflicting").otherwise("unconfirmed")
    return orders.select(
        "o_orderkey",
        "o_custkey",
        fact(F.when(key % 11 != 0, F.col("day")), user).alias("event_day"),
        fact(F.col("o_orderstatus"), by_priority, key % 13 == 0).alias("event_kind"),
        fact(F.when(key % 7 != 0, F.col("o_totalprice").cast("decimal(18,2)").cast("decimal(18,6)")), F.when(key % 5 == 0, "ai_structured").otherwise("user")).alias("event_amount"),
        fact((key % 10).cast("bigint"), user).alias("event_days"),
        fact(key % 2 == 0, F.when(key % 3 == 0, "ai_structured").otherwise("user")).alias("event_reduced"),
        fact(F.col("prior"), user).alias("history_count"),
        fact(F.lit("1996-01-01").cast("date"), user).alias("contract_start"),
    )


FACTS_SQL = """
base AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate::DATE AS real_day,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS day,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice::DECIMAL(18,2) END AS amount,
         CASE WHEN o_orderkey % 13 = 0 THEN 'stale'
              WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'ok'
              WHEN o_orderpriority = '5-LOW' THEN 'conflicting' ELSE 'unconfirmed' END AS kind_state,
         nullif(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE
                               RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS prior
  FROM orders),
leaves AS (
  SELECT *, CASE WHEN kind_state = 'ok' THEN o_orderstatus = 'F' END AS is_f,
         CASE WHEN kind_state = 'ok' THEN o_orderstatus IN ('F', 'P') END AS is_fp,
         CASE WHEN kind_state = 'ok' THEN o_orderstatus = 'O' END AS is_o,
         amount BETWEEN 1000 AND 150000 AS in_amount,
         day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AS in_days,
         (day - DATE '1996-01-01') >= 365 AS since,
         prior >= 3 AS often
  FROM base)"""


def receipt_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A line of a receipt for each line item: the flag is the category, the status the confirmation."""
    flag = F.col("l_returnflag")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.when(F.col("l_partkey") % 50 == 0, "USD").otherwise("EUR").alias("currency"),
        F.when(flag == "N", "covered").when(flag == "A", "possible_excluded").otherwise("excluded").alias("category"),
        F.when(F.col("l_linestatus") == "F", "user").otherwise("unconfirmed").alias("confirmation"),
    )


LINES_SQL = """
lines AS (
  SELECT l_orderkey, l_partkey, l_extendedprice::DECIMAL(18,2) AS amount,
         CASE WHEN l_partkey % 50 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
         CASE l_returnflag WHEN 'N' THEN 'covered' WHEN 'A' THEN 'possible_excluded' ELSE 'excluded' END AS category,
         CASE l_linestatus WHEN 'F' THEN 'user' ELSE 'unconfirmed' END AS confirmation
  FROM lineitem)"""
