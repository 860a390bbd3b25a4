"""Queries of receipts, calculations and payouts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.functions.money import rounded, wire_decimal
from verdict.operators import payments
from verdict.plans.calculations import compile_calculation
from verdict.plans.rules import validate_calculation
from verdict.plans.stand_ins import FIELDS, LINES_SQL, column, order_facts, receipt_lines
from verdict.sources.tables import table

DEDUCTIBLE, RATE, LIMIT = Decimal("10000"), Decimal("0.8"), Decimal("100000")


def receipt_split(spark: SparkSession, folder: str) -> DataFrame:
    return payments.receipt_split(receipt_lines(spark, folder), ["l_orderkey"])


def indemnity_per_order(spark: SparkSession, folder: str) -> DataFrame:
    split = receipt_split(spark, folder)
    out = payments.indemnity(split, DEDUCTIBLE, RATE, LIMIT)
    return out.select("l_orderkey", "status", *(F.col(c).cast("double").alias(c) for c in ("confirmed", "additional", "amount")))


def fixed_rounding_modes(spark: SparkSession, folder: str) -> DataFrame:
    value = (F.col("l_extendedprice").cast("decimal(18,2)") * F.lit(Decimal("0.125"))).cast("decimal(18,6)")
    signed = F.when(F.col("l_linenumber") % 2 == 0, -value).otherwise(value).cast("decimal(18,6)")
    modes = [("half_up", "away"), ("half_even", "away"), ("up", "away"), ("up", "ceiling"), ("down", "away")]
    sums = [F.sum(rounded(signed, m, 0, up)).cast("double").alias(f"{m}_{up}") for m, up in modes]
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(*sums, F.sum(rounded(signed, "half_up", 2)).cast("double").alias("cents"))


DAILY = {"op": "multiply", "args": ["100", {"op": "max", "args": [{"op": "subtract", "args": ["Event.days", "2"]}, "0"]}]}
REDUCED = {"op": "round", "rounding": "up", "args": [{"op": "if", "args": ["Event.reduced", {"op": "multiply", "args": ["Event.amount", "0.5"]}, "Event.amount"]}]}


def calculation_runtimes(spark: SparkSession, folder: str) -> DataFrame:
    """The daily amount where a difference on the way may be negative or not, and a reduction on a confirmed flag."""
    validate_calculation(DAILY, FIELDS)
    validate_calculation(REDUCED, FIELDS, "Event.reduced")
    columns = ["o_orderkey"]
    for name, node, runtime in (("daily_operational", DAILY, "operational"), ("daily_guidance", DAILY, "guidance"), ("reduced", REDUCED, "knowledge")):
        x = compile_calculation(node, FIELDS, runtime, column)
        columns += [x.value.cast("double").alias(name), x.error.alias(f"{name}_error")]
    return order_facts(spark, folder).select(*columns)


def multi_indemnity(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("l_partkey") % 3 == 0, "indemnity").otherwise("fixed")
    result = F.when(F.col("l_returnflag") == "R", "NO_MATCH").when(F.col("l_returnflag") == "A", "UNKNOWN").otherwise("MATCH")
    return payments.several_indemnities(table(spark, folder, "lineitem").select("l_orderkey", kind.alias("kind"), result.alias("result")), ["l_orderkey"])


def subtotal_by_currency(spark: SparkSession, folder: str) -> DataFrame:
    lines = receipt_lines(spark, folder).withColumn("amount", F.when(F.col("category") == "covered", F.col("amount")))
    out = payments.subtotals(lines.withColumn("supplier", F.col("l_orderkey") % 100), ["supplier"])
    return out.withColumn("subtotal", F.col("subtotal").cast("double"))


def _expenses(spark: SparkSession, folder: str) -> DataFrame:
    return receipt_lines(spark, folder).withColumn("amount", F.when(F.col("l_partkey") % 11 != 0, F.col("amount")))


def expense_buckets(spark: SparkSession, folder: str) -> DataFrame:
    out = payments.expense_buckets(_expenses(spark, folder), ["l_orderkey"])
    return out.select("l_orderkey", "currency", "bucket", "n", "n_known", F.col("known_cost").cast("double").alias("known_cost"), F.col("total_cost").cast("double").alias("total_cost"))


def covered_cost(spark: SparkSession, folder: str) -> DataFrame:
    out = payments.covered_cost(payments.expense_buckets(_expenses(spark, folder), ["l_orderkey"]), ["l_orderkey"])
    return out.select("l_orderkey", F.col("covered_cost").cast("double").alias("covered_cost"), "partial")


def case_range(spark: SparkSession, folder: str) -> DataFrame:
    cases = _expenses(spark, folder).withColumn("exclusive", F.col("l_orderkey") % 5 != 0)
    out = payments.case_range(cases, ["l_orderkey"])
    return out.select("l_orderkey", "state", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "n_cases")


def case_relation(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers' lines of an order as alternatives that each allow some sizes."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    return payments.exclusive(lines.where("q is not null"), "l_orderkey", "l_suppkey", "q")


def unit_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Table amounts in their units; amounts with too many decimals have none."""
    unit = F.when(F.col("p_size") % 3 == 0, "thousand").when(F.col("p_size") % 3 == 1, "ten_thousand").otherwise("one")
    amount = (F.col("p_retailprice").cast("decimal(18,2)") / F.when(F.col("p_partkey") % 4 == 0, 8).otherwise(1)).cast("decimal(18,6)")
    return table(spark, folder, "part").select("p_partkey", payments.unit_amount(amount, unit).cast("double").alias("amount"))


def wire_decimals(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts sent as text; signs, exponents and too many decimals are refused."""
    price, key = F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.col("p_partkey")
    text = F.when(key % 5 == 0, F.concat(F.lit("-"), price)).when(key % 5 == 1, F.concat(price, F.lit("00000"))).when(key % 5 == 2, F.concat(price, F.lit("e2"))).otherwise(price)
    return table(spark, folder, "part").select("p_partkey", wire_decimal(text).cast("double").alias("amount"))


QUERIES = {f.__name__: f for f in (receipt_split, indemnity_per_order, fixed_rounding_modes, calculation_runtimes, multi_indemnity, subtotal_by_currency, expense_buckets, covered_cost, case_range, case_relation, unit_amounts, wire_decimals)}

_SPLIT = f"""{LINES_SQL},
split AS (
  SELECT l_orderkey, count(DISTINCT currency) > 1 AS mixed, min(currency) AS currency,
    coalesce(sum(amount) FILTER (category = 'covered' AND confirmation = 'user'), 0)::DECIMAL(18,2) AS confirmed,
    coalesce(sum(amount) FILTER (category <> 'excluded' AND NOT (category = 'covered' AND confirmation = 'user')), 0)::DECIMAL(18,2) AS additional,
    coalesce(sum(amount) FILTER (category = 'excluded'), 0)::DECIMAL(18,2) AS excluded
  FROM lines GROUP BY l_orderkey)"""
_BUCKETS = f"""{LINES_SQL},
costs AS (
  SELECT l_orderkey, currency, CASE WHEN l_partkey % 11 <> 0 THEN amount END AS amount,
    CASE WHEN confirmation <> 'user' THEN 'UNCONFIRMED' WHEN category = 'covered' THEN 'COVERED' WHEN category = 'excluded' THEN 'EXCLUDED' ELSE 'COVERAGE_REVIEW' END AS bucket
  FROM lines),
buckets AS (
  SELECT l_orderkey, currency, bucket, count(*) AS n, count(amount) AS n_known, coalesce(sum(amount), 0)::DOUBLE AS known_cost,
    CASE WHEN count(*) = count(amount) THEN sum(amount)::DOUBLE END AS total_cost
  FROM costs GROUP BY l_orderkey, currency, bucket)"""

SQL = {
    "receipt_split": f"""WITH {_SPLIT}
SELECT l_orderkey, CASE WHEN NOT mixed THEN currency END AS currency, CASE WHEN NOT mixed THEN confirmed END AS confirmed,
  CASE WHEN NOT mixed THEN additional END AS additional, CASE WHEN NOT mixed THEN excluded END AS excluded,
  CASE WHEN mixed THEN 'CURRENCY_MISMATCH' END AS error FROM split""",
    "indemnity_per_order": f"""WITH {_SPLIT}
SELECT l_orderkey, CASE WHEN mixed THEN 'unknown' WHEN additional > 0 THEN 'partial' ELSE 'computed' END AS status,
  CASE WHEN NOT mixed THEN confirmed::DOUBLE END AS confirmed, CASE WHEN NOT mixed THEN additional::DOUBLE END AS additional,
  CASE WHEN NOT mixed THEN round(least(greatest(confirmed - 10000, 0)::DECIMAL(18,2) * 0.8::DECIMAL(9,6), 100000))::DOUBLE END AS amount FROM split""",
    "fixed_rounding_modes": """
WITH x AS (SELECT l_suppkey, (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * (l_extendedprice::DECIMAL(18,2) * 0.125::DECIMAL(4,3)))::DECIMAL(18,6) AS v FROM lineitem)
SELECT l_suppkey, sum(round(v))::DOUBLE AS half_up_away, sum(round_even(v::DOUBLE, 0))::DOUBLE AS half_even_away,
  sum(sign(v) * ceil(abs(v)))::DOUBLE AS up_away, sum(ceil(v))::DOUBLE AS up_ceiling, sum(trunc(v))::DOUBLE AS down_away, sum(round(v, 2))::DOUBLE AS cents
FROM x GROUP BY l_suppkey""",
    "calculation_runtimes": """
WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice::DECIMAL(18,2) END AS amount FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 10 >= 2 THEN 100.0 * (k % 10 - 2) END AS daily_operational, CASE WHEN k % 10 < 2 THEN 'INVALID_AMOUNT' END AS daily_operational_error,
  100.0 * greatest(k % 10 - 2, 0) AS daily_guidance, NULL::VARCHAR AS daily_guidance_error,
  CASE WHEN k % 3 <> 0 THEN ceil(CASE WHEN k % 2 = 0 THEN amount * 0.5 ELSE amount END)::DOUBLE END AS reduced,
  CASE WHEN k % 3 = 0 THEN 'UNCONFIRMED_CALCULATION_FACT' WHEN amount IS NULL THEN 'MISSING_CALCULATION_FACT' END AS reduced_error FROM x""",
    "multi_indemnity": """
SELECT l_orderkey, CASE n WHEN 0 THEN 'NONE' WHEN 1 THEN 'SINGLE' ELSE 'UNKNOWN' END AS state, n AS n_candidates
FROM (SELECT l_orderkey, count(*) FILTER (l_partkey % 3 = 0 AND l_returnflag <> 'R') AS n FROM lineitem GROUP BY l_orderkey)""",
    "subtotal_by_currency": f"""WITH {LINES_SQL}
SELECT l_orderkey % 100 AS supplier, currency, coalesce(sum(amount) FILTER (category = 'covered'), 0)::DOUBLE AS subtotal,
  count(*) FILTER (category = 'covered') AS n_calculated, count(*) FILTER (category <> 'covered') AS n_unresolved
FROM lines GROUP BY 1, 2""",
    "expense_buckets": f"WITH {_BUCKETS} SELECT * FROM buckets",
    "covered_cost": f"""WITH {_BUCKETS},
x AS (
  SELECT l_orderkey, sum(known_cost) FILTER (bucket = 'COVERED') AS covered,
    bool_or(bucket IN ('UNCONFIRMED', 'COVERAGE_REVIEW') OR (bucket = 'COVERED' AND total_cost IS NULL)) AS partial
  FROM buckets GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN covered IS NOT NULL THEN covered WHEN NOT partial THEN 0 END AS covered_cost, partial FROM x""",
    "case_range": f"""WITH {_BUCKETS},
x AS (
  SELECT l_orderkey, count(*) AS n_cases, count(amount) = count(*) AND count(DISTINCT currency) = 1 AND l_orderkey % 5 <> 0 AS ok,
    min(amount)::DOUBLE AS low, max(amount)::DOUBLE AS high
  FROM costs GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN ok THEN 'RANGE' ELSE 'UNAVAILABLE' END AS state, CASE WHEN ok THEN low END AS low, CASE WHEN ok THEN high END AS high, n_cases FROM x""",
    "case_relation": """
WITH x AS (SELECT l_orderkey, l_quantity::INT AS q, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, CASE WHEN max(n) <= 1 THEN 'MUTUALLY_EXCLUSIVE' ELSE 'NOT_EXCLUSIVE' END AS relation FROM x GROUP BY 1""",
    "unit_amounts": """
WITH x AS (SELECT p_partkey, p_size, p_retailprice::DECIMAL(18,2) * CASE WHEN p_partkey % 4 = 0 THEN 0.125::DECIMAL(4,3) ELSE 1::DECIMAL(4,3) END AS v FROM part)
SELECT p_partkey, CASE WHEN v = round(v, 2) THEN (v * CASE p_size % 3 WHEN 0 THEN 1000 WHEN 1 THEN 10000 ELSE 1 END)::DOUBLE END AS amount FROM x""",
    "wire_decimals": "SELECT p_partkey, CASE WHEN p_partkey % 5 > 2 THEN p_retailprice::DECIMAL(18,2)::DOUBLE END AS amount FROM part",
}
