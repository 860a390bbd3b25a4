"""Receipts and payouts: classified sums, indemnities, subtotals by currency, expense buckets, ranges of cases."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.functions.money import rounded

MONEY = "decimal(18,2)"


def receipt_split(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Each receipt's confirmed, additional and excluded sums; a receipt of several currencies has an error instead.

    lines: amount, currency, category (covered, possible_excluded, excluded, unknown), confirmation.
    Excluded lines are excluded; covered ones that the user or a structured source confirmed are confirmed; all
    others need another look.
    """
    excluded = F.col("category") == "excluded"
    confirmed = (F.col("category") == "covered") & F.col("confirmation").isin("user", "ai_structured")
    kind = F.when(excluded, "excluded").when(confirmed, "confirmed").otherwise("additional")
    total = lambda k: F.coalesce(F.sum(F.when(F.col("_kind") == k, F.col("amount"))), F.lit(0)).cast(MONEY)
    out = lines.withColumn("_kind", kind).groupBy(*keys).agg(*(total(k).alias(k) for k in ("confirmed", "additional", "excluded")), F.count_distinct("currency").alias("_n"), F.min("currency").alias("currency"))
    mixed = F.col("_n") > 1
    return out.select(*keys, F.when(~mixed, F.col("currency")).alias("currency"), *(F.when(~mixed, F.col(k)).alias(k) for k in ("confirmed", "additional", "excluded")), F.when(mixed, "CURRENCY_MISMATCH").alias("error"))


def indemnity(split: DataFrame, deductible: Decimal, rate: Decimal, limit: Decimal, rounding: str = "half_up") -> DataFrame:
    """split with amount and status: round(min(max(confirmed - deductible, 0) * rate, limit)).

    partial: something additional is open; unknown: the receipt has an error.
    """
    if not 0 <= rate <= 1:
        raise ValueError("INVALID_RATE")
    eligible = F.greatest(F.col("confirmed") - F.lit(deductible).cast(MONEY), F.lit(0).cast(MONEY))
    share = (eligible * F.lit(rate).cast("decimal(9,6)")).cast("decimal(24,8)")
    amount = rounded(F.least(share, F.lit(limit).cast("decimal(24,8)")), rounding).cast(MONEY)
    status = F.when(F.col("error").isNotNull(), "unknown").when(F.col("additional") > 0, "partial").otherwise("computed")
    return split.withColumn("amount", F.when(F.col("error").isNull(), amount)).withColumn("status", status)


def several_indemnities(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """NONE, SINGLE, or UNKNOWN where several contracts could pay one event: they are never summed."""
    n = F.count_if((F.col("kind") == "indemnity") & (F.col("result") != "NO_MATCH"))
    return candidates.groupBy(*keys).agg(F.when(n == 0, "NONE").when(n == 1, "SINGLE").otherwise("UNKNOWN").alias("state"), n.alias("n_candidates"))


def subtotals(calculated: DataFrame, keys: list[str]) -> DataFrame:
    """For each currency the sum of what is calculated and how many are and are not; unresolved ones add nothing."""
    done = F.col("amount").isNotNull()
    return calculated.groupBy(*keys, "currency").agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(28,4)").alias("subtotal"), F.count_if(done).alias("n_calculated"), F.count_if(~done).alias("n_unresolved"))


def expense_buckets(expenses: DataFrame, keys: list[str]) -> DataFrame:
    """Costs by currency and bucket: known cost, and the whole cost, null where any cost of the bucket is unknown.

    A cost that the user classified is COVERED, EXCLUDED or COVERAGE_REVIEW, any other UNCONFIRMED.
    """
    by_user = F.coalesce(F.col("confirmation") == "user", F.lit(False))
    bucket = (
        F.when(by_user & (F.col("category") == "covered"), "COVERED")
        .when(by_user & (F.col("category") == "excluded"), "EXCLUDED")
        .when(by_user, "COVERAGE_REVIEW")
        .otherwise("UNCONFIRMED")
    )
    known = F.sum("amount").cast("decimal(28,2)")
    return expenses.withColumn("bucket", bucket).groupBy(*keys, "currency", "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("amount").alias("n_known"),
        F.coalesce(known, F.lit(0)).cast("decimal(28,2)").alias("known_cost"),
        F.when(F.count("amount") == F.count(F.lit(1)), known).alias("total_cost"),
    )


def covered_cost(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """The covered cost of each key: 0 only where everything is classified and excluded, else null if none is covered."""
    covered = F.sum(F.when(F.col("bucket") == "COVERED", F.col("known_cost"))).cast("decimal(28,2)")
    open_ = F.coalesce(F.bool_or(F.col("bucket").isin("UNCONFIRMED", "COVERAGE_REVIEW") | (F.col("bucket").isin("COVERED") & F.col("total_cost").isNull())), F.lit(False))
    out = buckets.groupBy(*keys).agg(covered.alias("_covered"), open_.alias("partial"))
    return out.select(*keys, F.when(F.col("_covered").isNotNull(), F.col("_covered")).when(~F.col("partial"), F.lit(0)).cast("decimal(28,2)").alias("covered_cost"), "partial")


def case_range(cases: DataFrame, keys: list[str]) -> DataFrame:
    """RANGE from the least to the largest amount of exclusive cases in one currency, all of them known; else UNAVAILABLE.

    cases: amount (null: no point), currency, exclusive. Cases are alternatives: they are never summed.
    """
    ok = (F.count("amount") == F.count(F.lit(1))) & F.bool_and("exclusive") & (F.count_distinct("currency") == 1)
    out = cases.groupBy(*keys).agg(F.min("amount").alias("_low"), F.max("amount").alias("_high"), F.coalesce(ok, F.lit(False)).alias("_ok"), F.count(F.lit(1)).alias("n_cases"))
    return out.select(*keys, F.when(F.col("_ok"), "RANGE").otherwise("UNAVAILABLE").alias("state"), F.when(F.col("_ok"), F.col("_low")).alias("low"), F.when(F.col("_ok"), F.col("_high")).alias("high"), "n_cases")


def pairwise_exclusive(alternatives: DataFrame, key: str, case: str, values: str) -> DataFrame:
    """MUTUALLY_EXCLUSIVE where no two cases of a key allow a common value, else NOT_EXCLUSIVE.

    alternatives: a row for each case with the array of values it allows. Counted by value instead of by pairs: two
    cases overlap if some value belongs to more than one.
    """
    return exclusive(alternatives.select(key, case, F.explode(values).alias("_v")), key, case, "_v")


def exclusive(allowed: DataFrame, key: str, case: str, value: str) -> DataFrame:
    """The same of a row for each value that a case allows, any number of times: a value of several cases has a least and a greatest that differ."""
    shared = allowed.groupBy(key, value).agg(F.coalesce(F.min(case) != F.max(case), F.lit(False)).alias("_shared"))
    return shared.groupBy(key).agg(F.when(F.bool_or("_shared"), "NOT_EXCLUSIVE").otherwise("MUTUALLY_EXCLUSIVE").alias("relation"))


def unit_amount(amount: Column, unit: Column) -> Column:
    """A table amount in its unit (1, 1,000 or 10,000), null for more than two decimals or beyond 10**16."""
    value = amount.cast("decimal(20,2)") * F.when(unit == "thousand", 1000).when(unit == "ten_thousand", 10000).otherwise(1)
    return F.when((amount == F.round(amount, 2)) & (value < F.lit(Decimal(10) ** 16)), value.cast("decimal(22,2)"))


#: The kinds of rules that may give a fixed amount.
FIXED_KINDS = ("fixed_amount", "rate_amount", "deductible", "limit")


def fixed_benefit(matched: Column, executable: Column, kind: Column, evidenced: Column, currency: Column, value: Column, error: Column, rounded_last: Column) -> Column:
    """A fixed amount or why there is none: struct(status, reason, amount). The order of the tests is part of the meaning.

    value, error: of the calculation; an amount of more than two decimals needs a rule that rounds last.
    """
    missing = error.isin("MISSING_CALCULATION_FACT", "UNCONFIRMED_CALCULATION_FACT")
    reason = (
        F.when(~F.coalesce(matched, F.lit(False)), "CANDIDATE_NOT_MATCHED")
        .when(~F.coalesce(executable, F.lit(False)), "RULE_NOT_EXECUTABLE")
        .when(~F.coalesce(kind.isin(*FIXED_KINDS), F.lit(False)), "UNSUPPORTED_CALCULATION_RULE")
        .when(~F.coalesce(evidenced, F.lit(False)), "RULE_EVIDENCE_UNAVAILABLE")
        .when(currency.isNull() | missing, "MISSING_FIXED_INPUT")
        .when(error.isNotNull(), error)
        .when((value != F.round(value, 2)) & ~rounded_last, "ROUNDING_RULE_REQUIRED")
    )
    amount = F.when(reason.isNull(), value.cast("decimal(18,2)"))
    return F.struct(F.when(reason.isNull(), "computed").otherwise("unknown").alias("status"), reason.alias("reason"), amount.alias("amount"))
