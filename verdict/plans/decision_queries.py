"""Queries of rules, facts and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.functions.facts import normalized, provenance
from verdict.functions.tristate import collapse, exclude, label, truth
from verdict.operators import decisions
from verdict.plans.rules import compile_expression, compile_rule
from verdict.plans.stand_ins import FACTS_SQL, FIELDS, order_facts
from verdict.sources.tables import table


def _rule(expression: dict, fields: list[str], kind: str = "eligibility", required: bool = True) -> dict:
    return {"schema_version": "1", "rule_kind": kind, "required": required, "input_field_paths": fields, "expression": expression, "result_reason_code": "CHECKED", "evidence_ids": ["e1"]}


IS_F = {"op": "equals", "field": "Event.kind", "value": "F"}
IS_FP = {"op": "in", "field": "Event.kind", "value": ["F", "P"]}
IN_AMOUNT = {"op": "range", "field": "Event.amount", "value": ["1000", "150000"], "unit": "amount"}
IN_DAYS = {"op": "date_between", "field": "Event.day", "value": ["1996-01-01", "1998-12-31"]}
SINCE = {"op": "days_since", "field": "Contract.start", "value": 365, "unit": "days"}
OFTEN = {"op": "count_before", "field": "History.count", "value": 3, "unit": "occurrences"}
_ALL = sorted(FIELDS)
RULES = {
    "r01_present": _rule({"op": "present", "field": "Event.day"}, _ALL),
    "r02_equals": _rule(IS_F, _ALL, "classification"),
    "r03_in": _rule(IS_FP, _ALL, "classification"),
    "r04_range": _rule(IN_AMOUNT, _ALL),
    "r05_date_between": _rule(IN_DAYS, _ALL, "temporal"),
    "r06_days_since": _rule(SINCE, _ALL, "temporal"),
    "r07_count_before": _rule(OFTEN, _ALL, "frequency", False),
    "r08_not": _rule({"op": "not", "args": [{"op": "equals", "field": "Event.kind", "value": "O"}]}, _ALL, "exclusion"),
    "r09_all": _rule({"op": "all", "args": [IS_F, IN_AMOUNT]}, _ALL),
    "r10_any": _rule({"op": "any", "args": [IS_F, OFTEN]}, _ALL),
    "r11_nested": _rule({"op": "all", "args": [{"op": "any", "args": [IS_FP, {"op": "not", "args": [IN_DAYS]}]}, OFTEN]}, _ALL),
}


def rule_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """o_orderkey, rule, rule_kind, required and the outcome of every rule for every order: one pass, no join."""
    outcomes = []
    for name, document in RULES.items():
        rule = compile_rule(name, document, FIELDS)
        outcome = compile_expression(rule.expression, FIELDS, reference="Event.day").struct()
        outcomes.append(F.struct(F.lit(name).alias("rule"), F.lit(rule.kind).alias("rule_kind"), F.lit(rule.required).alias("required"), outcome.alias("outcome")))
    # Each outcome is a column of its own before they become rows: a projection shares what rules have in common, a generator doesn't.
    made = order_facts(spark, folder).select("o_orderkey", "o_custkey", *(x.alias(f"_r{i}") for i, x in enumerate(outcomes)))
    rows = made.select("o_orderkey", "o_custkey", F.explode(F.array(*(f"_r{i}" for i in range(len(outcomes))))).alias("r"))
    return rows.select("o_orderkey", "o_custkey", "r.rule", "r.rule_kind", "r.required", "r.outcome.*")


def predicate_matrix(spark: SparkSession, folder: str) -> DataFrame:
    rows = rule_outcomes(spark, folder)
    return rows.select("o_orderkey", "rule", "result", "reason", F.concat_ws(",", "missing").alias("missing"), F.concat_ws(",", "conflicting").alias("conflicting"))


_KIND_REASON = "CASE kind_state WHEN 'stale' THEN 'STALE_EVIDENCE' WHEN 'conflicting' THEN 'MISSING_OR_CONFLICTING_FACT' WHEN 'unconfirmed' THEN 'UNCONFIRMED_FACT'"
_KIND_MISSING = "CASE WHEN kind_state = 'unconfirmed' THEN 'Event.kind' END"
_KIND_CONFLICTING = "CASE WHEN kind_state IN ('stale', 'conflicting') THEN 'Event.kind' END"
_DAY_MISSING, _AMOUNT_MISSING, _PRIOR_MISSING = (f"CASE WHEN {c} IS NULL THEN '{f}' END" for c, f in (("day", "Event.day"), ("amount", "Event.amount"), ("prior", "History.count")))
_LACKS = "'MISSING_OR_CONFLICTING_FACT'"


def _name(x: str) -> str:
    return f"CASE WHEN {x} THEN 'MATCH' WHEN NOT ({x}) THEN 'NO_MATCH' ELSE 'UNKNOWN' END"


def _outcome(name: str, kind: str, required: bool, result: str, reason: str, missing: list[str], conflicting: list[str]) -> str:
    listed = lambda xs: f"concat_ws(',', {', '.join(xs)})" if xs else "''"
    return f"SELECT o_orderkey, o_custkey, '{name}' AS rule, '{kind}' AS rule_kind, {str(required).upper()} AS required, {_name(result)} AS result, {reason} AS reason, {listed(missing)} AS missing, {listed(conflicting)} AS conflicting FROM leaves"


_MATCHED = "CASE WHEN {x} THEN 'DETERMINISTIC_VALUE_MATCH' ELSE 'DETERMINISTIC_VALUE_MISMATCH' END"
OUTCOMES_SQL = FACTS_SQL + ",\noutcomes AS (\n" + "\nUNION ALL ".join(
    [
        _outcome("r01_present", "eligibility", True, "CASE WHEN day IS NOT NULL THEN TRUE END", f"CASE WHEN day IS NOT NULL THEN 'FACT_PRESENT' ELSE {_LACKS} END", [_DAY_MISSING], []),
        _outcome("r02_equals", "classification", True, "is_f", f"{_KIND_REASON} ELSE {_MATCHED.format(x='is_f')} END", [_KIND_MISSING], [_KIND_CONFLICTING]),
        _outcome("r03_in", "classification", True, "is_fp", f"{_KIND_REASON} ELSE {_MATCHED.format(x='is_fp')} END", [_KIND_MISSING], [_KIND_CONFLICTING]),
        _outcome("r04_range", "eligibility", True, "in_amount", f"CASE WHEN amount IS NULL THEN {_LACKS} WHEN in_amount THEN 'VALUE_IN_RANGE' ELSE 'DETERMINISTIC_VALUE_MISMATCH' END", [_AMOUNT_MISSING], []),
        _outcome("r05_date_between", "temporal", True, "in_days", f"CASE WHEN day IS NULL THEN {_LACKS} WHEN in_days THEN 'DATE_IN_RANGE' ELSE 'DETERMINISTIC_VALUE_MISMATCH' END", [_DAY_MISSING], []),
        _outcome("r06_days_since", "temporal", True, "since", "CASE WHEN day IS NULL THEN 'MISSING_REFERENCE_DATE' WHEN since THEN 'DAYS_THRESHOLD_MET' ELSE 'DAYS_THRESHOLD_NOT_MET' END", [_DAY_MISSING], []),
        _outcome("r07_count_before", "frequency", False, "often", f"CASE WHEN prior IS NULL THEN {_LACKS} WHEN often THEN 'HISTORY_COUNT_MET' ELSE 'HISTORY_COUNT_NOT_MET' END", [_PRIOR_MISSING], []),
        _outcome("r08_not", "exclusion", True, "NOT is_o", "CASE WHEN is_o THEN 'NOT_MATCH' WHEN NOT is_o THEN 'NOT_NO_MATCH' ELSE 'NOT_UNKNOWN' END", [_KIND_MISSING], [_KIND_CONFLICTING]),
        _outcome("r09_all", "eligibility", True, "is_f AND in_amount", "'ALL_' || " + _name("is_f AND in_amount"), [_KIND_MISSING, _AMOUNT_MISSING], [_KIND_CONFLICTING]),
        _outcome("r10_any", "eligibility", True, "is_f OR often", "'ANY_' || " + _name("is_f OR often"), [_KIND_MISSING, _PRIOR_MISSING], [_KIND_CONFLICTING]),
        _outcome("r11_nested", "eligibility", True, "(is_fp OR NOT in_days) AND often", "'ALL_' || " + _name("(is_fp OR NOT in_days) AND often"), [_KIND_MISSING, _DAY_MISSING, _PRIOR_MISSING], [_KIND_CONFLICTING]),
    ]
) + ")"


def required_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts over required rules; orders without one are fine."""
    rows = rule_outcomes(spark, folder).withColumn("required", F.col("required") & (F.col("o_orderkey") % 17 != 0))
    return decisions.decide(rows, ["o_orderkey"], truth(F.col("result")), F.col("required"), True)


def required_fold_strict(spark: SparkSession, folder: str) -> DataFrame:
    """The same, where orders without a required rule are unknown, and exclusions turn round."""
    rows = rule_outcomes(spark, folder).withColumn("required", F.col("required") & (F.col("o_orderkey") % 17 != 0))
    result = exclude(truth(F.col("result")), F.col("rule_kind") == "exclusion")
    return decisions.decide(rows, ["o_orderkey"], result, F.col("required"), None)


def _fold_sql(empty: str, inverted: bool) -> str:
    result = "CASE WHEN rule_kind = 'exclusion' AND result = 'MATCH' THEN 'NO_MATCH' WHEN rule_kind = 'exclusion' AND result = 'NO_MATCH' THEN 'MATCH' ELSE result END" if inverted else "result"
    return f"""
WITH {OUTCOMES_SQL},
needed AS (SELECT o_orderkey, {result} AS result, required AND o_orderkey % 17 <> 0 AS required FROM outcomes),
counted AS (
  SELECT o_orderkey, count(*) FILTER (required AND result = 'MATCH') AS n_match,
         count(*) FILTER (required AND result = 'NO_MATCH') AS n_no_match, count(*) FILTER (required AND result = 'UNKNOWN') AS n_unknown
  FROM needed GROUP BY o_orderkey)
SELECT o_orderkey, CASE WHEN n_no_match > 0 THEN 'NO_MATCH' WHEN n_unknown > 0 THEN 'UNKNOWN' WHEN n_match > 0 THEN 'MATCH' ELSE '{empty}' END AS verdict,
       n_match, n_no_match, n_unknown
FROM counted"""


def exclusion_inversion(spark: SparkSession, folder: str) -> DataFrame:
    rows = rule_outcomes(spark, folder).where(F.col("rule_kind") == "exclusion")
    return rows.select("o_orderkey", label(exclude(truth(F.col("result")), F.lit(True))).alias("result"))


def follow_up_questions(spark: SparkSession, folder: str) -> DataFrame:
    """What to ask for each order, once each, in the order in which rules miss it."""
    return decisions.questions(rule_outcomes(spark, folder), ["o_orderkey"], ["rule"])


def precondition_cascade(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = table(spark, folder, "orders").select("o_orderkey", F.when(key % 11 != 0, F.col("o_orderdate").cast("date")).alias("day"))
    status = F.when(key % 19 == 0, "expired").when(key % 23 == 0, "unknown").otherwise("active")
    own = F.when(key % 29 == 0, F.lit(None)).when(key % 31 == 0, "cancelled").otherwise("active")
    date = lambda text: F.lit(text).cast("date")
    start, end = F.when(key % 37 != 0, date("1995-06-01")), date("2000-12-31")
    own_start = F.when(key % 2 == 0, date("1997-01-01"))
    verdict, reason = decisions.contract_precondition(key % 41 != 0, status, own, key % 3 == 0, F.when(key % 9 != 0, date("1999-01-01")), F.col("day"), start, end, own_start, F.lit(None).cast("date"))
    return orders.select("o_orderkey", label(verdict).alias("verdict"), reason.alias("reason"))


def evidence_complete(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose parts are all approved (parts of an even size), without repeats."""
    requested = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    approved = table(spark, folder, "part").where("p_size % 5 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    return decisions.evidence_complete(requested, approved, "l_orderkey", "l_partkey")


def rule_set_version(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.rule_set_version(table(spark, folder, "lineitem"), ["l_orderkey"], "l_suppkey")


def mapping_collapse(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers of each part as mappings of one thing: bad if some line was sent back, good if all were kept; nulls are skipped."""
    flag, key = F.col("l_returnflag"), F.col("l_suppkey")
    good = F.when(key % 4 != 0, flag.isin("N", "A"))
    bad = F.when(key % 5 != 0, (flag == "R") & (F.col("l_quantity") > 45))
    return table(spark, folder, "lineitem").groupBy("l_partkey").agg(label(collapse(good, bad)).alias("verdict"), F.count(F.lit(1)).alias("n"))


def normalizer_priority(spark: SparkSession, folder: str) -> DataFrame:
    """For each customer the status at the highest priority; several statuses there conflict."""
    orders = table(spark, folder, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), "o_orderstatus")
    return decisions.unique_or_conflict(orders, ["o_custkey"], "priority", "o_orderstatus")


def fact_normalization(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of several kinds, typed or refused."""
    key = F.col("o_orderkey")
    raw = F.when(key % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key % 4 == 1, F.lit("2020-13-01")).when(key % 4 == 2, (key % 100).cast("string")).otherwise(F.concat((key % 100).cast("string"), F.lit(".5")))
    orders = table(spark, folder, "orders").withColumn("raw", raw)
    out = ["o_orderkey", "raw"]
    for kind in ("date", "decimal", "integer"):
        value, error = normalized(F.col("raw"), kind)
        out += [value.cast("string").alias(f"as_{kind}") if kind != "decimal" else value.cast("double").alias("as_decimal"), error.alias(f"{kind}_error")]
    return orders.select(*out)


def fact_provenance(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    source = F.when(F.col("o_orderstatus") == "F", "TRUSTED").when(F.col("o_orderstatus") == "O", "AI_SUGGESTED").otherwise("OTHER")
    state = F.when(F.col("o_orderpriority") == "5-LOW", "CONFLICTING").otherwise("PLAIN")
    return table(spark, folder, "orders").groupBy(provenance(source, state, key % 2 == 0).alias("confirmation")).agg(F.count(F.lit(1)).alias("n"))


def completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Per customer: no orders, some that are open, or all finished."""
    parts = table(spark, folder, "customer").join(table(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("part", F.col("o_orderkey"))
    return decisions.completeness(parts, ["c_custkey"], F.col("o_orderstatus") == "P")


QUERIES = {f.__name__: f for f in (predicate_matrix, required_fold, required_fold_strict, exclusion_inversion, follow_up_questions, precondition_cascade, evidence_complete, rule_set_version, mapping_collapse, normalizer_priority, fact_normalization, fact_provenance, completeness)}

SQL = {
    "predicate_matrix": f"WITH {OUTCOMES_SQL} SELECT o_orderkey, rule, result, reason, missing, conflicting FROM outcomes",
    "required_fold": _fold_sql("MATCH", False),
    "required_fold_strict": _fold_sql("UNKNOWN", True),
    "exclusion_inversion": f"WITH {OUTCOMES_SQL} SELECT o_orderkey, CASE result WHEN 'MATCH' THEN 'NO_MATCH' WHEN 'NO_MATCH' THEN 'MATCH' ELSE result END AS result FROM outcomes WHERE rule_kind = 'exclusion'",
    "follow_up_questions": f"""
WITH {OUTCOMES_SQL},
asked AS (
  SELECT o_orderkey, rule, unnest(list_filter(string_split(missing || ',' || conflicting, ','), lambda x: x <> '')) AS field,
         generate_subscripts(list_filter(string_split(missing || ',' || conflicting, ','), lambda x: x <> ''), 1) AS spot
  FROM outcomes),
firsts AS (SELECT o_orderkey, field, min({{'r': rule, 's': spot}}) AS place FROM asked GROUP BY o_orderkey, field)
SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY place))::INTEGER AS position, field FROM firsts""",
    "precondition_cascade": """
WITH x AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS day,
         CASE WHEN o_orderkey % 19 = 0 THEN 'expired' WHEN o_orderkey % 23 = 0 THEN 'unknown' ELSE 'active' END AS status,
         CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 'cancelled' ELSE 'active' END AS own,
         CASE WHEN o_orderkey % 37 <> 0 THEN DATE '1995-06-01' END AS start, DATE '2000-12-31' AS stop,
         CASE WHEN o_orderkey % 2 = 0 THEN DATE '1997-01-01' END AS own_start
  FROM orders),
y AS (
  SELECT k, CASE WHEN k % 41 = 0 THEN 'EVIDENCE_MISSING'
    WHEN status = 'expired' OR own = 'cancelled' THEN 'PART_INACTIVE'
    WHEN status <> 'active' OR own IS NULL OR own <> 'active' THEN 'STATUS_UNCONFIRMED'
    WHEN k % 3 = 0 AND k % 9 = 0 THEN 'RENEWAL_UNCONFIRMED'
    WHEN day IS NULL THEN 'DATE_REQUIRED' WHEN start IS NULL THEN 'PERIOD_UNCONFIRMED'
    WHEN NOT day BETWEEN start AND stop THEN 'OUTSIDE_CONTRACT_PERIOD'
    WHEN NOT day BETWEEN coalesce(own_start, start) AND stop THEN 'OUTSIDE_PART_PERIOD'
    ELSE 'PRECONDITIONS_MATCH' END AS reason
  FROM x)
SELECT k AS o_orderkey, reason, CASE WHEN reason = 'PRECONDITIONS_MATCH' THEN 'MATCH'
  WHEN reason IN ('PART_INACTIVE', 'OUTSIDE_CONTRACT_PERIOD', 'OUTSIDE_PART_PERIOD') THEN 'NO_MATCH' ELSE 'UNKNOWN' END AS verdict FROM y""",
    "evidence_complete": """
SELECT l_orderkey, count(*) = count(DISTINCT l_partkey) AND count(*) = count(*) FILTER (p_size % 5 <> 0) AS complete,
       count(*) AS n_requested, count(*) FILTER (p_size % 5 <> 0) AS n_found
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
    "rule_set_version": "SELECT l_orderkey, substr(sha256(string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR)), 1, 24) AS version FROM lineitem GROUP BY l_orderkey",
    "mapping_collapse": """
SELECT l_partkey, CASE WHEN bool_or(CASE WHEN l_suppkey % 5 <> 0 THEN l_returnflag = 'R' AND l_quantity > 45 END) THEN 'NO_MATCH'
  WHEN bool_and(CASE WHEN l_suppkey % 4 <> 0 THEN l_returnflag IN ('N', 'A') END) THEN 'MATCH' ELSE 'UNKNOWN' END AS verdict, count(*) AS n
FROM lineitem GROUP BY l_partkey""",
    "normalizer_priority": """
WITH x AS (SELECT o_custkey, o_orderstatus, substr(o_orderpriority, 1, 1)::INT AS p, max(substr(o_orderpriority, 1, 1)::INT) OVER (PARTITION BY o_custkey) AS top FROM orders)
SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS value,
       CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'CONFLICTING' ELSE 'RESOLVED' END AS state
FROM x WHERE p = top GROUP BY o_custkey""",
    "fact_normalization": """
WITH x AS (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '2020-13-01'
    WHEN 2 THEN (o_orderkey % 100)::VARCHAR ELSE (o_orderkey % 100)::VARCHAR || '.5' END AS raw FROM orders)
SELECT o_orderkey, raw, CASE WHEN o_orderkey % 4 = 0 THEN raw END AS as_date, CASE WHEN o_orderkey % 4 <> 0 THEN 'INVALID_DATE' END AS date_error,
       CASE WHEN o_orderkey % 4 >= 2 THEN raw::DOUBLE END AS as_decimal, CASE WHEN o_orderkey % 4 < 2 THEN 'INVALID_DECIMAL' END AS decimal_error,
       CASE WHEN o_orderkey % 4 = 2 THEN raw END AS as_integer, CASE WHEN o_orderkey % 4 <> 2 THEN 'INVALID_INTEGER' END AS integer_error
FROM x""",
    "fact_provenance": """
SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'conflicting' WHEN o_orderstatus = 'F' THEN 'user'
  WHEN o_orderstatus = 'O' AND o_orderkey % 2 <> 0 THEN 'ai_structured' ELSE 'unconfirmed' END AS confirmation, count(*) AS n
FROM orders GROUP BY 1""",
    "completeness": """
SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'UNAVAILABLE' WHEN bool_or(o_orderstatus = 'P') THEN 'PARTIAL' ELSE 'COMPLETE' END AS completeness, count(o_orderkey) AS n_parts
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
}
