"""Queries of subtotals: each customer's orders as candidates of one response, some under several references, some planned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.operators import subtotals
from verdict.sources.tables import table

_CANDIDATES = """
SELECT c AS response, r AS position, CASE WHEN k % 6 = 0 THEN 'POLICY_TEXT' ELSE 'OPERATIONAL_RIDER' END AS kind, concat('C', r) AS contract, CASE WHEN k % 29 = 0 THEN 'w' ELSE 'v' END AS coverage,
  CASE WHEN k % 12 = 0 THEN 'OPERATIONAL_RIDER' END AS c_kind, CASE WHEN k % 12 = 0 THEN concat('C', r + 1) END AS c_contract, CASE WHEN k % 12 = 0 THEN 'v' END AS c_coverage,
  CASE WHEN k % 17 = 0 THEN 'INDEMNITY' ELSE 'FIXED' END AS benefit_kind, CAST(k % 3 AS INT) AS n_cases, CASE WHEN k % 31 = 0 THEN 'MUTUALLY_EXCLUSIVE' END AS relation, CASE WHEN k % 37 = 0 THEN 'UNKNOWN' ELSE 'MATCH' END AS condition,
  k % 41 <> 0 AS case_ok, CASE WHEN k % 43 = 0 THEN 'OTHER' ELSE 'DOCUMENT_FORMULA' END AS basis, CASE WHEN k % 47 = 0 THEN 'RANGE' ELSE 'POINT' END AS estimate, amount, CASE WHEN k % 53 = 0 THEN NULL WHEN k % 4 = 0 THEN 'USD' ELSE 'KRW' END AS currency,
  k % 59 = 0 AS incomplete, k % 61 <> 0 AS traced, k % 67 <> 0 AS in_context, k % 71 = 0 AS knowledge_partial, k % 73 <> 0 AS conditions_met, CASE WHEN k % 79 = 0 THEN amount ELSE 'same' END AS signature, k
FROM (SELECT o_custkey AS c, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS r, CAST(CAST(o_totalprice AS DECIMAL(16,2)) AS {text}) AS amount FROM orders) o"""
_SOURCES = """
SELECT response, position, kind, contract, coverage FROM c WHERE c_kind IS NOT NULL AND k % 24 <> 0
UNION ALL SELECT response, position, 'POLICY_TEXT', concat('C', position + 2), 'v' FROM c WHERE c_kind IS NOT NULL AND k % 5 = 0"""
_SCENARIOS = """
SELECT response, position, concat('s', k % 2) AS scenario, n AS number, CASE WHEN k % 83 = 0 THEN 'h' ELSE 'g' END AS hypotheses, true AS admission, CAST(CASE WHEN k % 19 = 0 THEN 0 ELSE 3 END AS INT) AS days, 2 AS n_hypotheses, 'USER_SCENARIO' AS basis, k % 23 <> 0 AS assumed,
  'POINT' AS estimate, concat(CAST(k % 1000 AS {text}), '.5') AS amount, CASE WHEN k % 4 = 0 THEN 'USD' ELSE 'KRW' END AS currency, false AS incomplete, true AS traced, true AS in_context, concat('e', CASE WHEN k % 3 = 0 THEN n ELSE 0 END) AS signature
FROM c JOIN (SELECT 0 AS n UNION ALL SELECT 1) z ON (n = 0 OR k % 10 = 0) WHERE k % 5 < 2"""


def _projected(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    c = spark.sql(_CANDIDATES.format(text="STRING").replace("FROM orders", "FROM {orders}"), orders=table(spark, folder, "orders"))
    sources, scenarios = (spark.sql(x.format(text="STRING").replace("FROM c ", "FROM {c} "), c=c) for x in (_SOURCES, _SCENARIOS))
    return subtotals.project(c.drop("k"), sources, scenarios)


def subtotal_projection(spark: SparkSession, folder: str) -> DataFrame:
    """What may be added up for each customer, as things are and as planned."""
    sums, _ = _projected(spark, folder)
    return sums.select("response", F.coalesce("scenario", F.lit("")).alias("scenario"), "currency", "amount", "partial", F.size("items").alias("n_items"))


def subtotal_omissions(spark: SparkSession, folder: str) -> DataFrame:
    """What may not, and why."""
    _, left = _projected(spark, folder)
    return left.select("response", *(F.coalesce(c, F.lit("")).alias(c) for c in ("scenario", "kind", "contract", "coverage", "currency", "benefit_kind")), "reason")


QUERIES = {q.__name__: q for q in (subtotal_projection, subtotal_omissions)}

_ENDS = "WHEN {p}estimate <> 'POINT' OR {p}amount IS NULL OR {p}currency IS NULL THEN 'POINT_ESTIMATE_UNAVAILABLE' WHEN {p}incomplete THEN 'PARTIAL_ESTIMATE' WHEN NOT {p}traced THEN 'CALCULATION_TRACE_UNAVAILABLE' WHEN NOT {p}in_context THEN 'CALCULATION_CONTEXT_MISMATCH' END"
_BEGINS = "WHEN benefit_kind <> 'FIXED' THEN 'NON_FIXED_BENEFIT' WHEN n_cases > 1 OR relation = 'MUTUALLY_EXCLUSIVE' THEN 'MULTIPLE_PAYOUT_CASES'"
_STEPS = f"""
WITH RECURSIVE c AS ({_CANDIDATES.format(text="VARCHAR")}), src AS ({_SOURCES}), sc AS ({_SCENARIOS.format(text="VARCHAR")}),
x AS (SELECT *, concat_ws('/', kind, contract, coverage) AS raw, CASE WHEN c_kind IS NOT NULL THEN concat_ws('/', c_kind, c_contract, c_coverage) END AS canon FROM c),
j AS (SELECT src.response, src.position, concat_ws('/', src.kind, src.contract, src.coverage) AS source, concat_ws('/', src.kind, src.contract) AS a, canon, concat_ws('/', c_kind, c_contract) AS b FROM src JOIN x USING (response, position) WHERE canon IS NOT NULL),
al AS (SELECT response, source, max(canon) AS key, count(DISTINCT canon) AS n FROM j GROUP BY response, source),
bad AS (
  SELECT response, source AS key FROM al WHERE n > 1 UNION SELECT j.response, canon FROM j JOIN al USING (response, source) WHERE n > 1
  UNION SELECT response, canon FROM x WHERE canon <> raw AND (response, position, raw) NOT IN (SELECT response, position, source FROM j)),
own AS (SELECT x.*, coalesce(canon, al.key, raw) AS key FROM x LEFT JOIN al ON al.response = x.response AND al.source = x.raw),
tie AS (SELECT response, a, b FROM j UNION SELECT response, b, a FROM j),
comp(response, a, b) AS (SELECT response, a, a FROM tie UNION SELECT comp.response, comp.a, tie.b FROM comp JOIN tie ON tie.response = comp.response AND tie.a = comp.b),
root AS (SELECT response, a, min(b) AS root FROM comp GROUP BY response, a),
fx AS (SELECT DISTINCT own.response, key, coalesce(root, regexp_replace(key, '/[^/]*$', '')) AS node FROM own LEFT JOIN root ON root.response = own.response AND root.a = regexp_replace(key, '/[^/]*$', '') WHERE benefit_kind = 'FIXED'),
cov AS (SELECT response, key, count(*) OVER (PARTITION BY response, node) AS n FROM fx),
one AS (
  SELECT response, position, scenario, arg_min(sc, number) AS s, count(DISTINCT signature) > 1 AS differ, bool_or(odd) AS odd
  FROM (SELECT *, min(hypotheses) OVER (PARTITION BY response, scenario) <> max(hypotheses) OVER (PARTITION BY response, scenario) AS odd FROM sc) sc GROUP BY response, position, scenario),
sel AS (
  SELECT response, position, key, benefit_kind, '' AS scenario, amount, currency, signature, CASE {_BEGINS} WHEN condition <> 'MATCH' THEN 'EVENT_CONDITIONS_UNRESOLVED' WHEN n_cases = 1 AND NOT case_ok THEN 'PAYOUT_CASE_UNRESOLVED'
    WHEN basis <> 'DOCUMENT_FORMULA' OR (response, position) IN (SELECT response, position FROM sc) THEN 'ESTIMATE_CONTEXT_UNSUPPORTED' {_ENDS.format(p="")} AS reason FROM own
  UNION ALL SELECT response, position, key, benefit_kind, one.scenario, s.amount, s.currency, own.signature || '|' || s.signature, CASE WHEN odd THEN 'SCENARIO_HYPOTHESES_CONFLICT' WHEN differ THEN 'SCENARIO_ESTIMATE_CONFLICT' {_BEGINS}
    WHEN n_cases = 1 AND NOT case_ok THEN 'PAYOUT_CASE_UNRESOLVED' WHEN knowledge_partial THEN 'SCENARIO_KNOWLEDGE_INCOMPLETE' WHEN NOT conditions_met THEN 'EVENT_CONDITIONS_UNRESOLVED' WHEN NOT s.assumed THEN 'ESTIMATE_CONTEXT_UNSUPPORTED'
    WHEN s.days < 1 THEN 'CALCULATION_CONTEXT_MISMATCH' END FROM one JOIN own USING (response, position)),
g AS (SELECT response, scenario, key, arg_min(sel, position) AS p, count(DISTINCT signature) > 1 AS apart FROM sel GROUP BY response, scenario, key),
h AS (
  SELECT g.response, scenario, key, p.amount AS amount, p.currency AS currency, p.benefit_kind AS benefit_kind, CASE WHEN (g.response, key) IN (FROM bad) THEN 'CANONICAL_IDENTITY_CONFLICT' WHEN apart THEN 'CANONICAL_DUPLICATE_CONFLICT'
    WHEN p.benefit_kind = 'FIXED' AND n > 1 THEN 'SAME_CONTRACT_COMBINATION_UNRESOLVED' WHEN p.benefit_kind = 'FIXED' AND NOT starts_with(key, 'OPERATIONAL_RIDER/') THEN 'CANONICAL_CONTRACT_UNRESOLVED' ELSE p.reason END AS reason
  FROM g LEFT JOIN cov USING (response, key)),
i AS (SELECT * EXCLUDE (reason), coalesce(reason, CASE WHEN count(*) FILTER (reason IS NULL) OVER (PARTITION BY response, scenario, currency) < 2 THEN 'INSUFFICIENT_COMPATIBLE_ADDENDS' END) AS reason FROM h)"""
SQL = {
    "subtotal_projection": f"""{_STEPS},
s AS (SELECT response, scenario, currency, regexp_replace(regexp_replace(sum(amount::DECIMAL(18,2))::VARCHAR, '0+$', ''), '[.]$', '') AS amount, count(*) AS n_items, list(key) AS own FROM i WHERE reason IS NULL GROUP BY response, scenario, currency)
SELECT response, scenario, currency, amount, EXISTS (SELECT 1 FROM i WHERE i.response = s.response AND i.scenario = s.scenario AND reason IS NOT NULL AND benefit_kind = 'FIXED' AND (i.currency IS NULL OR i.currency = s.currency))
  OR scenario <> '' AND EXISTS (SELECT 1 FROM own o WHERE o.response = s.response AND o.benefit_kind = 'FIXED' AND (o.currency IS NULL OR o.currency = s.currency) AND NOT list_contains(s.own, o.key)) AS partial, n_items::INT AS n_items FROM s""",
    "subtotal_omissions": f"""{_STEPS}
SELECT response, scenario, split_part(key, '/', 1) AS kind, split_part(key, '/', 2) AS contract, split_part(key, '/', 3) AS coverage, coalesce(currency, '') AS currency, benefit_kind, reason FROM i WHERE reason IS NOT NULL""",
}
