"""Queries of terms: editions and changes derived from each customer's orders, selected for one event of the customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.operators.terms import select_terms
from verdict.sources.tables import table

#: Orders k of a customer c, in order of date d: every fourth is a base edition, the others change their predecessor's edition.
#: Some changes are faulty, compete, close cycles or start out of order, by what divides their key.
_ORDERS = """
SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d,
  lag(o_orderkey) OVER w AS p, lag(o_orderkey, 2) OVER w AS pp, lead(o_orderkey) OVER w AS n
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
"""
_REQUESTS = """
SELECT c AS request, c % 3 AS space, c AS contract, c % 2 AS member, CASE WHEN c % 5 <> 0 THEN c % 4 END AS rider, c % 3 AS clause,
  CASE WHEN c % 41 <> 0 THEN CAST({minus} AS DATE) END AS event_date
FROM o GROUP BY c
"""
_EDITIONS = """
SELECT c AS request, k AS edition, CASE WHEN k % 44 = 0 THEN 'UNKNOWN' WHEN k % 52 = 0 THEN 'NO_MATCH' ELSE 'MATCH' END AS status,
  CASE WHEN k % 8 = 0 THEN {one} END AS reasons
FROM o WHERE k % 4 = 0
UNION ALL SELECT c, k, 'NO_MATCH', NULL FROM o WHERE k % 60 = 0
"""
_RELATIONS = """
SELECT k AS relation, c % 3 AS space, c AS contract, c % 2 AS member, CASE WHEN k % 29 = 0 THEN k % 4 END AS rider, CASE WHEN k % 31 = 0 THEN c % 3 END AS clause,
  CASE WHEN k % 97 = 0 THEN 'DROP' WHEN p IS NULL OR k % 7 = 0 THEN 'ADD' ELSE 'REPLACE' END AS operation,
  CASE WHEN k % 101 = 0 THEN p WHEN k % 7 = 0 THEN NULL WHEN k % 19 = 0 THEN pp WHEN k % 23 = 0 THEN n ELSE p END AS previous,
  CASE WHEN k % 37 = 0 THEN NULL WHEN k % 43 = 0 THEN p ELSE k END AS next,
  CASE WHEN k % 47 = 0 THEN NULL WHEN k % 53 = 0 THEN {plus400} ELSE d END AS effective_from,
  CASE WHEN k % 59 = 0 THEN {minus1} WHEN k % 3 = 0 THEN {plus600} END AS effective_through,
  CASE WHEN k % 61 = 0 THEN 'UNKNOWN' WHEN k % 67 = 0 THEN 'NO_MATCH' ELSE 'MATCH' END AS status,
  CASE WHEN k % 2 = 0 THEN {two} END AS reasons, k % 71 <> 0 AS is_current
FROM o WHERE k % 4 <> 0
"""
_RELATIONS += """UNION ALL SELECT k, c % 3, c, c % 2, NULL, NULL, 'ADD', NULL, k, d, NULL, 'MATCH', NULL, true FROM o WHERE k % 73 = 0 AND k % 4 <> 0
"""
_SPARK = {"minus": "date_sub(max(d), CAST(min(c % 5) * 120 AS INT))", "one": "array('BASE_SOURCE')", "two": "array(concat('SOURCE_', k % 3))", "plus400": "date_add(d, 400)", "minus1": "date_sub(d, 1)", "plus600": "date_add(d, 600)"}
_DUCK = {"minus": "max(d) - CAST(min(c % 5) * 120 AS INTEGER)", "one": "['BASE_SOURCE']", "two": "['SOURCE_' || k % 3]", "plus400": "d + 400", "minus1": "d - 1", "plus600": "d + 600"}


def _selected(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    o = spark.sql(_ORDERS.replace("FROM orders", "FROM {orders}"), orders=table(spark, folder, "orders"))
    made = [spark.sql(text.format(**_SPARK).replace("FROM o ", "FROM {o} "), o=o) for text in (_REQUESTS, _EDITIONS, _RELATIONS)]
    return select_terms(*made)


def terms_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Each edition's state for its customer's event, with the relations and reasons behind it."""
    states, _ = _selected(spark, folder)
    return states.select("request", "edition", "status", F.array_join("relations", ",").alias("relations"), F.array_join("reasons", ",").alias("reasons"))


def terms_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Which changes are applied and which stay uncertain."""
    _, fate = _selected(spark, folder)
    return fate.select("request", "relation", "state", F.coalesce(F.array_join("scope_reasons", ","), F.lit("")).alias("scope_reasons"))


_SETS = "list_sort(list_distinct(flatten(list({}))))"
_STEPS = f"""
WITH RECURSIVE o AS ({_ORDERS}), req AS ({_REQUESTS.format(**_DUCK)}), ed AS ({_EDITIONS.format(**_DUCK)}), rel AS (SELECT DISTINCT * FROM ({_RELATIONS.format(**_DUCK)})),
cov AS (
  SELECT rel.* EXCLUDE (rider, clause), rel.rider AS rr, rel.clause AS rc, request, event_date AS e, count(*) OVER (PARTITION BY request, relation) > 1 AS twice
  FROM rel JOIN req USING (space, contract, member)
  WHERE is_current AND status <> 'NO_MATCH' AND (rel.rider IS NULL OR rel.rider = req.rider) AND (rel.clause IS NULL OR rel.clause = req.clause)),
act AS (
  SELECT request, relation, operation, previous, next, effective_from, coalesce(reasons, []) AS reasons,
    CASE WHEN rc IS NOT NULL THEN 2 WHEN rr IS NOT NULL THEN 1 ELSE 0 END AS narrow, operation = 'REPLACE' AND previous IS NOT NULL AS repl,
    list_filter([CASE WHEN e IS NULL THEN 'EVENT_DATE_UNRESOLVED' END,
      CASE WHEN effective_through < effective_from THEN 'CHANGE_PERIOD_INVALID' WHEN effective_from IS NULL THEN 'CHANGE_START_UNRESOLVED' END,
      CASE WHEN status = 'UNKNOWN' THEN 'CHANGE_RELATION_UNRESOLVED' END,
      CASE WHEN operation NOT IN ('ADD', 'REPLACE') THEN 'CHANGE_OPERATION_INVALID' END,
      CASE WHEN next IS NULL OR (operation = 'ADD' AND previous IS NOT NULL) OR (operation = 'REPLACE' AND previous IS NULL) THEN 'CHANGE_TARGET_UNRESOLVED' END,
      CASE WHEN previous = next THEN 'CHANGE_CYCLE' END, CASE WHEN twice THEN 'CHANGE_RELATION_ID_CONFLICT' END], lambda x: x IS NOT NULL) AS issues
  FROM cov WHERE coalesce(effective_through < effective_from, false) OR NOT (coalesce(e < effective_from, false) OR coalesce(e > effective_through, false))),
most AS (SELECT *, max(narrow) OVER (PARTITION BY request, previous, repl) AS m FROM act),
chg AS (
  SELECT request, relation, operation, previous, next, effective_from, reasons, issues, len(issues) = 0 AS sound
  FROM (SELECT *, bool_or(narrow = m AND len(issues) > 0) OVER (PARTITION BY request, previous, repl) AS unsure FROM most) WHERE NOT repl OR narrow = m OR unsure),
edge AS (SELECT DISTINCT request, previous AS a, next AS b FROM chg WHERE previous IS NOT NULL AND next IS NOT NULL),
node AS (SELECT DISTINCT request, previous AS v FROM chg WHERE previous IS NOT NULL UNION SELECT request, next FROM chg WHERE next IS NOT NULL),
reach(request, r, v) AS (SELECT request, v, v FROM node UNION SELECT reach.request, r, b FROM reach JOIN edge ON reach.request = edge.request AND v = a),
cyc AS (
  SELECT DISTINCT reach.request, reach.v FROM reach
  WHERE (reach.request, r) IN (SELECT x.request, x.r FROM reach x JOIN edge ON x.request = edge.request AND x.v = a AND x.r = b)),
walk(request, v, n) AS (
  SELECT DISTINCT request, a, 0 FROM edge WHERE (request, a) NOT IN (SELECT request, b FROM edge)
  UNION SELECT walk.request, b, n + 1 FROM walk JOIN edge ON walk.request = edge.request AND v = a WHERE (edge.request, b) NOT IN (SELECT request, v FROM cyc)),
place AS (SELECT request, v, max(n) * 1000000000000 + v AS place FROM walk GROUP BY request, v),
seed AS (
  SELECT request, unnest(list_filter([next, CASE WHEN NOT (operation = 'ADD' AND next IS NULL) THEN previous END], lambda x: x IS NOT NULL)) AS v, issues || reasons AS codes, [relation] AS ids
  FROM chg WHERE NOT sound
  UNION ALL SELECT request, previous, ['COMPETING_TERMS_REPLACEMENTS'], list(relation) FROM chg WHERE previous IS NOT NULL AND next IS NOT NULL GROUP BY request, previous HAVING count(DISTINCT next) > 1
  UNION ALL SELECT cyc.request, cyc.v, ['CHANGE_CYCLE'], g.ids
    FROM cyc JOIN (SELECT request, list(relation) AS ids FROM chg WHERE (request, previous) IN (SELECT request, v FROM cyc) GROUP BY request) g USING (request)
  UNION ALL SELECT f.request, f.next, ['CHANGE_SEQUENCE_INVALID'], [f.relation, s.relation]
    FROM chg f JOIN chg s ON f.request = s.request AND f.next = s.previous WHERE f.sound AND s.sound AND s.next IS NOT NULL AND s.effective_from < f.effective_from),
mark AS (SELECT reach.request, reach.v, {_SETS.format("codes")} AS codes, {_SETS.format("ids")} AS ids FROM reach JOIN seed ON seed.request = reach.request AND seed.v = r GROUP BY reach.request, reach.v),
base AS (
  SELECT request, edition AS v, CASE WHEN count(DISTINCT status) > 1 THEN 'UNKNOWN' ELSE min(status) END AS base,
    flatten(list(coalesce(reasons, []))) || CASE WHEN count(DISTINCT status) > 1 THEN ['BASE_EDITION_CONFLICT'] ELSE [] END AS codes
  FROM ed GROUP BY request, edition),
added AS (SELECT request, next AS v, list(DISTINCT relation) AS ids, flatten(list(reasons)) AS codes FROM chg WHERE sound AND operation = 'ADD' AND next IS NOT NULL GROUP BY request, next),
step AS (
  SELECT chg.request, previous AS v, min(next) AS t, list(DISTINCT relation) AS ids, flatten(list(reasons)) AS codes, min(place) AS place
  FROM chg JOIN place ON place.request = chg.request AND place.v = previous WHERE sound AND operation = 'REPLACE' GROUP BY chg.request, previous),
unmet AS (
  SELECT request, v FROM step WHERE (request, v) NOT IN (SELECT request, next FROM chg WHERE sound AND operation IN ('ADD', 'REPLACE'))
    AND (request, v) NOT IN (SELECT request, v FROM base WHERE base = 'MATCH')),
unsound AS (SELECT request, v FROM mark UNION SELECT reach.request, reach.v FROM reach JOIN unmet ON unmet.request = reach.request AND unmet.v = r),
bad AS (SELECT * FROM step WHERE (request, v) IN (FROM unsound)),
clean AS (SELECT * FROM step WHERE (request, v) NOT IN (FROM unsound)),
chain(request, r, v) AS (SELECT request, v, t FROM clean UNION SELECT chain.request, r, t FROM chain JOIN clean ON chain.request = clean.request AND chain.v = clean.v),
onward AS (
  SELECT chain.request, chain.v, {_SETS.format("clean.ids || coalesce(added.ids, [])")} AS ids
  FROM chain JOIN clean ON clean.request = chain.request AND clean.v = r LEFT JOIN added ON added.request = chain.request AND added.v = r GROUP BY chain.request, chain.v),
early AS (SELECT reach.request, reach.v, min(place) AS place FROM reach JOIN bad ON bad.request = reach.request AND bad.v = r GROUP BY reach.request, reach.v),
onto AS (
  SELECT clean.request, t AS v, clean.ids, clean.codes, mark.v IS NULL AND coalesce(early.place > clean.place, true) AS held
  FROM clean LEFT JOIN mark ON mark.request = clean.request AND mark.v = t LEFT JOIN early ON early.request = clean.request AND early.v = t),
own AS (
  SELECT request, v, {_SETS.format("codes")} AS codes, {_SETS.format("ids")} AS ids FROM (
    SELECT request, v, codes, CAST([] AS BIGINT[]) AS ids FROM base UNION ALL SELECT request, v, codes, ids FROM mark
    UNION ALL SELECT request, v, codes || CASE WHEN (request, v) IN (SELECT request, v FROM mark) THEN [] ELSE ['TERMS_CHANGE_ADDED'] END, ids FROM added
    UNION ALL SELECT request, v, codes || CASE WHEN held THEN ['TERMS_CHANGE_REPLACEMENT_APPLIES'] ELSE [] END, [] FROM onto
    UNION ALL SELECT request, v, [], ids FROM onward) GROUP BY request, v),
lost AS (SELECT bad.request, bad.v, bad.codes || ['PREVIOUS_EDITION_UNRESOLVED'] || coalesce(own.codes, []) AS codes, bad.ids || coalesce(own.ids, []) AS ids FROM bad LEFT JOIN own USING (request, v)),
fallen AS (SELECT reach.request, reach.v, lost.codes, lost.ids FROM reach JOIN lost ON lost.request = reach.request AND lost.v = r)
"""
SQL = {
    "terms_selection": f"""{_STEPS},
whole AS (
  SELECT request, v, {_SETS.format("codes")} AS codes, {_SETS.format("ids")} AS ids FROM (
    FROM own UNION ALL FROM fallen UNION ALL SELECT request, v, codes || ['TERMS_CHANGE_REPLACED'], ids FROM clean
    UNION ALL SELECT DISTINCT request, next, CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]) FROM cov WHERE next IS NOT NULL) GROUP BY request, v)
SELECT request, v AS edition,
  CASE WHEN (request, v) IN (SELECT request, v FROM mark UNION SELECT request, v FROM fallen) THEN 'UNKNOWN' WHEN (request, v) IN (SELECT request, v FROM clean) THEN 'NO_MATCH'
    WHEN (request, v) IN (SELECT request, v FROM added UNION SELECT request, v FROM onto) THEN 'MATCH' ELSE coalesce(base, 'NO_MATCH') END AS status,
  array_to_string(ids, ',') AS relations, array_to_string(whole.codes, ',') AS reasons
FROM whole LEFT JOIN base USING (request, v)""",
    "terms_changes": f"""{_STEPS},
doubt AS (
  SELECT request, relation FROM chg WHERE NOT sound UNION SELECT request, unnest(ids) FROM seed UNION SELECT request, unnest(ids) FROM added WHERE (request, v) IN (SELECT request, v FROM mark)
  UNION SELECT request, unnest(ids) FROM lost UNION SELECT request, unnest(ids) FROM onto WHERE NOT held),
done AS (SELECT request, unnest(ids) AS relation FROM added WHERE (request, v) NOT IN (SELECT request, v FROM mark) UNION SELECT request, unnest(ids) FROM onto WHERE held),
fate AS (SELECT request, relation, 'UNCERTAIN' AS state FROM doubt UNION ALL SELECT request, relation, 'APPLIED' FROM done WHERE (request, relation) NOT IN (FROM doubt))
SELECT request, relation, state, coalesce(array_to_string(codes, ','), '') AS scope_reasons
FROM fate LEFT JOIN (SELECT request, relation, {_SETS.format("issues || reasons")} AS codes FROM chg WHERE NOT sound AND next IS NULL GROUP BY request, relation) USING (request, relation)""",
}
QUERIES = {q.__name__: q for q in (terms_selection, terms_changes)}
