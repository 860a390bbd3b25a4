"""Queries of clause graphs: each customer's orders as the regions of an edition, their lines as sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.operators import clause_graphs as graphs
from verdict.sources.tables import table

_REGIONS = """
SELECT c AS edition, k AS region, CASE WHEN r % 3 = 0 THEN concat('Footnote ', CAST(floor(r / 3) AS INT)) ELSE concat('Article ', r) END AS label, r,
  CASE WHEN k % 61 = 0 THEN 'unresolved' WHEN r % 3 = 0 THEN 'footnote' ELSE 'article' END AS kind, k % 67 <> 0 AS complete,
  CASE WHEN k % 122 = 0 THEN {example} WHEN k % 61 = 0 THEN {other} END AS reasons
FROM (SELECT o_orderkey AS k, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) x"""
_SPANS = """
SELECT edition, region, ordinal, CASE WHEN ordinal = 1 AND r % 3 <> 0 THEN CASE p % 5
    WHEN 0 THEN concat('The benefit is EUR ', s, '.5, rounded half up to whole currency units.')
    WHEN 1 THEN 'For each payable admission day, pay the insured amount in EUR; multiply first, then round the total up to whole currency units.'
    WHEN 2 THEN 'Pay 0.125 of the insured amount in EUR, rounded half even to whole currency units.'
    WHEN 3 THEN '  Reimburse the covered receipt amount in EUR, rounded down to whole currency units. '
    ELSE '지급 대상 입원일수와 보험가입금액을 곱하여 EUR로 지급하며, 곱한 총액을 통화 정수 단위로 올림합니다.' END
  ELSE CASE p % 17
    WHEN 0 THEN concat('Exclude the first ', s % 5, ' admission days.')
    WHEN 1 THEN concat('The maximum is ', s % 60, ' payable days.')
    WHEN 2 THEN concat('Deduct EUR ', s % 100, ' from the gross benefit before applying the amount cap and rounding; floor at zero.')
    WHEN 3 THEN concat('The maximum benefit is ', CASE WHEN p % 9 = 0 THEN 'USD ' ELSE 'EUR ' END, 100 + s, '.')
    WHEN 4 THEN 'Surgery must have been performed.'
    WHEN 5 THEN concat('Apply Footnote ', s % 3 + 1, '.')
    WHEN 6 THEN 'Apply Footnote 1.'
    WHEN 7 THEN CASE WHEN p % 2 = 0 AND r % 3 <> 0 THEN concat('Article ', r, ' replaces Article ', CASE WHEN r % 3 = 1 THEN r + 1 ELSE r - 1 END, '.') ELSE 'Diagnosis must be confirmed.' END
    WHEN 8 THEN CASE WHEN p % 5 = 0 THEN 'A further exception applies.' ELSE 'Medical event diagnosis code uses icd version 10: a1, b2.' END
    WHEN 9 THEN concat('Eligible admission days range from 1 to ', s % 30, ' inclusive.')
    WHEN 10 THEN 'When the event reduction condition is true, multiply the gross benefit by 0.5; otherwise keep the gross benefit, before deduction, amount cap and rounding.'
    WHEN 11 THEN concat('최초 입원 ', s % 7, '일은 지급일수에서 제외합니다.')
    WHEN 12 THEN concat('Payment requires fewer than ', s % 4, ' prior occurrences.')
    WHEN 13 THEN CASE WHEN p % 3 = 0 THEN concat('Apply Article ', s % 4 + 1, '.') ELSE concat('The waiting period is ', s % 90, ' days from contract start.') END
    WHEN 14 THEN CASE WHEN p % 10 = 4 THEN '각주 1을 적용합니다.' ELSE 'Admission is required.' END
    WHEN 15 THEN 'The treatment kind must be surgery.'
    ELSE 'Exclude the first 2 admission days.' END END AS text
FROM (
  SELECT reg.edition, reg.region, reg.r, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ordinal
  FROM lineitem l JOIN reg ON l_orderkey = reg.region) x"""


def _graph(spark: SparkSession, folder: str) -> graphs.Graph:
    regions = spark.sql(_REGIONS.format(example="array('LOCAL_EXAMPLE_EXCLUDED')", other="array('SCAN_INCOMPLETE')").replace("FROM orders", "FROM {orders}"), orders=table(spark, folder, "orders"))
    spans = spark.sql(_SPANS.replace("FROM lineitem l JOIN reg", "FROM {lineitem} l JOIN {reg} reg"), lineitem=table(spark, folder, "lineitem"), reg=regions)
    return graphs.read(regions.drop("r"), spans)


def clause_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Which regions are consumed, left out as examples, or unresolved; and how many lines and ties each has."""
    g = _graph(spark, folder)
    state = F.when(F.col("excluded"), "EXCLUDED").when(F.col("unresolved"), "UNRESOLVED").otherwise("CONSUMED")
    nodes = g.nodes.groupBy("edition", "region").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if("supported").alias("n_supported"))
    edges = g.edges.groupBy("edition", "region").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("to_region").isNull()).alias("n_missing"))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = g.regions.join(nodes, ["edition", "region"], "left").join(edges, ["edition", "region"], "left")
    return out.select("edition", "region", "label", state.alias("state"), *map(count, ("n_nodes", "n_supported", "n_edges", "n_missing")))


def clause_benefits(spark: SparkSession, folder: str) -> DataFrame:
    """The calculation of each root and what it pays for one event, or why it has none."""
    x, root = graphs.calculations(_graph(spark, folder)), F.col("root")
    amount = lambda c: c.cast("decimal(18,2)")
    facts = (amount(1000 + root % 500), F.when(root % 11 != 0, root % 40).cast("int"), F.when(root % 7 != 0, amount(root % 900) + F.lit("0.25").cast("decimal(3,2)")), F.when(root % 13 != 0, root % 2 == 0))
    paid = graphs.benefit(*facts)
    return x.select("edition", "root", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("mode", F.lit("")).alias("mode"), F.coalesce(paid, F.lit(-1).cast("decimal(18,0)")).alias("amount"))


def clause_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rules that hold for each root."""
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return graphs.rules(_graph(spark, folder)).select("edition", "root", "region", F.col("ordinal").cast("long").alias("ordinal"), "kind", "operator", "field", *map(none, ("value", "high", "unit", "codes")))


QUERIES = {q.__name__: q for q in (clause_regions, clause_benefits, clause_rules)}


#: The forms as SQL reads them; its patterns allow no repetition as large as that of codes.
_FORMS = [(*x[:5], x[5].replace("){0,63})", ")*)"), x[6]) for x in graphs.FORMS]


def _column(name: str) -> str:
    """One column of a line's meaning in SQL, by the number of its form."""
    out = []
    for i, (kind, detail, rule, field, unit, form, groups) in enumerate(_FORMS):
        own = dict(kind=kind, detail=detail, rule=rule, field=field, unit=unit)
        if name in groups:
            out.append(f"WHEN {i} THEN regexp_extract(line, '^{form}$', {groups.index(name) + 1})")
        elif own.get(name):
            out.append(f"WHEN {i} THEN '{own[name]}'")
    return f"CASE form {' '.join(out)} END AS {name}"


_FORM = " ".join(
    f"WHEN regexp_full_match(line, '{form}')" + (f" AND regexp_extract(line, '^{form}$', 1)::INT <= regexp_extract(line, '^{form}$', 2)::INT" if "high" in groups else "") + f" THEN {i}" for i, (*_, form, groups) in enumerate(_FORMS)
)
_STEPS = f"""
WITH RECURSIVE reg AS ({_REGIONS.format(example="['LOCAL_EXAMPLE_EXCLUDED']", other="['SCAN_INCOMPLETE']")}), sp AS ({_SPANS}),
plan AS (SELECT *, complete AND kind = 'unresolved' AND list_contains(reasons, 'LOCAL_EXAMPLE_EXCLUDED') AS excluded FROM reg),
ln AS (
  SELECT edition, region, ordinal, trim(text) AS line, label AS own, coalesce(nullif(regexp_extract(trim(text), '^{graphs.REFERENCE}$', 1), ''), nullif(regexp_extract(trim(text), '^{graphs.REFERENCE_KO}$', 1), '')) AS tgt,
    regexp_extract(trim(text), '^{graphs.OVERRIDE}$', ['by', 'over']) AS o FROM sp JOIN plan USING (edition, region) WHERE NOT excluded),
lk AS (SELECT *, tgt IS NOT NULL OR o.by = own AS linked FROM ln),
fm AS (SELECT *, CASE WHEN o.by <> '' THEN NULL {_FORM} END AS form FROM lk WHERE NOT linked),
own AS (SELECT edition, region, ordinal, form IS NOT NULL AS ok, {", ".join(map(_column, ("kind", "detail", "rule", "field", "unit", "currency", "rounding", "value", "high", "codes")))} FROM fm),
node0 AS (
  SELECT * FROM own UNION ALL BY NAME
  SELECT edition, region, min(ordinal) AS ordinal, false AS ok FROM ln WHERE (edition, region) NOT IN (SELECT edition, region FROM own) GROUP BY edition, region),
anc AS (SELECT edition, region, arg_min(ordinal, CASE WHEN kind = 'calculation' THEN 0 ELSE 1000000 END + ordinal) AS anchor, bool_and(ok) AS fine FROM node0 GROUP BY edition, region),
node AS (SELECT node0.*, ordinal = anchor AS is_anchor, CASE WHEN kind IS NULL THEN 'information' ELSE concat_ws('|', kind, CASE WHEN kind <> 'condition' THEN coalesce(detail, '') ELSE '' END, coalesce(field, ''), coalesce(rule, '')) END AS shape FROM node0 JOIN anc USING (edition, region)),
lab AS (SELECT plan.edition, label, count(*) AS n, min(region) AS t FROM plan GROUP BY plan.edition, label),
want AS (SELECT DISTINCT edition, region, coalesce(tgt, o.over) AS label, CASE WHEN tgt IS NOT NULL THEN 'DEPENDS_ON' ELSE 'OVERRIDES' END AS rel FROM lk WHERE linked),
link AS (
  SELECT want.*, a.anchor AS ordinal, CASE WHEN n = 1 AND b.anchor IS NOT NULL THEN t END AS t, CASE WHEN n = 1 THEN b.anchor END AS t_ordinal
  FROM want JOIN anc a USING (edition, region) LEFT JOIN lab USING (edition, label) LEFT JOIN anc b ON b.edition = want.edition AND b.region = t),
shp AS (SELECT edition, region, list_sort(list(shape)) AS s FROM node GROUP BY edition, region),
ovr AS (SELECT link.*, x.s = y.s AND len(x.s) = len(list_distinct(x.s)) AS alike FROM link JOIN shp x USING (edition, region) JOIN shp y ON y.edition = link.edition AND y.region = t WHERE rel = 'OVERRIDES'),
edge AS (
  SELECT edition, region, anchor AS ordinal, region AS t, node.ordinal AS t_ordinal, NULL AS label, 'DEPENDS_ON' AS rel FROM node JOIN anc USING (edition, region) WHERE NOT is_anchor
  UNION SELECT edition, region, ordinal, t, t_ordinal, label, rel FROM link WHERE rel = 'DEPENDS_ON' OR t IS NULL
  UNION SELECT edition, region, ordinal, t, t_ordinal, label, rel FROM ovr WHERE NOT alike
  UNION SELECT a.edition, a.region, a.ordinal, b.region, b.ordinal, label, 'OVERRIDES' FROM ovr JOIN node a ON a.edition = ovr.edition AND a.region = ovr.region JOIN node b ON b.edition = ovr.edition AND b.region = t AND b.shape = a.shape WHERE alike),
dep AS (SELECT DISTINCT edition, region AS a, t AS b FROM link WHERE t IS NOT NULL),
reach(edition, root, region) AS (SELECT edition, region, region FROM anc UNION SELECT reach.edition, root, b FROM reach JOIN dep ON dep.edition = reach.edition AND a = reach.region),
cyc AS (SELECT DISTINCT reach.edition, root AS region FROM reach JOIN dep ON dep.edition = reach.edition AND a = reach.region AND b = root),
fault AS (
  SELECT plan.edition, plan.region FROM plan LEFT JOIN anc USING (edition, region) WHERE NOT excluded AND (NOT complete OR kind = 'unresolved' OR anchor IS NULL OR NOT fine)
  UNION SELECT edition, region FROM link WHERE t IS NULL UNION SELECT edition, region FROM ovr WHERE NOT alike UNION FROM cyc),
lost AS (SELECT reach.edition, root AS region FROM reach JOIN fault ON fault.edition = reach.edition AND fault.region = reach.region UNION FROM fault),
art AS (SELECT reach.* FROM reach JOIN plan ON plan.edition = reach.edition AND plan.region = root WHERE kind = 'article'),
within_ AS (FROM art UNION ALL SELECT * FROM reach WHERE (edition, root) IN (SELECT edition, region FROM anc) AND (edition, root) NOT IN (SELECT edition, region FROM art)),
repl AS (SELECT w.edition, root, t, t_ordinal, count(*) AS times FROM within_ w JOIN edge ON edge.edition = w.edition AND edge.region = w.region WHERE rel = 'OVERRIDES' AND t IS NOT NULL GROUP BY ALL)"""
SQL = {
    "clause_regions": f"""{_STEPS}
SELECT edition, region, label, CASE WHEN excluded THEN 'EXCLUDED' WHEN (edition, region) IN (FROM lost) THEN 'UNRESOLVED' ELSE 'CONSUMED' END AS state,
  coalesce(n_nodes, 0) AS n_nodes, coalesce(n_supported, 0) AS n_supported, coalesce(n_edges, 0) AS n_edges, coalesce(n_missing, 0) AS n_missing
FROM plan LEFT JOIN (SELECT edition, region, count(*) AS n_nodes, count_if(ok) AS n_supported FROM node GROUP BY ALL) USING (edition, region)
  LEFT JOIN (SELECT edition, region, count(*) AS n_edges, count_if(t IS NULL) AS n_missing FROM edge GROUP BY ALL) USING (edition, region)""",
    "clause_benefits": f"""{_STEPS},
held AS (SELECT w.edition, w.root, node.* EXCLUDE (edition), times FROM within_ w JOIN node ON node.edition = w.edition AND node.region = w.region LEFT JOIN repl ON repl.edition = w.edition AND repl.root = w.root AND repl.t = node.region AND repl.t_ordinal = node.ordinal),
part AS (
  SELECT edition, root, bool_and(ok) AS fine, count_if(kind = 'calculation' AND live) AS nf, count_if(kind = 'footnote' AND live) AS ne, count_if(detail = 'payable_days' AND live) AS nd, count_if(detail = 'maximum_amount' AND live) AS nm,
    count_if(kind = 'deductible' AND live) AS nu, count_if(kind = 'reduction' AND live) AS nr, max(CASE WHEN kind = 'calculation' AND live THEN detail END) AS mode, max(CASE WHEN kind = 'calculation' AND live THEN rounding END) AS rounding,
    max(CASE WHEN kind = 'calculation' AND live THEN value END)::DOUBLE AS base, max(CASE WHEN kind = 'footnote' AND live THEN value END)::INT AS off, max(CASE WHEN detail = 'payable_days' AND live THEN value END)::INT AS days,
    max(CASE WHEN detail = 'maximum_amount' AND live THEN value END)::DOUBLE AS most, max(CASE WHEN detail = 'maximum_amount' AND live THEN currency END) AS cm, max(CASE WHEN kind = 'deductible' AND live THEN value END)::DOUBLE AS less,
    max(CASE WHEN kind = 'reduction' AND live THEN value END)::DOUBLE AS factor FROM (SELECT *, times IS NULL AS live FROM held) GROUP BY edition, root),
code AS (
  SELECT *, CASE WHEN (edition, root) IN (SELECT w.edition, w.root FROM within_ w JOIN ovr ON ovr.edition = w.edition AND ovr.region = w.region WHERE NOT alike) OR (edition, root) IN (SELECT edition, root FROM repl WHERE times > 1) THEN 'OVERRIDE_CONFLICT'
    WHEN (edition, root) IN (SELECT w.edition, w.root FROM within_ w JOIN link ON link.edition = w.edition AND link.region = w.region WHERE link.t IS NULL) THEN 'DEPENDENCY_MISSING'
    WHEN (edition, root) IN (SELECT w.edition, w.root FROM within_ w JOIN cyc ON cyc.edition = w.edition AND cyc.region = w.region) THEN 'DEPENDENCY_CYCLE' WHEN NOT fine THEN 'SEMANTIC_NODE_UNVERIFIED' WHEN nf = 0 THEN ''
    WHEN greatest(nf, ne, nd, nm, nu, nr) > 1 THEN 'CALCULATION_CONFLICT' WHEN cm <> 'EUR' THEN 'CALCULATION_CURRENCY_MISMATCH' WHEN mode = 'daily' AND ne = 0 THEN 'DAILY_EXCLUSION_BASIS_MISSING'
    WHEN mode <> 'daily' AND ne + nd > 0 THEN 'CALCULATION_UNIT_MISMATCH' ELSE '' END AS code FROM part),
fact AS (SELECT *, (1000 + root % 500)::DOUBLE AS insured, CASE WHEN root % 11 <> 0 THEN root % 40 END AS stay, CASE WHEN root % 7 <> 0 THEN root % 900 + 0.25::DOUBLE END AS covered, CASE WHEN root % 13 <> 0 THEN root % 2 = 0 END AS cut FROM code),
gross AS (
  SELECT *, CASE mode WHEN 'daily' THEN insured * CASE WHEN stay IS NOT NULL THEN least(greatest(stay - off, 0), coalesce(days, 100000)) END WHEN 'fixed' THEN base WHEN 'insured_ratio' THEN insured * base ELSE covered END
    * CASE WHEN factor IS NULL THEN 1 WHEN cut THEN factor WHEN NOT cut THEN 1 END AS g FROM fact),
net AS (SELECT *, CASE WHEN g IS NOT NULL THEN least(CASE WHEN less IS NULL THEN g ELSE greatest(g - less, 0) END, coalesce(most, 1e15)) END AS n FROM gross)
SELECT edition, root, code, CASE WHEN code = '' AND nf = 1 THEN mode ELSE '' END AS mode,
  CASE WHEN code = '' AND nf = 1 AND n IS NOT NULL THEN CASE rounding WHEN 'half up' THEN floor(n + 0.5) WHEN 'down' THEN floor(n) WHEN 'half even' THEN round_even(n, 0) ELSE ceil(n) END ELSE -1 END::DECIMAL(18,0) AS amount
FROM net""",
    "clause_rules": f"""{_STEPS},
good AS (SELECT edition, region FROM node WHERE is_anchor AND ok),
way(edition, root, region) AS (
  SELECT w.edition, root, root FROM within_ w JOIN good ON good.edition = w.edition AND good.region = root
  UNION SELECT way.edition, root, t FROM way JOIN edge ON edge.edition = way.edition AND edge.region = way.region AND t <> edge.region JOIN good ON good.edition = way.edition AND good.region = t)
SELECT way.edition, root, way.region, ordinal, coalesce(rule, 'classification') AS kind, CASE WHEN detail = 'count_below' THEN 'not count_before' ELSE coalesce(detail, 'in') END AS operator, replace(field, ' ', '_') AS field,
  coalesce(value, CASE WHEN kind = 'condition' THEN 'true' ELSE '' END) AS value, coalesce(high, '') AS high, coalesce(unit, '') AS unit, coalesce(codes, '') AS codes
FROM way JOIN node ON node.edition = way.edition AND node.region = way.region
WHERE ok AND kind IN ('condition', 'classification') AND (way.edition, root, way.region, ordinal) NOT IN (SELECT edition, root, t, t_ordinal FROM repl) AND (NOT is_anchor OR (way.edition, way.region) NOT IN (FROM lost))""",
}
