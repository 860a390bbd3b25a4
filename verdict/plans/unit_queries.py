"""Units of formulas: a formula of up to three levels for each part, its shape and leaves taken from the part's key and size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdict.operators import units
from verdict.sources.tables import table

_OPS = ("multiply", "add", "min", "if", "multiply", "subtract", "max", "multiply", "multiply", "if", "multiply")
_LEAVES = (units.INSURED, units.DAYS, units.RECEIPTS[0], units.INSURED, "MedicalEvent.reduction_applies", "ClaimHistory.counted_occurrence", units.INSURED, "Event.unknown")


def _op(i: str) -> str:
    """The operator of node i of part p, null for a leaf; nodes from 4 on are leaves."""
    return f"(CASE WHEN {i} < 4 THEN CASE (p * 7 + {i} * 13 + CAST(floor(p / 11) AS BIGINT)) % 19 " + " ".join(f"WHEN {n} THEN '{x}'" for n, x in enumerate(_OPS)) + " END END)"


def _held(i: str, parent: str) -> str:
    """Whether node i is an argument of the operator of its parent; `if` has three, the others two."""
    return f"({_op(parent)} IS NOT NULL AND (({i} - 1) % 3 < 2 OR {_op(parent)} = 'if'))"


_UP = "CAST(floor((i - 1) / 3) AS BIGINT)"
_UPPER = f"CAST(floor(({_UP} - 1) / 3) AS BIGINT)"
_LEAF = "CASE (p * 3 + i * 5) % 17 " + " ".join(f"WHEN {n} THEN '{x}'" for n, x in enumerate(_LEAVES)) + " END"
# Predicates of `if` are flags more often than not.
_FIELD = f"CASE WHEN i > 0 AND (i - 1) % 3 = 0 AND {_op(_UP)} = 'if' AND p % 5 <> 0 THEN 'MedicalEvent.admission' ELSE {_LEAF} END"
_NODES = f"""
SELECT p AS formula, i AS node, CASE WHEN i > 0 THEN {_UP} END AS parent, CAST(CASE WHEN i = 0 THEN 0 ELSE (i - 1) % 3 END AS INT) AS position, {_op("i")} AS op,
  CASE WHEN {_op("i")} IS NULL THEN {_FIELD} END AS field, CASE WHEN {_op("i")} IS NULL AND ({_FIELD}) IS NULL THEN CAST(CAST((s + i) % 15 AS DECIMAL(8,2)) / 10 AS {{text}}) END AS number
FROM x WHERE i = 0 OR i < 4 AND {_held("i", _UP)} OR i >= 4 AND {_held(_UP, _UPPER)} AND {_held("i", _UP)}"""
_FORMULAS = """
SELECT p_partkey AS formula, CASE WHEN p_partkey % 3 = 0 THEN 'fixed_amount' ELSE 'rate_amount' END AS rule_kind, CASE WHEN p_partkey % 7 = 0 THEN 'INDEMNITY' ELSE 'FIXED' END AS calculation_kind,
  CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 'EUR' END AS currency, CASE WHEN p_partkey % 13 = 0 THEN 'USD' END AS source_currency FROM part"""


def _nodes(spark: SparkSession, part: DataFrame) -> DataFrame:
    """The rows of _NODES; a part's operators are computed once, and parts dealt before their nodes are (a few bytes of them make much work)."""
    listed = lambda values: f"array({', '.join(map(repr, values))})"
    op = lambda i: f"CAST((p * 7 + {i} * 13 + CAST(floor(p / 11) AS BIGINT)) % 19 AS INT)"
    dealt = part.selectExpr("p_partkey AS p", "CAST(p_size AS BIGINT) AS s").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p")
    x = dealt.selectExpr("p", "s", f"transform(array({', '.join(map(op, range(4)))}), n -> get({listed(_OPS)}, n)) AS ops")
    x = x.selectExpr("p", "s", "ops", "explode(sequence(0, 12)) AS i")
    x = x.selectExpr("p", "s", "i", "get(ops, i) AS op", "CASE WHEN i > 0 THEN (i - 1) DIV 3 END AS up", "CASE WHEN i > 0 THEN (i - 1) % 3 ELSE 0 END AS position", "get(ops, CASE WHEN i > 0 THEN CAST((i - 1) DIV 3 AS INT) END) AS up_op",
      "get(ops, CASE WHEN i > 3 THEN CAST(((i - 1) DIV 3 - 1) DIV 3 AS INT) END) AS upper_op")
    held = lambda i, by: f"{by} IS NOT NULL AND (({i} - 1) % 3 < 2 OR {by} = 'if')"
    x = x.where(f"i = 0 OR {held('i', 'up_op')} AND (i < 4 OR {held('up', 'upper_op')})")
    x = x.selectExpr("*", f"CASE WHEN op IS NULL THEN CASE WHEN i > 0 AND position = 0 AND up_op = 'if' AND p % 5 <> 0 THEN 'MedicalEvent.admission' ELSE get({listed(_LEAVES)}, CAST((p * 3 + i * 5) % 17 AS INT)) END END AS field")
    number = "CASE WHEN op IS NULL AND field IS NULL THEN CAST(CAST((s + i) % 15 AS DECIMAL(8,2)) / 10 AS STRING) END AS number"
    return x.selectExpr("p AS formula", "CAST(i AS BIGINT) AS node", "CAST(up AS BIGINT) AS parent", "CAST(position AS INT) AS position", "op", "field", number)


def formula_units(spark: SparkSession, folder: str) -> DataFrame:
    """What each formula is bound to, or why it is not."""
    part = table(spark, folder, "part")
    nodes = _nodes(spark, part)
    bound, places = units.bind_units(spark.sql(_FORMULAS.replace("FROM part", "FROM {part}"), part=part), nodes)
    n = places.groupBy("formula").pivot("unit", ["MONEY", "RATIO"]).count()
    return bound.join(n, "formula", "left").selectExpr("formula", "coalesce(state, '') AS state", "coalesce(basis, '') AS basis", "coalesce(error, '') AS error", "coalesce(RATIO, 0) AS n_ratios")


QUERIES = {"formula_units": formula_units}

_KNOWN = "CASE field " + " ".join(f"WHEN '{f}' THEN '{u}'" for f, u in units.FIELDS.items()) + " END"
_NONE = "CAST([] AS STRUCT(position INT, unit VARCHAR, fields VARCHAR[], field VARCHAR)[])"


def _level(n: int) -> str:
    """The nodes of one level with their unit, from those of the level below."""
    return f"""
c{n} AS (SELECT formula, parent AS node, list(struct_pack(position := position, unit := unit, fields := fields, field := field) ORDER BY position) AS c, min(error) AS below, bool_or(daily) AS d, list_distinct(flatten(list(fields))) AS fs, bool_or(ratio) AS r FROM u{n + 1} GROUP BY formula, parent),
e{n} AS (
  SELECT t.*, coalesce(c, {_NONE}) AS c, below, coalesce(d, false) AS d, coalesce(fs, []) AS fs, coalesce(r, false) AS r, CASE WHEN op = 'if' THEN c[2:] ELSE coalesce(c, {_NONE}) END AS args, rule_kind, calculation_kind
  FROM tree t LEFT JOIN c{n} USING (formula, node) JOIN f USING (formula) WHERE level = {n}),
g{n} AS (
  SELECT *, list_filter(list_transform(args, lambda a: a.unit), lambda u: u NOT IN ('NUMBER', 'RATIO')) AS dims, op = 'multiply' AND rule_kind = 'rate_amount' AND calculation_kind = 'FIXED' AND len(c) = 2
    AND len(list_filter(c, lambda a: a.unit = 'MONEY' AND a.field = '{units.INSURED}')) = 1 AND len(list_filter(c, lambda a: a.unit = 'DAYS' AND a.fields = ['{units.DAYS}'])) = 1 AS by_day FROM e{n}),
h{n} AS (SELECT *, coalesce(by_day, false) AS day, coalesce(list_distinct(dims)[1], 'NUMBER') AS one FROM g{n}),
u{n} AS (
  SELECT formula, node, parent, position, op, field, number, ord, CASE WHEN op IS NULL THEN CASE WHEN field IS NULL THEN 'NUMBER' ELSE {_KNOWN} END WHEN day THEN 'MONEY' ELSE one END AS unit, CASE WHEN field IS NULL THEN fs ELSE [field] END AS fields, d OR day AS daily,
    r OR op = 'multiply' AND NOT day AND len(dims) = 1 AND one = 'MONEY' AND rule_kind = 'rate_amount' AND len(list_filter(nums, lambda z: z BETWEEN 0 AND 1)) > 0 AS ratio,
    least(below, CASE WHEN op IS NULL THEN CASE WHEN field IS NOT NULL AND {_KNOWN} IS NULL THEN ord || '~{units.UNSUPPORTED}' END
      WHEN op = 'if' AND NOT coalesce(len(c) = 3 AND c[1].unit = 'BOOLEAN' AND c[1].field IS NOT NULL, false) THEN ord || '!{units.UNSUPPORTED}'
      WHEN len(list_filter(args, lambda a: a.unit = 'BOOLEAN')) > 0 OR CASE WHEN op = 'multiply' THEN len(dims) > 1 AND NOT day ELSE len(list_distinct(dims)) > 1 OR len(list_filter(args, lambda a: a.unit <> one AND len(a.fields) > 0)) > 0 END THEN ord || '~{units.MISMATCH}' END) AS error
  FROM h{n} LEFT JOIN (SELECT formula, parent AS node, list(number::DOUBLE) FILTER (number IS NOT NULL) AS nums FROM tree GROUP BY formula, parent) USING (formula, node))"""


SQL = {
    "formula_units": f"""
WITH x AS (SELECT p_partkey AS p, p_size::BIGINT AS s, unnest(range(13)) AS i FROM part), n AS ({_NODES.format(text="VARCHAR")}), f AS ({_FORMULAS}),
tree AS (
  SELECT *, CASE WHEN node = 0 THEN 0 WHEN node < 4 THEN 1 ELSE 2 END AS level,
    CASE WHEN node = 0 THEN '0' WHEN node < 4 THEN '0.' || lpad(position::VARCHAR, 4, '0') ELSE '0.' || lpad(((parent - 1) % 3)::VARCHAR, 4, '0') || '.' || lpad(position::VARCHAR, 4, '0') END AS ord FROM n),
u3 AS (SELECT formula, node, parent, position, '' AS unit, CAST([] AS VARCHAR[]) AS fields, field, '' AS error, false AS daily, false AS ratio FROM tree WHERE false), {", ".join(_level(n) for n in (2, 1, 0))},
z AS (
  SELECT f.*, fields, daily, ratio, CASE WHEN currency <> source_currency THEN '{units.CURRENCY}' WHEN error IS NOT NULL THEN regexp_replace(error, '^[0-9.]*[!~]', '')
    WHEN unit = 'MONEY' OR rule_kind = 'fixed_amount' AND unit = 'NUMBER' AND len(fields) = 0 THEN NULL WHEN rule_kind = 'fixed_amount' THEN '{units.MISMATCH}' ELSE '{units.UNSUPPORTED}' END AS code FROM u0 JOIN f USING (formula))
SELECT formula, CASE WHEN code IS NOT NULL THEN '' WHEN currency IS NULL THEN 'CURRENCY_UNRESOLVED' ELSE 'BOUND' END AS state, CASE WHEN code IS NOT NULL THEN '' WHEN daily THEN 'DAILY_INSURED_AMOUNT'
    WHEN list_has_any(fields, {list(units.RECEIPTS)!r}) THEN 'RECEIPT_AMOUNT' WHEN ratio AND list_contains(fields, '{units.INSURED}') THEN 'INSURED_RATIO' WHEN list_contains(fields, '{units.INSURED}') THEN 'INSURED_AMOUNT'
    WHEN len(fields) = 0 AND rule_kind = 'fixed_amount' THEN 'FIXED_AMOUNT' ELSE 'NUMERIC_EXPRESSION' END AS basis, coalesce(code, '') AS error, CASE WHEN code IS NULL AND ratio THEN n_ratios ELSE 0 END AS n_ratios
FROM z LEFT JOIN (
  SELECT formula, count(*) AS n_ratios FROM (
    SELECT t.formula FROM tree t JOIN (SELECT formula, node, op, unit, ratio FROM u0 UNION ALL SELECT formula, node, op, unit, ratio FROM u1) q ON q.formula = t.formula AND q.node = t.parent
      JOIN (SELECT formula, parent, count_if(u NOT IN ('NUMBER', 'RATIO')) AS k FROM (SELECT formula, parent, unit AS u FROM u1 UNION ALL SELECT formula, parent, unit FROM u2) GROUP BY ALL) s ON s.formula = t.formula AND s.parent = t.parent
    WHERE q.op = 'multiply' AND q.unit = 'MONEY' AND k = 1 AND try_cast(t.number AS DOUBLE) BETWEEN 0 AND 1) GROUP BY formula) USING (formula)""",
}
