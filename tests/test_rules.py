import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from verdict.functions.facts import fact
from verdict.functions.tristate import label
from verdict.plans.calculations import compile_calculation, dimension, infix
from verdict.plans.rules import Field, RuleError, compile_expression, compile_rule, validate_calculation, validate_expression

FIELDS = {"A.kind": Field("string", (), ("x", "y")), "A.n": Field("integer", ("occurrences", "days")), "A.day": Field("date", ("date",)), "A.at": Field("date", ("date",)), "A.flag": Field("boolean"), "A.sum": Field("decimal", ("amount",))}
EQ = {"op": "equals", "field": "A.kind", "value": "x"}
COUNT = {"op": "count_before", "field": "A.n", "value": 2, "unit": "occurrences"}


def document(**changes):
    doc = {"schema_version": "1", "rule_kind": "eligibility", "required": True, "input_field_paths": ["A.kind", "A.n"], "expression": EQ, "result_reason_code": "OK", "evidence_ids": ["e"]}
    return doc | changes


@pytest.mark.parametrize(
    ("changes", "code"),
    [
        ({"rule_kind": "other"}, "INVALID_RULE_TYPE"),
        ({"result_reason_code": "bad code"}, "INVALID_REASON_CODE"),
        ({"evidence_ids": ["a", "a"]}, "INVALID_EVIDENCE"),
        ({"calculation": "1"}, "EXPRESSION_OR_CALCULATION"),
        ({"input_field_paths": []}, "UNDECLARED_INPUT"),
        ({"expression": {"op": "equals", "field": "A.kind", "value": "eval x"}}, "ARBITRARY_EXECUTABLE"),
        ({"expression": {"op": "equals", "field": "A.kind", "value": "z"}}, "INVALID_LITERAL"),
        ({"expression": {"op": "equals", "field": "B.kind", "value": "x"}}, "UNKNOWN_FIELD"),
        ({"expression": {"op": "equals", "field": "A.kind", "value": {"field": "A.n"}}}, "UNSUPPORTED_CROSS_REFERENCE"),
        ({"expression": {"op": "like", "field": "A.kind", "value": "x"}}, "UNKNOWN_OPERATOR"),
        ({"expression": {"op": "range", "field": "A.n", "value": [5, 2], "unit": "days"}}, "CONFLICTING_DEFINITION"),
        ({"expression": {"op": "all", "args": [EQ, {"op": "all", "args": [{"op": "equals", "field": "A.kind", "value": "y"}]}]}}, "CONFLICTING_DEFINITION"),
        ({"expression": {"op": "count_before", "field": "A.n", "value": 2, "unit": "days"}}, "INVALID_UNIT"),
    ],
)
def test_refused_rules(changes, code):
    with pytest.raises(RuleError) as e:
        compile_rule("r", document(**changes), FIELDS)
    assert e.value.code == code


def test_contradiction_is_fine_under_any():
    assert validate_expression({"op": "any", "args": [EQ, {"op": "equals", "field": "A.kind", "value": "y"}]}, FIELDS) == {"A.kind"}


def test_depth_and_size_are_bounded():
    deep = EQ
    for _ in range(16):
        deep = {"op": "not", "args": [deep]}
    with pytest.raises(RuleError, match="RULE_TOO_LARGE"):
        validate_expression(deep, FIELDS)


def model(node, row):
    """A plain evaluation: result, missing, conflicting."""
    if node["op"] in ("all", "any", "not"):
        children = [model(a, row) for a in node["args"]]
        merge = lambda i: list(dict.fromkeys(f for c in children for f in c[i]))
        results = [c[0] for c in children]
        if node["op"] == "not":
            result = None if results[0] is None else not results[0]
        elif node["op"] == "all":
            result = False if False in results else None if None in results else True
        else:
            result = True if True in results else None if None in results else False
        return result, merge(1), merge(2)
    value, confirmation, stale = row[node["field"]]
    if value is None:
        return None, [node["field"]], []
    if stale or confirmation == "conflicting":
        return None, [], [node["field"]]
    if confirmation == "unconfirmed":
        return None, [node["field"]], []
    return (value == node["value"] if node["op"] == "equals" else value >= node["value"]), [], []


def random_tree(rng, height):
    if height == 0 or rng.random() < 0.3:
        return rng.choice([EQ, COUNT, {"op": "equals", "field": "A.flag", "value": True}])
    op = rng.choice(["all", "any", "not"])
    return {"op": op, "args": [random_tree(rng, height - 1) for _ in range(1 if op == "not" else rng.randint(1, 3))]}


def test_compiled_rules_agree_with_a_plain_model(spark):
    rng = random.Random(5)
    confirmations = ["user", "ai_structured", "unconfirmed", "conflicting"]
    rows = []
    for i in range(60):
        rows.append((i, *(x for values in (["x", "y", None], [1, 2, 3, None], [True, False, None]) for x in (rng.choice(values), rng.choice(confirmations), rng.random() < 0.2))))
    raw = spark.createDataFrame(rows, "id int, k string, kc string, ks boolean, n bigint, nc string, ns boolean, f boolean, fc string, fs boolean")
    facts = raw.select("id", fact(F.col("k"), F.col("kc"), F.col("ks")).alias("a_kind"), fact(F.col("n"), F.col("nc"), F.col("ns")).alias("a_n"), fact(F.col("f"), F.col("fc"), F.col("fs")).alias("a_flag"))
    trees = [random_tree(rng, rng.randint(0, 5)) for _ in range(12)]
    outcomes = [compile_expression(t, FIELDS) for t in trees]
    columns = [F.struct(o.result.alias("r"), o.missing.alias("m"), o.conflicting.alias("c")).alias(f"t{i}") for i, o in enumerate(outcomes)]
    for got in facts.select("id", *columns).collect():
        r = rows[got["id"]]
        row = {"A.kind": r[1:4], "A.n": r[4:7], "A.flag": r[7:10]}
        for i, t in enumerate(trees):
            assert (got[f"t{i}"]["r"], got[f"t{i}"]["m"], got[f"t{i}"]["c"]) == model(t, row), t


def test_dates(spark):
    day = datetime.date(2026, 9, 4)
    df = spark.createDataFrame([(datetime.date(2026, 8, 25), day), (datetime.date(2026, 8, 26), day), (datetime.date(2026, 8, 25), None)], "a date, b date")
    facts = df.select(fact(F.col("a"), F.lit("user")).alias("a_day"), fact(F.col("b"), F.lit("user")).alias("a_at"))
    since = compile_expression({"op": "days_since", "field": "A.day", "value": 10, "unit": "days"}, FIELDS, reference="A.at")
    one = compile_expression({"op": "date_between", "field": "A.day", "value": ["2026-08-25", "2026-08-25"]}, FIELDS)
    got = [tuple(r) for r in facts.select(label(since.result), since.reason, since.missing, label(one.result)).collect()]
    assert got == [("MATCH", "DAYS_THRESHOLD_MET", [], "MATCH"), ("NO_MATCH", "DAYS_THRESHOLD_NOT_MET", [], "NO_MATCH"), ("UNKNOWN", "MISSING_REFERENCE_DATE", ["A.at"], "MATCH")]


def amounts(spark, node, runtime, values):
    df = spark.createDataFrame([(v, True) for v in values], "v decimal(18,6), f boolean")
    facts = df.select(fact(F.col("v"), F.lit("user")).alias("a_sum"), fact(F.col("f"), F.lit("user")).alias("a_flag"))
    x = compile_calculation(node, FIELDS, runtime, lambda f: F.col(f.replace(".", "_").lower()))
    return [(r[0], r[1]) for r in facts.select(x.value, x.error).collect()]


def test_calculations(spark):
    indemnity = {"op": "round", "rounding": "half_up", "args": [{"op": "min", "args": [{"op": "multiply", "args": [{"op": "max", "args": [{"op": "subtract", "args": ["A.sum", "10000"]}, "0"]}, "0.8"]}, "100000"]}]}
    validate_calculation(indemnity, FIELDS)
    assert amounts(spark, indemnity, "guidance", [Decimal(200000), Decimal(5000), None]) == [(Decimal(100000), None), (Decimal(0), None), (None, "MISSING_CALCULATION_FACT")]
    assert amounts(spark, indemnity, "operational", [Decimal(5000)]) == [(None, "INVALID_AMOUNT")]
    up = {"op": "round", "rounding": "up", "args": [{"op": "subtract", "args": ["A.sum", "10"]}]}
    assert amounts(spark, {"op": "add", "args": [up, "10"]}, "knowledge", [Decimal("5.5")]) == [(Decimal(6), None)]
    assert amounts(spark, {"op": "add", "args": [up, "10"]}, "guidance", [Decimal("5.5")]) == [(Decimal(5), None)]
    assert amounts(spark, {"op": "multiply", "args": ["A.sum", "0.000001"]}, "guidance", [Decimal("0.5"), Decimal(3)]) == [(None, "INVALID_AMOUNT"), (Decimal("0.000003"), None)]
    with pytest.raises(RuleError):
        amounts(spark, {"op": "if", "args": ["A.flag", "1", "2"]}, "operational", [Decimal(1)])
    assert amounts(spark, {"op": "if", "args": ["A.flag", "1", "A.sum"]}, "knowledge", [None]) == [(Decimal(1), None)]


def test_dimensions_and_text():
    units = {"A.sum": "MONEY", "A.n": "DAYS"}
    assert dimension({"op": "multiply", "args": ["A.sum", "0.5"]}, units) == "MONEY"
    assert dimension({"op": "multiply", "args": ["A.sum", "A.n"]}, units) is None
    assert dimension({"op": "add", "args": ["A.sum", "A.n"]}, units) is None
    assert infix({"op": "round", "rounding": "up", "args": [{"op": "add", "args": ["A.sum", "1"]}]}) == "round((A.sum + 1); up)"
