"""Units of formulas on table-driven cases."""

from verdict.operators.units import bind_units
from verdict.plans import unit_queries

I, C, D, N, R = "Rider.insured_amount", "Receipt.covered_amount", "MedicalEvent.admission_days", "ClaimHistory.counted_occurrence", "MedicalEvent.reduction_applies"
UNSUPPORTED, MISMATCH = "CALCULATION_SOURCE_UNIT_UNSUPPORTED", "CALCULATION_UNIT_MISMATCH"
#: formula, rule kind, calculation kind, what it is bound to, units of some places
CASES = [
    (["multiply", I, ["min", ["max", ["subtract", D, 2], 0], 30]], "rate_amount", "FIXED", "DAILY_INSURED_AMOUNT", {"": "MONEY", "/args/1": "DAYS", "/args/1/args/1": "DAYS", "/args/1/args/0/args/0/args/1": "DAYS"}),
    (["round", ["multiply", I, 0.5]], "rate_amount", "FIXED", "INSURED_RATIO", {"": "MONEY", "/args/0/args/1": "RATIO"}),
    (["multiply", I, 2], "rate_amount", "FIXED", "INSURED_AMOUNT", {"/args/1": "NUMBER"}),
    (["multiply", I, 0.5], "fixed_amount", "FIXED", "INSURED_AMOUNT", {"/args/1": "NUMBER"}),
    (["min", ["subtract", C, 10], 500], "rate_amount", "INDEMNITY", "RECEIPT_AMOUNT", {"/args/1": "MONEY", "/args/0/args/1": "MONEY"}),
    (["multiply", 50, 1], "fixed_amount", "FIXED", "FIXED_AMOUNT", {"": "MONEY", "/args/0": "NUMBER"}),
    (["add", 50, ["max", 1, 2]], "fixed_amount", "FIXED", "FIXED_AMOUNT", {"/args/0": "MONEY", "/args/1/args/1": "MONEY"}),
    (50, "fixed_amount", "FIXED", "FIXED_AMOUNT", {"": "MONEY"}),
    (["multiply", C, ["if", R, 0.5, 1]], "rate_amount", "FIXED", "RECEIPT_AMOUNT", {"/args/1": "NUMBER", "/args/1/args/0": "BOOLEAN", "/args/1/args/1": "NUMBER"}),
    (["if", R, I, 7], "rate_amount", "FIXED", "INSURED_AMOUNT", {"/args/2": "MONEY"}),
    (["if", R, C, ["add", 1, 2]], "rate_amount", "FIXED", "RECEIPT_AMOUNT", {"/args/2": "MONEY", "/args/2/args/0": "MONEY"}),
    (["add", I, D], "rate_amount", "FIXED", MISMATCH, {}),
    (["multiply", I, D], "rate_amount", "INDEMNITY", MISMATCH, {}),
    (["multiply", C, D], "rate_amount", "FIXED", MISMATCH, {}),
    (["multiply", I, ["min", D, N]], "rate_amount", "FIXED", MISMATCH, {}),
    (["multiply", I, I], "rate_amount", "FIXED", MISMATCH, {}),
    (["add", I, R], "rate_amount", "FIXED", MISMATCH, {}),
    (["if", I, 1, 2], "fixed_amount", "FIXED", UNSUPPORTED, {}),
    (["if", R, I, D], "rate_amount", "FIXED", MISMATCH, {}),
    (["add", "Event.unknown", D], "rate_amount", "FIXED", UNSUPPORTED, {}),
    (["add", ["add", I, D], "Event.unknown"], "rate_amount", "FIXED", MISMATCH, {}),
    (D, "rate_amount", "FIXED", UNSUPPORTED, {}),
    (D, "fixed_amount", "FIXED", MISMATCH, {}),
    (["multiply", 2, 3], "rate_amount", "FIXED", UNSUPPORTED, {}),
]
NODE = "formula int, node int, parent int, position int, op string, field string, number string"


def rows(f, tree):
    out = []

    def walk(x, parent, position):
        me = len(out)
        op, field, number = (x[0], None, None) if isinstance(x, list) else (None, x, None) if isinstance(x, str) else (None, None, str(x))
        out.append((f, me, parent, position, op, field, number))
        for i, a in enumerate(x[1:] if isinstance(x, list) else []):
            walk(a, me, i)

    walk(tree, None, 0)
    return out


def test_units_are_bound(spark):
    formulas = [(i, kind, how, "KRW", None) for i, (_, kind, how, *_) in enumerate(CASES)]
    nodes = [r for i, (tree, *_) in enumerate(CASES) for r in rows(i, tree)]
    more = [(100, "rate_amount", "FIXED", None, None), (101, "rate_amount", "FIXED", "KRW", "USD"), (102, "rate_amount", "FIXED", "KRW", "KRW"), (103, "rate_amount", "FIXED", "won", None)]
    nodes += [r for i, *_ in more for r in rows(i, ["multiply", I, 0.5])]
    bound, places = bind_units(spark.createDataFrame(formulas + more, "formula int, rule_kind string, calculation_kind string, currency string, source_currency string"), spark.createDataFrame(nodes, NODE))
    got = {r["formula"]: r for r in bound.collect()}
    units = {}
    for r in places.collect():
        units.setdefault(r["formula"], {})[r["path"].removeprefix("/calculation")] = (r["unit"], r["currency"])
    for i, (tree, _, _, basis, some) in enumerate(CASES):
        assert (got[i]["error"] or got[i]["basis"]) == basis, tree
        assert {p: units[i][p][0] for p in some} == some, tree
        assert len(units.get(i, {})) == (len(rows(i, tree)) if got[i]["error"] is None else 0)
        assert all((c == "KRW") == (u == "MONEY") for u, c in units.get(i, {}).values())
    assert (got[100]["state"], got[100]["basis"], units[100]) == ("CURRENCY_UNRESOLVED", "INSURED_RATIO", {"/args/1": ("RATIO", None)})
    assert [got[i]["error"] for i in (101, 102, 103)] == ["CALCULATION_CURRENCY_MISMATCH", None, "CALCULATION_SOURCE_INVALID"]
    assert got[0]["state"] == "BOUND" and got[11]["state"] is None


def test_nodes_are_read_once_whatever_the_depth(spark):
    seen = spark.sparkContext.accumulator(0)
    nodes = rows(1, ["add", ["add", ["add", I, 1], 2], 3])

    def passed(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    formulas = spark.createDataFrame([(1, "rate_amount", "FIXED", "EUR", None)], "formula int, rule_kind string, calculation_kind string, currency string, source_currency string")
    bound, _ = bind_units(formulas, spark.createDataFrame(nodes, NODE).mapInPandas(passed, NODE))
    assert [r.basis for r in bound.collect()] == ["INSURED_AMOUNT"]
    assert seen.value == len(nodes)


def test_parts_are_dealt_before_their_nodes(spark, small):
    part = spark.read.parquet(f"{small}/part.parquet").coalesce(1)
    nodes = unit_queries._nodes(spark, part)
    assert nodes.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = part.selectExpr("p_partkey AS p", "CAST(p_size AS BIGINT) AS s", "explode(sequence(0L, 12L)) AS i")
    plain = spark.sql(unit_queries._NODES.format(text="STRING").replace("FROM x", "FROM {x}"), x=x)
    assert nodes.exceptAll(plain).isEmpty() and plain.exceptAll(nodes).isEmpty()
