"""Subtotals over contracts: reasons, components, scenarios, budgets; sums beyond 38 digits."""

import random
from decimal import Decimal, localcontext

from pyspark.sql import functions as F

from verdict.functions.exact import carried, limb_sums
from verdict.operators.subtotals import project

CANDIDATE = (
    "response int, position int, kind string, contract string, coverage string, c_kind string, c_contract string, c_coverage string, benefit_kind string, n_cases int, relation string, condition string, case_ok boolean, basis string, "
    "estimate string, amount string, currency string, incomplete boolean, traced boolean, in_context boolean, knowledge_partial boolean, conditions_met boolean, signature string"
)
SOURCE = "response int, position int, kind string, contract string, coverage string"
SCENARIO = "response int, position int, scenario string, number int, hypotheses string, admission boolean, days int, n_hypotheses int, basis string, assumed boolean, estimate string, amount string, currency string, incomplete boolean, traced boolean, in_context boolean, signature string"
RIDER = "OPERATIONAL_RIDER"


def one(contract, amount="10", *, kind=RIDER, coverage="v", canonical=None, **how):
    row = dict(
        kind=kind, contract=contract, coverage=coverage, c_kind=canonical and canonical[0], c_contract=canonical and canonical[1], c_coverage=canonical and canonical[2], benefit_kind="FIXED", n_cases=0, relation=None, condition="MATCH", case_ok=True,
        basis="DOCUMENT_FORMULA", estimate="POINT", amount=amount, currency="KRW", incomplete=False, traced=True, in_context=True, knowledge_partial=False, conditions_met=True, signature=f"{amount}",
    )
    return row | how


def plan(position, key="s", amount="5", **how):
    row = dict(scenario=key, number=0, hypotheses="h", admission=True, days=3, n_hypotheses=2, basis="USER_SCENARIO", assumed=True, estimate="POINT", amount=amount, currency="KRW", incomplete=False, traced=True, in_context=True, signature=f"{amount}")
    return position, row | how


def run(spark, cases):
    names = [x.split()[0] for x in CANDIDATE.split(", ")]
    more = [x.split()[0] for x in SCENARIO.split(", ")]
    candidates, sources, scenarios = [], [], []
    for n, (own, joined, planned) in enumerate(cases):
        candidates += [tuple((c | {"response": n, "position": i})[k] for k in names) for i, c in enumerate(own)]
        sources += [(n, *s) for s in joined]
        scenarios += [tuple((s | {"response": n, "position": i})[k] for k in more) for i, s in planned]
    sums, left = project(spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(sources, SOURCE), spark.createDataFrame(scenarios, SCENARIO))
    out = [({}, {}) for _ in cases]
    for r in sums.collect():
        out[r["response"]][0][r["scenario"], r["currency"]] = (r["amount"], r["partial"], [i["key"]["contract"] for i in r["items"]])
    for r in left.collect():
        out[r["response"]][1][r["scenario"], r["contract"], r["coverage"]] = r["reason"]
    return out


def test_projection(spark):
    canonical = (RIDER, "A", "v")
    faults = [
        (dict(benefit_kind="INDEMNITY"), "NON_FIXED_BENEFIT"), (dict(n_cases=2), "MULTIPLE_PAYOUT_CASES"), (dict(relation="MUTUALLY_EXCLUSIVE"), "MULTIPLE_PAYOUT_CASES"), (dict(condition="UNKNOWN"), "EVENT_CONDITIONS_UNRESOLVED"),
        (dict(n_cases=1, case_ok=False), "PAYOUT_CASE_UNRESOLVED"), (dict(basis="OTHER"), "ESTIMATE_CONTEXT_UNSUPPORTED"), (dict(estimate="RANGE"), "POINT_ESTIMATE_UNAVAILABLE"), (dict(amount=None), "POINT_ESTIMATE_UNAVAILABLE"),
        (dict(incomplete=True), "PARTIAL_ESTIMATE"), (dict(traced=False), "CALCULATION_TRACE_UNAVAILABLE"), (dict(in_context=False), "CALCULATION_CONTEXT_MISMATCH"), (dict(kind="POLICY_TEXT"), "CANONICAL_CONTRACT_UNRESOLVED"),
    ]
    cases = [([one("A"), one("B", "2.5"), one("C", **how)], [], []) for how, _ in faults]
    base = len(cases)
    cases += [
        ([one("A"), one("B", "0.50", currency="EUR"), one("C", "1.25", currency="EUR")], [], []),
        ([one("A"), one("A", coverage="w"), one("B"), one("C")], [], []),
        ([one("A"), one("X", kind="POLICY_TEXT", canonical=canonical), one("B")], [(1, "POLICY_TEXT", "X", "v")], []),
        ([one("A"), one("X", "11", kind="POLICY_TEXT", canonical=canonical), one("B"), one("C")], [(1, "POLICY_TEXT", "X", "v")], []),
        ([one("A"), one("X", kind="POLICY_TEXT", canonical=canonical), one("B"), one("C")], [], []),
        ([one("A"), one("X", kind="POLICY_TEXT", canonical=canonical), one("B"), one("X", coverage="w", canonical=(RIDER, "B", "v")), one("C"), one("D")], [(1, "POLICY_TEXT", "X", "v"), (3, "POLICY_TEXT", "X", "v"), (3, RIDER, "X", "w")], []),
        ([one("A"), one("B"), one("C"), one("D")], [], [plan(0), plan(1, amount="7"), plan(2, days=0)]),
        ([one("A"), one("B"), one("C")], [], [plan(0), plan(0, amount="6", number=1), plan(1), plan(2)]),
        ([one("A"), one("B")], [], [plan(0), plan(1, hypotheses="other")]),
        ([one("A", knowledge_partial=True), one("B"), one("C"), one("D")], [], [plan(0), plan(1), plan(2, basis="OTHER"), plan(3)]),
        ([one("A"), one("B"), one("C"), one("D")], [], [plan(0, key=f"k{i}") for i in range(33)]),
        ([one("A", "9" * 80), one("B", "1")], [], []),
    ]
    got = run(spark, cases)
    for (sums, left), (how, reason) in zip(got[:base], faults, strict=True):
        assert left == {(None, "C", "v"): reason}
        assert sums == {(None, "KRW"): ("12.5", how.get("benefit_kind") is None, ["A", "B"])}
    currencies, coverages, alias, differ, strange, conflict, plans, repeated, hypotheses, scenario, budget, large = got[base:]
    assert currencies == ({(None, "EUR"): ("1.75", False, ["B", "C"])}, {(None, "A", "v"): "INSUFFICIENT_COMPATIBLE_ADDENDS"})
    assert coverages[1] == {(None, "A", c): "SAME_CONTRACT_COMBINATION_UNRESOLVED" for c in "vw"} and coverages[0] == {(None, "KRW"): ("20", True, ["B", "C"])}
    assert alias == ({(None, "KRW"): ("20", False, ["A", "B"])}, {})
    assert differ[1] == {(None, "A", "v"): "CANONICAL_DUPLICATE_CONFLICT"} and differ[0][None, "KRW"][0] == "20"
    assert strange[1] == {(None, "A", "v"): "CANONICAL_IDENTITY_CONFLICT"}
    assert {k[1] for k, r in conflict[1].items() if r == "CANONICAL_IDENTITY_CONFLICT"} == {"A", "B"} and conflict[0][None, "KRW"][2] == ["C", "D"]
    assert plans[0] == {("s", "KRW"): ("12", True, ["A", "B"])}
    assert plans[1]["s", "C", "v"] == "CALCULATION_CONTEXT_MISMATCH" and plans[1][None, "A", "v"] == "ESTIMATE_CONTEXT_UNSUPPORTED" and plans[1][None, "D", "v"] == "INSUFFICIENT_COMPATIBLE_ADDENDS"
    assert repeated[1]["s", "A", "v"] == "SCENARIO_ESTIMATE_CONFLICT" and repeated[0]["s", "KRW"][2] == ["B", "C"]
    assert {r for k, r in hypotheses[1].items() if k[0] == "s"} == {"SCENARIO_HYPOTHESES_CONFLICT"}
    assert (scenario[1]["s", "A", "v"], scenario[1]["s", "C", "v"]) == ("SCENARIO_KNOWLEDGE_INCOMPLETE", "ESTIMATE_CONTEXT_UNSUPPORTED") and scenario[0]["s", "KRW"] == ("10", True, ["B", "D"])
    assert budget[1][None, "A", "v"] in ("SCENARIO_SUBTOTAL_BUDGET_EXCEEDED", "ESTIMATE_CONTEXT_UNSUPPORTED") and budget[0] == {(None, "KRW"): ("30", True, ["B", "C", "D"])}
    assert large == ({}, {(None, c, "v"): "SUBTOTAL_AMOUNT_LIMIT_EXCEEDED" for c in "AB"})


def test_sums_beyond_38_digits(spark):
    rng = random.Random(7)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = [(g, digits(rng.randint(1, 80)) + (("." + digits(rng.randint(1, 79))) if rng.random() < 0.6 else "")) for g in range(20) for _ in range(rng.randint(1, 30))]
    rows += [(50, "0.10"), (50, "0.20"), (51, "000"), (52, "9" * 80), (52, "1"), (53, "1e5"), (54, "-1"), (54, "2"), (55, None)]
    got = {r["g"]: r["t"] for r in spark.createDataFrame(rows, "g int, t string").groupBy("g").agg(carried(limb_sums(F.col("t"))).alias("t")).collect()}
    with localcontext() as c:
        c.prec = 400
        for g in {g for g, _ in rows if g < 53}:
            total = f"{sum(Decimal(t) for h, t in rows if h == g):f}"
            assert got[g] == (total.rstrip("0").rstrip(".") if "." in total else total), g
    assert got[53] is None and got[54] is None and got[55] is None


def test_rows_move_once_by_response(spark):
    names, more = ([x.split()[0] for x in schema.split(", ")] for schema in (CANDIDATE, SCENARIO))
    candidates = [tuple((one("ABC"[i]) | {"response": n, "position": i})[k] for k in names) for n in range(3) for i in range(3)]
    scenarios = [tuple((plan(0)[1] | {"response": n, "position": 0})[k] for k in more) for n in range(3)]
    for df in project(spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame([], SOURCE), spark.createDataFrame(scenarios, SCENARIO)):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        assert not [x for x in lines if "Join" in x]
        assert not [x for x in lines if "Exchange hashpartitioning" in x and any(c in x for c in ("_node", "_cover", "currency"))]

def test_lookups_keep_to_their_rows(spark):
    """A key that is invalid, in one component, or planned in one response is none of that in another; one key fixed in two currencies; duplicates in other positions."""
    canonical = (RIDER, "A", "v")
    alone = ([one("A"), one("B"), one("X", kind="POLICY_TEXT")], [], [])
    joined = ([one("A"), one("X", kind="POLICY_TEXT", canonical=canonical), one("B")], [(1, "POLICY_TEXT", "X", "v")], [])
    strange = ([one("A"), one("X", kind="POLICY_TEXT", canonical=canonical), one("B"), one("C")], [], [])
    twice = ([one("A"), one("A", currency="EUR"), one("B"), one("C", currency="EUR")], [], [plan(2), plan(3, currency="KRW")])
    got = run(spark, [alone, joined, strange, twice, ([one("A"), one("B")], [], [])])
    assert got[0] == ({(None, "KRW"): ("20", True, ["A", "B"])}, {(None, "X", "v"): "CANONICAL_CONTRACT_UNRESOLVED"})
    assert got[1] == ({(None, "KRW"): ("20", False, ["A", "B"])}, {})
    assert got[2] == ({(None, "KRW"): ("20", True, ["B", "C"])}, {(None, "A", "v"): "CANONICAL_IDENTITY_CONFLICT"})
    assert got[3][0] == {("s", "KRW"): ("10", True, ["B", "C"])} and got[3][1][None, "B", "v"] == "ESTIMATE_CONTEXT_UNSUPPORTED"
    assert got[4] == ({(None, "KRW"): ("20", False, ["A", "B"])}, {})
