"""case_relation: alternatives are counted by value without a set for each case."""

from verdict.operators.payments import exclusive
from verdict.plans import queries


def test_no_sets_are_collected(spark, small):
    plan = queries()["case_relation"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "explode" not in plan


def test_repeated_values_of_one_case_are_no_overlap(spark):
    rows = [(1, 10, 5), (1, 10, 5), (1, 11, 6), (2, 10, 5), (2, 11, 5), (3, None, 5), (4, 10, 7)]
    got = {r["k"]: r["relation"] for r in exclusive(spark.createDataFrame(rows, "k int, c int, v int"), "k", "c", "v").collect()}
    assert got == {1: "MUTUALLY_EXCLUSIVE", 2: "NOT_EXCLUSIVE", 3: "MUTUALLY_EXCLUSIVE", 4: "MUTUALLY_EXCLUSIVE"}
