"""predicate_matrix: the generator only makes rows of outcomes that a projection has computed."""

from verdict.plans import queries


def test_outcomes_are_columns_before_they_are_rows(spark, small):
    plan = queries()["predicate_matrix"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    made = next(line for line in plan.splitlines() if "Generate explode" in line)
    assert "CASE" not in made and "named_struct" not in made
