"""terms_applicability: each text is made once, not for each condition."""

from verdict.plans import queries


def test_texts_are_made_once(spark, small):
    plan = queries()["terms_applicability"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.lower().count(" as string)") <= 8
