"""Affected roots: nothing of a round goes through the driver."""

from verdict.operators import components, graphs


def test_rounds_are_not_broadcast(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(components, "checkpoint", lambda df, whole=components.checkpoint: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df))
    edges = spark.createDataFrame([(i + 1, i) for i in range(4)], "a long, b long")
    changed, roots = spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(i,) for i in range(6)], "root long")
    out = graphs.affected(edges, changed, roots)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sorted(r["root"] for r in out.collect()) == [1, 2, 3, 4]
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
