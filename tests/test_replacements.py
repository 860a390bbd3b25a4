"""Replacement chains: rounds follow the longest way, not the number of editions."""

from verdict.operators import graphs


def test_rounds_follow_the_longest_way(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graphs, "checkpoint", lambda df, whole=graphs.checkpoint: rounds.append(1) or whole(df))
    # Ways of three steps; one that comes back with an edition before it; a fork with one before it; one that leaves the editions.
    edges = [(i, i + 1) for i in range(2000) if i % 4 != 3] + [(3000, 3001), (3001, 3002), (3002, 3000), (2999, 3000), (4000, 4001), (4000, 4002), (3999, 4000), (5000, 6000)]
    editions = spark.createDataFrame([(i,) for i in [*range(2000), 2999, 3000, 3001, 3002, 3999, 4000, 4001, 4002, 5000]], "edition long")
    got = {r["edition"]: (r["current"], r["state"]) for r in graphs.replacements(editions, spark.createDataFrame(edges, "previous long, next long")).collect()}
    assert all(got[i] == (i | 3, "APPLIED") for i in range(2000))
    assert {got[i] for i in (2999, 3000, 3001, 3002)} == {(None, "CYCLIC")} and {got[i] for i in (3999, 4000)} == {(None, "COMPETING")}
    assert got[4001] == (4001, "APPLIED") and got[5000] == (6000, "APPLIED")
    assert len(rounds) <= 6
