"""Selection of terms on small cases, and the layers of graphs against a plain peeling."""

import datetime
import random

from verdict.operators import components, graphs
from verdict.operators.graphs import layers
from verdict.operators.terms import select_terms

DAY = datetime.date
REQUEST = "request int, space int, contract int, member int, rider int, clause int, event_date date"
EDITION = "request int, edition int, status string, reasons array<string>"
RELATION = "relation int, space int, contract int, member int, rider int, clause int, operation string, previous int, next int, effective_from date, effective_through date, status string, reasons array<string>, is_current boolean"


def change(i, previous, new, *, op=None, start=DAY(2024, 1, 1), end=None, status="MATCH", rider=None, clause=None, contract=1, current=True, reasons=()):
    return (i, 1, contract, 1, rider, clause, op or ("REPLACE" if previous else "ADD"), previous, new, start, end, status, list(reasons), current)


def selected(spark, cases):
    """For each case (base, relations, day) its editions' states and its relations' fates, all selected together."""
    requests, editions, relations = [], [], []
    for n, (base, changes, *day) in enumerate(cases):
        requests.append((n, 1, n, 1, 7, 9, day[0] if day else DAY(2025, 1, 1)))
        editions += [(n, *b) for b in base]
        relations += [(*c[:2], n if c[2] == 1 else -1, *c[3:]) for c in changes]
    states, fate = select_terms(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(editions, EDITION), spark.createDataFrame(relations, RELATION))
    out = [({}, {}) for _ in cases]
    for r in states.collect():
        out[r["request"]][0][r["edition"]] = (r["status"], r["relations"], r["reasons"])
    for r in fate.collect():
        out[r["request"]][1][r["relation"]] = (r["state"], r["scope_reasons"])
    return out


BASE = [(10, "MATCH", [])]
#: relations, the reason, the editions that are unknown for it, the uncertain relations
FAULTS = [
    ([change(1, 10, 11), change(2, 10, 12), change(3, 11, 13)], "COMPETING_TERMS_REPLACEMENTS", {10, 11, 12, 13}, {1, 2, 3}),
    ([change(1, 10, 11), change(2, 11, 12), change(3, 12, 11)], "CHANGE_CYCLE", {11, 12}, {1, 2, 3}),
    ([change(1, 10, 10)], "CHANGE_CYCLE", {10}, {1}),
    ([change(1, 10, 11, start=DAY(2024, 5, 1)), change(2, 11, 12, start=DAY(2024, 2, 1))], "CHANGE_SEQUENCE_INVALID", {11, 12}, {1, 2}),
    ([change(1, 10, 11, start=None), change(2, 11, 12)], "CHANGE_START_UNRESOLVED", {10, 11, 12}, {1, 2}),
    ([change(1, 10, 11, start=DAY(2024, 5, 1), end=DAY(2024, 2, 1))], "CHANGE_PERIOD_INVALID", {10, 11}, {1}),
    ([change(1, 10, 11, status="UNKNOWN")], "CHANGE_RELATION_UNRESOLVED", {10, 11}, {1}),
    ([change(1, 10, 11, op="DROP")], "CHANGE_OPERATION_INVALID", {10, 11}, {1}),
    ([change(1, 10, None)], "CHANGE_TARGET_UNRESOLVED", {10}, {1}),
    ([change(1, 30, 31)], "PREVIOUS_EDITION_UNRESOLVED", {30, 31}, {1}),
    ([change(1, None, 11), change(1, None, 12)], "CHANGE_RELATION_ID_CONFLICT", {11, 12}, {1}),
]


def test_what_cannot_be_told_taints_all_that_follows(spark):
    for (states, fate), (_, reason, unknown, uncertain) in zip(selected(spark, [(BASE, f[0]) for f in FAULTS]), FAULTS, strict=True):
        assert {e for e, (status, _, _) in states.items() if status == "UNKNOWN"} == unknown, reason
        assert all(reason in states[e][2] for e in unknown)
        assert {i for i, (state, _) in fate.items() if state == "UNCERTAIN"} == uncertain


def test_states_flow_down(spark):
    chain = [change(1, 10, 11, reasons=["SOURCE"]), change(2, 11, 12), change(3, None, 20), change(4, 12, 13, start=DAY(2026, 1, 1)), change(5, 12, 14, end=DAY(2024, 6, 1))]
    cases = [
        (BASE, chain),
        (BASE, [change(1, 10, 11), change(2, 10, 12, rider=7), change(3, 10, 13, clause=9), change(4, 10, 14, rider=8)]),
        (BASE, [change(1, 10, 11), change(3, 10, 13, clause=9, start=None)]),
        (BASE, [change(1, 10, 11, contract=2), change(2, 10, 11, current=False)]),
        ([*BASE, (10, "NO_MATCH", []), (15, "MATCH", ["B"])], [change(1, None, None, reasons=["R"]), change(2, 10, 11), change(3, 15, 16), change(4, 15, 16)]),
        (BASE, [change(1, 10, 11)], None),
        (BASE, [change(1, 10, 11), change(2, 30, 11)]),
        ([(30, "MATCH", [])], [change(1, 10, 11), change(2, 30, 11)]),
    ]
    flow, scopes, unsure, none, base, undated, early, late = selected(spark, cases)

    states, fate = flow
    assert states[10] == ("NO_MATCH", [1], ["SOURCE", "TERMS_CHANGE_REPLACED"])
    assert states[11] == ("NO_MATCH", [1, 2], ["SOURCE", "TERMS_CHANGE_REPLACED", "TERMS_CHANGE_REPLACEMENT_APPLIES"])
    assert states[12] == ("MATCH", [1, 2], ["TERMS_CHANGE_REPLACEMENT_APPLIES"])
    assert states[20] == ("MATCH", [3], ["TERMS_CHANGE_ADDED"])
    assert states[13] == states[14] == ("NO_MATCH", [], [])  # not yet, no longer
    assert fate == {i: ("APPLIED", None) for i in (1, 2, 3)}

    assert (scopes[0][13][0], scopes[1]) == ("MATCH", {3: ("APPLIED", None)})
    assert {unsure[0][e][0] for e in (10, 11, 13)} == {"UNKNOWN"}  # an uncertain narrow change certifies no wide one
    assert none == ({10: ("MATCH", [], [])}, {})

    states, fate = base
    assert states[10][0] == states[11][0] == "UNKNOWN" and "BASE_EDITION_CONFLICT" in states[11][2]
    assert fate[1] == ("UNCERTAIN", ["CHANGE_TARGET_UNRESOLVED", "R"])
    assert states[16] == ("MATCH", [3, 4], ["TERMS_CHANGE_REPLACEMENT_APPLIES"]) and states[15] == ("NO_MATCH", [3, 4], ["B", "TERMS_CHANGE_REPLACED"])
    assert undated[0][11][2] == ["EVENT_DATE_UNRESOLVED"]

    # 11 replaces 10 and 30, of which one holds: what is told first is applied, then taken into doubt.
    assert (early[0][11][0], early[0][10][0], early[1][1][0], early[1][2][0]) == ("UNKNOWN", "NO_MATCH", "APPLIED", "UNCERTAIN")
    assert (late[0][11][0], late[1][1][0], late[1][2][0]) == ("UNKNOWN", "UNCERTAIN", "UNCERTAIN")


def test_layers(spark):
    rng = random.Random(3)
    edges = {(g, a, b) for g in range(30) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(14))) if rng.random() < 0.1 or a < b}
    edges |= {(99, 1, 2)}
    want = {}
    for g in {e[0] for e in edges}:
        own = [(a, b) for h, a, b in edges if h == g]
        nodes, placed = sorted({x for e in own for x in e}), {}
        ready = [n for n in nodes if all(b != n for _, b in own)]
        layer = 0
        while ready:
            placed |= {n: (layer, i + 1) for i, n in enumerate(ready)}
            left = [n for n in nodes if n not in placed and all(a in placed for a, b in own if b == n)]
            ready = sorted(left, key=lambda n: (max(placed[a][1] for a, b in own if b == n and placed[a][0] == layer), n))
            layer += 1
        want |= {(g, n): placed.get(n, (None, None)) for n in nodes}
    got = {(r["graph"], r["node"]): (r["layer"], r["rank"]) for r in layers(spark.createDataFrame(sorted(edges), "graph int, a int, b int")).collect()}
    assert got == want


def test_rounds_are_the_logarithm_of_the_longest_chain(spark, monkeypatch):
    cut = []
    for module in (components, graphs):
        monkeypatch.setattr(module, "checkpoint", lambda df, whole=module.checkpoint: cut.append(1) or whole(df))
    (states, fate), _ = selected(spark, [(BASE, [change(i, 9 + i, 10 + i) for i in range(1, 33)]), (BASE, FAULTS[1][0])])
    assert {e: s for e, (s, _, _) in states.items()} == {e: "MATCH" if e == 42 else "NO_MATCH" for e in range(10, 43)}
    assert set(fate.values()) == {("APPLIED", None)}
    assert len(cut) < 24
