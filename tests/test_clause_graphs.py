"""Graphs of clauses: meanings, references, roots, calculations and rules on small editions."""

import pytest
from pyspark.sql import functions as F

from verdict.operators import clause_graphs as graphs

DAILY = "For each payable admission day, pay the insured amount in KRW; multiply first, then round the total half up to whole currency units."
FIXED = "The benefit is KRW 50, rounded half up to whole currency units."
OFF, LIMIT = "Exclude the first 2 admission days.", "The maximum is 3 payable days."
CODES = "Medical event diagnosis code uses icd version 10: a1, b2."
DAYS = "Eligible admission days range from 1 to 10 inclusive."
MEANINGS = {
    FIXED: ("calculation", "fixed", "50"), f"  {FIXED} ": ("calculation", "fixed", "50"), "최초 입원 3일은 지급일수에서 제외합니다.": ("footnote", "initial_excluded_days", "3"), OFF: ("footnote", "initial_excluded_days", "2"),
    "Pay 0.25 of the insured amount in KRW, rounded down to whole currency units.": ("calculation", "insured_ratio", "0.25"), "Payment requires fewer than 2 prior occurrences.": ("condition", "count_below", "2"), CODES: ("classification", None, None),
    "The maximum benefit is KRW 100.": ("limit", "maximum_amount", "100"), DAYS: ("condition", "range", "1"), "Eligible admission days range from 10 to 1 inclusive.": None, "Exclude the first 40000 admission days.": None,
    "Medical event classification uses x version 1: a, a.": None, f"{FIXED} Unless excluded.": None, "The benefit is KRW 050, rounded half up to whole currency units.": None, "the benefit is KRW 50, rounded half up to whole currency units.": None, "": None, f"{FIXED}\n{FIXED}": None,
}


def test_meanings(spark):
    got = spark.createDataFrame(list(enumerate(MEANINGS)), "i int, t string").select("i", graphs.meaning(F.col("t")).alias("m")).collect()
    assert {list(MEANINGS)[r["i"]]: r["m"] and (r["m"]["kind"], r["m"]["detail"], r["m"]["value"]) for r in got} == MEANINGS


def graph(spark, editions):
    regions, spans = [], []
    for e, records in enumerate(editions):
        for i, (label, lines, *how) in enumerate(records):
            kind, complete, reasons = how[0] if how else (label.split()[0].lower(), True, [])
            regions.append((e, i, label, kind, complete, reasons))
            spans += [(e, i, n, t) for n, t in enumerate(lines)]
    return graphs.read(spark.createDataFrame(regions, "edition int, region int, label string, kind string, complete boolean, reasons array<string>"), spark.createDataFrame(spans, "edition int, region int, ordinal int, text string"))


FULL = [("Article 1", [DAILY, LIMIT, "Apply Footnote 1.", "Apply Appendix 1."]), ("Footnote 1", [OFF]), ("Appendix 1", [CODES]), ("Article 2", [FIXED])]
EDITIONS = [
    FULL,
    [("Article 1", [*FULL[0][1], "A further exception applies."]), *FULL[1:]],
    [("Article 1", [DAILY, LIMIT, "Apply Footnote 9."]), *FULL[1:]],
    [FULL[0], ("Footnote 1", [OFF, "Apply Article 1."]), *FULL[2:]],
    [("Article 1", [FIXED]), ("Article 2", [FIXED.replace("50", "70"), "Article 2 replaces Article 1."]), ("Article 3", [FIXED.replace("50", "90"), "Article 99 replaces Article 1."])],
    [("Article 1", [FIXED, *[DAYS] * 256])],
    [("Article 1", [DAYS, "Payment requires fewer than 2 prior occurrences."])],
    [("Article 1", [FIXED]), ("Article 2", [FIXED], ("unresolved", True, ["LOCAL_EXAMPLE_EXCLUDED"])), ("Article 3", [FIXED], ("unresolved", True, ["OTHER"])), ("Article 4", [FIXED], ("article", False, []))],
    [("Article 1", ["Apply Footnote 1."]), ("Footnote 1", [OFF]), ("Footnote 1", [LIMIT])],
    [("Article 1", [DAILY])],
    [("Article 1", [FIXED, OFF])],
    [("Article 1", [FIXED, "The maximum benefit is USD 5."])],
    [("Article 1", [FIXED, FIXED])],
    [("Article 1", ["Reimburse the covered receipt amount in KRW, rounded down to whole currency units.", "Deduct KRW 10 from the gross benefit before applying the amount cap and rounding; floor at zero.", "The maximum benefit is KRW 25."])],
    [("Article 1", [FIXED, DAYS]), ("Article 2", [FIXED, "Article 2 replaces Article 1."])],
]


@pytest.fixture(scope="module")
def whole(spark):
    return graph(spark, EDITIONS)


def test_regions_and_roots(whole):
    lost = {}
    for r in whole.regions.where("unresolved").collect():
        lost.setdefault(r["edition"], set()).add(r["region"])
    assert lost == {1: {0}, 2: {0}, 3: {0, 1}, 4: {2}, 5: {0}, 7: {2, 3}, 8: {0}, 14: {1}}
    assert [(r["edition"], r["region"]) for r in whole.regions.where("excluded").collect()] == [(7, 1)]
    roots = {}
    for r in whole.within.collect():
        roots.setdefault((r["edition"], r["root"]), set()).add(r["region"])
    assert roots[0, 0] == {0, 1, 2} and roots[0, 3] == {3} and (0, 1) not in roots
    assert roots[2, 1] == {1} and roots[2, 2] == {2}  # nothing rests on them, so they are roots
    missing = {(r["edition"], r["label"], r["relation"]) for r in whole.edges.where("to_region is null").collect()}
    assert missing == {(2, "Footnote 9", "DEPENDS_ON"), (8, "Footnote 1", "DEPENDS_ON")}


def test_calculations(whole):
    amount = graphs.benefit(F.lit(100).cast("decimal(18,2)"), F.lit(6), F.lit(60).cast("decimal(18,2)"), F.lit(False))
    got = {(r["edition"], r["root"]): (r["code"], r["amount"]) for r in graphs.calculations(whole).select("edition", "root", "code", amount.alias("amount")).collect()}
    assert got[0, 0] == (None, 300) and got[0, 3] == (None, 50)
    assert got[1, 0] == ("SEMANTIC_NODE_UNVERIFIED", None) and got[1, 3] == (None, 50)
    assert got[2, 0] == ("DEPENDENCY_MISSING", None) and got[3, 0] == ("DEPENDENCY_CYCLE", None) and got[3, 3] == (None, 50)
    assert got[4, 0] == (None, 50) and got[4, 1] == (None, 70) and got[4, 2] == ("SEMANTIC_NODE_UNVERIFIED", None)
    assert got[6, 0] == (None, None)
    assert got[9, 0] == ("DAILY_EXCLUSION_BASIS_MISSING", None) and got[10, 0] == ("CALCULATION_UNIT_MISMATCH", None)
    assert got[11, 0] == ("CALCULATION_CURRENCY_MISMATCH", None) and got[12, 0] == ("CALCULATION_CONFLICT", None)
    assert got[13, 0] == (None, 25) and got[14, 1] == ("OVERRIDE_CONFLICT", None)


def test_rules(whole):
    found = {}
    for r in graphs.rules(whole).collect():
        found.setdefault((r["edition"], r["root"]), set()).add((r["kind"], r["operator"], r["field"], r["value"], r["codes"]))
    code = ("classification", "in", "diagnosis_code", None, "a1, b2")
    assert found[0, 0] == {code}
    assert found[1, 0] == {code}  # the line without meaning blocks the calculation, not what the appendix says
    assert found[6, 0] == {("eligibility", "range", "admission_days", "1", None), ("frequency", "not count_before", "counted_occurrence", "2", None)}


def test_a_line_held_stripped_is_not_stripped_again_for_each_form(spark):
    lines = spark.createDataFrame([("  Admission is required. ",), ("The maximum is 9 payable days.",), ("Else.",), (" ",), (None,)], "text string")
    held = lines.withColumn("line", F.trim("text")).select(graphs.meaning(F.col("text"), F.col("line")).alias("m"))
    assert "regexp_replace" not in held._jdf.queryExecution().analyzed().toString()
    assert held.collect() == lines.select(graphs.meaning(F.col("text")).alias("m")).collect()


def test_meanings_are_kept_compressed_and_only_regions_that_apply_others_followed(spark, monkeypatch):
    kept, starts = [], []
    monkeypatch.setattr(graphs, "checkpoint", lambda df, *a: kept.append(df.columns) or df)
    monkeypatch.setattr(graphs, "reachable", lambda edges, start, *a, whole=graphs.reachable: starts.append(start.count()) or whole(edges, start, *a))
    g = graph(spark, EDITIONS[:1] + [[("Article 1", ["Apply Article 2."]), ("Article 2", [FIXED])]])
    assert not kept and starts == [2]
    assert sorted((r["edition"], r["root"], r["region"]) for r in g.within.collect()) == [(0, 0, 0), (0, 0, 1), (0, 0, 2), (0, 3, 3), (1, 0, 0), (1, 0, 1), (1, 1, 1)]
    lines = {(r["edition"], r["region"], r["ordinal"]): (r["anchor"], r["supported"]) for r in g.nodes.collect()}
    assert lines[1, 0, 0] == (True, False) and lines[0, 0, 0] == (True, True) and lines[0, 0, 1] == (False, True) and len(lines) == 7
