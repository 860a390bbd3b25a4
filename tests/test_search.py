"""Ranks against covers found by trying every stretch, and grounding of candidates."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdict.operators import grounding, search
from verdict.plans import reading_queries

WORDS = "a b c d e".split()


def density(words, terms):
    """Every stretch with all terms and no shorter one inside."""
    spans = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if set(terms) <= set(words[i : j + 1])]
    covers = [(i, j) for i, j in spans if not any((p, q) != (i, j) and i <= p and q <= j for p, q in spans)]
    return sum(0.1 / (1 + sum(w not in terms for w in words[i : j + 1])) for i, j in covers)


def test_ranks_are_cover_densities(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 25))) for _ in range(80)]
    df = spark.createDataFrame([(i, "" if i % 3 else "Zz yy", t, i % 4) for i, t in enumerate(texts)] + [(99, None, None, 1)], "id int, title string, text string, page int")
    queries = ["a", "a b", "B, c a", "d d e", "a b c d e", "zz yy", "nothing"]
    got = {}
    for r in search.ranked(df, queries, id_column="id", title="title", text="text", page="page", limit=50).orderBy("query", "position").collect():
        got.setdefault(r["query"], []).append((r["id"], r["relevance"]))
    for q in queries:
        terms = list(dict.fromkeys(q.lower().replace(",", "").split()))
        rows = [(i, ("zz yy " if i % 3 == 0 else "") + t) for i, t in enumerate(texts)]
        hits = [(i, density(t.split(), terms), 1.0 if q == "zz yy" and i % 3 == 0 else 0.0) for i, t in rows if set(terms) <= set(t.split())]
        want = sorted(hits, key=lambda h: (-float(np.float32(h[1])), -h[2], h[0] % 4, h[0]))[:50]
        assert [i for i, _ in got.get(q, [])] == [i for i, *_ in want], q
        assert [r for _, r in got.get(q, [])] == pytest.approx([r for _, r, _ in want], rel=1e-6)


def test_similar_titles_are_found_without_their_tokens(spark):
    df = spark.createDataFrame([(1, "outpatient definition", "x"), (2, "outpatients definitions", "y"), (3, "else", "outpatient z definition")], "id int, title string, text string")
    got = [(r["id"], round(r["relevance"], 4)) for r in search.search(df, "Outpatient definition", id_column="id", title="title", text="text").orderBy("position").collect()]
    assert got == [(1, 0.1), (3, 0.05), (2, 0.0)]


@pytest.mark.parametrize(("query", "limit"), [("", 10), ("   ", 10), ("x" * 161, 10), ("x", 0), ("x", 51)])
def test_queries_out_of_bounds(spark, query, limit):
    with pytest.raises(ValueError, match="INVALID_QUERY"):
        search.search(spark.range(1).select("id", F.lit("x").alias("t")), query, id_column="id", title="t", text="t", limit=limit)


ROW = "Sample Rider | 정액 | 가입금액 20만원 | 보장개시일 2025.01.02"
GROUNDED = [
    # text, fields, status, issue
    (ROW, {"rider_name": "Sample Rider", "rider_key": "sample-rider", "benefit_type": "fixed", "sum_assured": "200000", "currency": "KRW", "coverage_start": "2025-01-02"}, "AI_VERIFIED", None),
    (ROW, {"rider_name": "Invented Rider"}, "NEEDS_REVIEW", "INVENTED_FIELD"),
    (ROW, {"rider_name": "Sample Rider", "benefit_type": "fixed", "sum_assured": "20"}, "NEEDS_REVIEW", "INVENTED_FIELD"),
    (ROW, {"rider_name": "Sample Rider", "benefit_type": "fixed", "rider_key": "other"}, "NEEDS_REVIEW", "INVENTED_FIELD"),
    (ROW, {"rider_name": "Sample Rider", "benefit_type": "fixed", "rider_status": "active"}, "NEEDS_REVIEW", "INVENTED_FIELD"),
    (ROW, {"rider_name": "Sample Rider", "benefit_type": "fixed", "rider_status": "unknown"}, "AI_VERIFIED", None),
    ("Sample Rider 가입금액 20원 보험료 200원 지급한도 300원", {"rider_name": "Sample Rider", "sum_assured": "20"}, "AI_VERIFIED", None),
    ("Sample Rider 가입금액 20원 보험료 200원", {"rider_name": "Sample Rider", "sum_assured": "200"}, "NEEDS_REVIEW", "INVENTED_FIELD"),
    ("Sample Rider, monthly premium 5,000 KRW", {"rider_name": "Sample Rider", "benefit_type": "fixed", "sum_assured": "5000"}, "NEEDS_REVIEW", "INVENTED_FIELD"),
    ("Rider name: Sample Rider; sum assured: 5,000 KRW, premium 10 KRW", {"rider_name": "Sample Rider", "sum_assured": "5000", "currency": "KRW"}, "AI_VERIFIED", None),
    ("Sample Rider fixed 가입금액 317원\nAnother Rider fixed 가입금액 619원", {"rider_name": "Sample Rider", "sum_assured": "619"}, "NEEDS_REVIEW", "INVENTED_FIELD"),
    ("Sample Rider fixed 가입금액 317원\nAnother Rider fixed 가입금액 619원", {"rider_name": "Another Rider", "sum_assured": "619"}, "AI_VERIFIED", None),
    ("Sample Rider | 미가입 | 정액 | 가입금액 20원", {"rider_name": "Sample Rider", "benefit_type": "fixed"}, "NEEDS_REVIEW", "NOT_ENROLLED"),
    ("Sample Rider 정액 가입금액 20원\n미가입", {"rider_name": "Sample Rider", "benefit_type": "fixed"}, "NEEDS_REVIEW", "NOT_ENROLLED"),
    ("Sample Rider 정액 가입금액 20원\nAnother Rider | 미가입 | 정액 가입금액 30원", {"rider_name": "Sample Rider", "benefit_type": "fixed", "sum_assured": "20"}, "AI_VERIFIED", None),
    ("Sample Rider 비갱신 가입금액 20원", {"rider_name": "Sample Rider", "renewable": "false"}, "AI_VERIFIED", None),
    ("Sample Rider 비갱신 가입금액 20원", {"rider_name": "Sample Rider", "renewable": "true"}, "NEEDS_REVIEW", "INVENTED_FIELD"),
    ("보험증권 가입금액\nSample Insurer Sample Plan", {"rider_name": "보험증권", "benefit_type": "unknown"}, "NEEDS_REVIEW", "INVENTED_FIELD"),
]
FIELD = "candidate int, kind string, status string, position int, field string, value string, text string, primary boolean, n_evidence int, missing boolean"


def judged(spark, cases, kind="rider", status="AI_VERIFIED", **how):
    rows = [(n, kind, status, i, f, v, text, True, 1, False) for n, (text, fields, *_) in enumerate(cases) for i, (f, v) in enumerate(fields.items())]
    states, kept = grounding.ground(spark.createDataFrame(rows, FIELD), **how)
    return {r["candidate"]: (r["status"], r["issue"]) for r in states.collect()}, kept


def test_candidates_are_grounded(spark):
    states, kept = judged(spark, GROUNDED)
    for n, (text, fields, status, issue) in enumerate(GROUNDED):
        assert states[n] == (status, issue), (text, fields)
    added = {r["candidate"]: r["value"] for r in kept.where("field = 'benefit_type'").collect()}
    assert added[6] == "unknown" and added[0] == "fixed" and len(added) == len(GROUNDED)
    assert judged(spark, GROUNDED[12:13], status="NEEDS_REVIEW")[0][0] == ("NEEDS_REVIEW", "NOT_ENROLLED")
    assert judged(spark, GROUNDED[1:2], status="REJECTED")[0][0] == ("REJECTED", None)


def test_contracts(spark):
    plan = [("Sample Plan", {"product_name": "Sample Plan"}), ("Sample Plan_보험증권", {"product_name": "Sample Plan"}), ("Other", {"product_name": "Sample Plan"})]
    assert [judged(spark, plan, "policy_contract", certificate_titles=t)[0][n][0] for t in (True, False) for n in range(3)] == ["AI_VERIFIED", "AI_VERIFIED", "NEEDS_REVIEW", "AI_VERIFIED", "NEEDS_REVIEW", "NEEDS_REVIEW"]
    insurer = [("보험사: Sample Co | x", {"insurer": "Sample Co"}), ("paid by Sample Co", {"insurer": "Sample Co"})]
    assert [judged(spark, insurer, "policy_contract", issuer_labels=t)[0][n][0] for t in (True, False) for n in range(2)] == ["AI_VERIFIED", "NEEDS_REVIEW", "AI_VERIFIED", "AI_VERIFIED"]
    cited = [(0, "policy_contract", "AI_VERIFIED", 0, "currency", "KRW", "sum assured 5 KRW", p, n, m) for p, n, m in ((True, 1, False),)]
    for primary, n, missing in ((False, 1, False), (True, 0, False), (True, 17, False), (True, 1, True)):
        cited.append((len(cited), *cited[0][1:7], primary, n, missing))
    states = {r["candidate"]: r["status"] for r in grounding.ground(spark.createDataFrame(cited, FIELD))[0].collect()}
    assert states == {0: "AI_VERIFIED", 1: "NEEDS_REVIEW", 2: "NEEDS_REVIEW", 3: "NEEDS_REVIEW", 4: "NEEDS_REVIEW"}


def test_a_text_is_judged_once_for_all_its_fields(spark, small):
    plan = reading_queries.candidate_grounding(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("ArrowEvalPython [") == 1
