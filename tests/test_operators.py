import json
import random
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdict.functions import money, text
from verdict.functions.tristate import collapse, fold, label
from verdict.operators import audits, decisions, documents, evidence, graphs, payments, search, temporal
from verdict.operators.components import components, reachable
from verdict.plans import text_queries
from verdict.sources.tables import manifest, package_problems, read_package
from verdict.streaming import queues


def test_folds(spark):
    df = spark.createDataFrame([("a", True, True), ("a", None, True), ("b", None, True), ("b", False, True), ("c", False, False), ("d", True, True)], "k string, r boolean, req boolean")
    for none, empty in ((True, "MATCH"), (None, "UNKNOWN")):
        got = dict(df.groupBy("k").agg(label(fold(F.col("r"), F.col("req"), none))).collect())
        assert got == {"a": "UNKNOWN", "b": "NO_MATCH", "c": empty, "d": "MATCH"}
    assert df.where("false").agg(label(collapse(F.col("r"), F.col("r")))).first()[0] == "UNKNOWN"


def test_phrases_and_wire(spark):
    df = spark.createDataFrame([("1,234",), ("3만원",), ("12,34",), ("1~2",), ("5만 3",), ("9" * 13,), (None,)], "t string")
    assert [r[0] for r in df.select(money.phrase_amount(F.col("t"))).collect()] == [1234, 30000, None, None, None, None, None]
    df = spark.createDataFrame([("1.5",), ("-1",), ("1e3",), ("1.1234567",), ("999999999999.999999",), ("1000000000000",)], "t string")
    assert [r[0] for r in df.select(money.wire_decimal(F.col("t"))).collect()] == [Decimal("1.5"), None, None, None, Decimal("999999999999.999999"), None]


def test_rounding(spark):
    df = spark.createDataFrame([(Decimal(x),) for x in ("2.5", "-2.5", "2.1", "-2.1")], "x decimal(18,6)")
    got = {m: [float(r[0]) for r in df.select(money.rounded(F.col("x"), m)).collect()] for m in ("half_up", "half_even", "up", "down")}
    assert got == {"half_up": [3, -3, 2, -2], "half_even": [2, -2, 2, -2], "up": [3, -3, 3, -3], "down": [2, -2, 2, -2]}
    assert [float(r[0]) for r in df.select(money.rounded(F.col("x"), "up", 0, "ceiling")).collect()] == [3, -2, 3, -2]


def test_quality_and_redaction(spark):
    cases = {"a good page of text with words": "TEXT_SUFFICIENT", "short": "OCR_REQUIRED", "x" * 21 + " and other words here": "OCR_REQUIRED", "x" * 20 + " and other words here": "TEXT_SUFFICIENT", "." * 60 + "abcdefghij": "OCR_REQUIRED", "": "OCR_REQUIRED"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(text.quality(F.col("t"))).collect()] == list(cases.values())
    raw = "mail a.b@c.org, call 010-1234-5678, id 900101-1234567; contract no: AB-12345; address: 1 Road; secret Word " + "z" * 400
    got = spark.createDataFrame([(raw,)], "t string").select(text.redacted(F.col("t"), ("word",))).first()[0]
    assert len(got) == 240
    for hidden in ("a.b@c.org", "1234-5678", "900101", "AB-12345", "1 Road", "Word"):
        assert hidden not in got


def test_payments(spark):
    lines = spark.createDataFrame([(1, Decimal(200000), "EUR", "covered", "user"), (1, Decimal(5), "EUR", "covered", "unconfirmed"), (2, Decimal(1), "EUR", "covered", "user"), (2, Decimal(1), "USD", "covered", "user")], "k int, amount decimal(18,2), currency string, category string, confirmation string")
    out = {r["k"]: r for r in payments.indemnity(payments.receipt_split(lines, ["k"]), Decimal(10000), Decimal("0.8"), Decimal(100000)).collect()}
    assert (out[1]["amount"], out[1]["status"], out[2]["status"], out[2]["amount"]) == (Decimal(100000), "partial", "unknown", None)


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5), (20, 19), (19, 18), (18, 17), (17, 16)], "a long, b long")
    assert dict(components(edges).collect()) == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 16, 19: 16, 18: 16, 17: 16, 16: 16}
    cycle = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "a long, b long")
    assert sorted(r["node"] for r in reachable(cycle, spark.createDataFrame([(1,)], "root long")).collect()) == [1, 2, 3]
    assert components(edges.where("false")).count() == 0


def test_audits(spark):
    cases = spark.createDataFrame([(["a"], ["b"], ["a", "x"], [], True, False), ([], [], ["y"], [], False, True)], "expected_primary array<string>, expected_conditional array<string>, primary array<string>, conditional array<string>, answerable boolean, held boolean")
    assert tuple(audits.benchmark_score(cases).first()) == (0.5, 1 / 3, None, 1.0, 0.0)
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "z")], "k int, v string")
    assert dict(audits.differences(a, b, "k", ["v"]).collect()) == {1: "SAME", 2: "SAME", 3: "REMOVED", 4: "ADDED"}
    history = spark.createDataFrame([(1, 1, "preparing"), (1, 2, "submitted"), (1, 3, "closed")], "k int, at int, s string")
    assert [tuple(r) for r in audits.invalid_transitions(history, "k", ["at"], "s", audits.TRANSITIONS).collect()] == [(1, "submitted", "closed", 1)]


def test_structure(spark):
    nodes = spark.createDataFrame([(1, 0, "TEXT", "x" * 25, 0), (1, 1, "ROW", "y" * 12, 0), (1, 2, "TEXT", "z" * 5, 99), (1, 3, "TEXT", "w" * 25, 0)], "doc int, node int, kind string, text string, context_chars int")
    got = [tuple(r) for r in documents.chunk_plan(nodes, max_content=10, max_context=50, max_chunks=4).orderBy("node", "start").collect()]
    assert got == [(1, 0, 0, 10, None), (1, 0, 10, 20, None), (1, 0, 20, 25, None), (1, 1, 0, 12, "ROW_EXCEEDS_CONTENT_BUDGET"), (1, 2, 0, 5, "CONTEXT_EXCEEDS_BUDGET"), (1, 3, 0, 10, None), (1, 3, 10, 25, "CHUNK_BUDGET_EXHAUSTED")]
    slices = spark.createDataFrame([(1, 0, 50, "a", 10), (1, 1, 30, "a", 10), (1, 2, 30, "b", 10), (1, 3, 200, "a", 10)], "doc long, slice int, chars int, context string, context_chars int")
    packed = {r["slice"]: (r["envelope"], r["reason"]) for r in documents.pack(slices, max_chars=100).collect()}
    assert packed == {0: (0, None), 1: (0, None), 2: (1, None), 3: (None, "SLICE_EXCEEDS_ENVELOPE")}


def test_package(spark, tmp_path):
    (tmp_path / "items.jsonl").write_text(json.dumps({"id": 1, "name": "a"}) + "\n\nnot json\n" + json.dumps({"id": 2, "name": "b" * 200}) + "\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    tables, problems = read_package(spark, str(tmp_path), {"items": schema}, max_bytes=100)
    assert [tuple(r) for r in tables["items"].collect()] == [(1, "a")]
    assert {tuple(r) for r in problems.collect()} == {("items", "MALFORMED", 1), ("items", "TOO_LONG", 1)}
    assert manifest(spark, str(tmp_path), ["items"]).first()["file"] == "items.jsonl"
    links = spark.createDataFrame([(1,), (2,), (None,)], "item long")
    found = package_problems({"items": tables["items"], "links": links}, [("links", "item", "items", "id")], {"items": 1, "links": 2})
    assert {tuple(r) for r in found.collect()} == {("links", "DANGLING", 1), ("links", "COUNT_MISMATCH", 3)}


def test_lease_steps():
    at, span = pd.Timestamp("2024-01-01"), pd.Timedelta("5 minutes")
    state = queues.lease_step(("queued", 0, None), "claim", at, span, 2)
    assert state[:2] == ("leased", 1)
    assert queues.lease_step(state, "claim", at + pd.Timedelta("1 minute"), span, 2) == state
    again = queues.lease_step(state, "claim", at + pd.Timedelta("6 minutes"), span, 2)
    assert again[:2] == ("leased", 2)
    assert queues.lease_step(again, "done", at + pd.Timedelta("20 minutes"), span, 2)[0] == "dead"


def test_streams(spark, tmp_path, small):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{small}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    jobs = stream.select(F.col("user_id").cast("string").alias("job"), F.when(F.col("event_type") == "purchase", "done").otherwise("claim").alias("kind"), F.col("ts").alias("at"))
    query = queues.leases(jobs).writeStream.outputMode("update").format("memory").queryName("lease_test").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    users = spark.read.parquet(f"{small}/events.parquet").select("user_id").distinct().count()
    assert spark.sql("select count(distinct job) from lease_test").first()[0] == users
    claims = spark.createDataFrame([("a", "claim", "2024-01-01 00:00:00"), ("b", "claim", "2024-01-01 00:00:00"), ("b", "done", "2024-01-01 00:01:00")], "job string, kind string, at string")
    for i, rows in enumerate((claims, spark.createDataFrame([("c", "claim", "2024-01-01 09:00:00")], claims.schema), spark.createDataFrame([("d", "claim", "2024-01-01 09:01:00")], claims.schema))):
        rows.withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "claims"))
        if not i:
            told = spark.readStream.schema("job string, kind string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "claims"))
            query = queues.leases(told, lateness="1 minute").writeStream.outputMode("update").format("memory").queryName("expiry_test").option("checkpointLocation", str(tmp_path / "c3")).start()
        query.processAllAvailable()
    query.stop()
    seen = [tuple(r) for r in spark.sql("select job, status, attempts from expiry_test where job in ('a', 'b')").collect()]
    assert seen == [("a", "leased", 1), ("b", "done", 1), ("a", "queued", 1)] or sorted(seen) == [("a", "leased", 1), ("a", "queued", 1), ("b", "done", 1)]
    quota = queues.daily_quota(stream, "ts", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("quota_test").option("checkpointLocation", str(tmp_path / "c2")).start()
    quota.processAllAvailable()
    quota.stop()
    assert spark.sql("select sum(n) from quota_test").first()[0] == spark.read.parquet(f"{small}/events.parquet").count()


def test_text_lines_reads_whole_pages(spark, tmp_path):
    pages = {1: " ".join("w" * (i * 7 % 17 + 1) for i in range(450)), 2: "one two", 3: ""}
    spark.createDataFrame([(i, "u", t) for i, t in pages.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = set()
    for page, t in pages.items():
        lines, first, last = 0, None, None
        for i, w in enumerate(t.split(" ")):
            left, top = i % 7 * 50.0, i // 7 * 12 + i % 2
            shared = 10 - abs(first - top) if first is not None else 0
            if shared < 8 or left - last > 15:
                lines, first = lines + 1, top
            last = left + min(len(w), 12) * 4
        want.add((page, lines, len(t.split(" "))))
    assert {tuple(r) for r in text_queries.text_lines(spark, str(tmp_path)).select("page", "n_lines", "n_words").collect()} == want


def test_overlap_counts_common_tokens(spark):
    common = [f"c{c}" for c in "abcdefgh"]
    passages = {i: " ".join([*(w for j, w in enumerate(common) if (i >> j % 5) & 1), f"rare{i % 20}"]) for i in range(40)}
    asked = {1: " ".join(common), 2: " ".join([*common, "rare3"]), 3: "rare4 rare5", 4: "ca", 5: "nowhere", 6: "rare6 ca"}
    docs = spark.createDataFrame(list(passages.items()), "doc long, body string")
    queries = spark.createDataFrame(list(asked.items()), "item long, body string")
    want = set()
    for q, t in asked.items():
        scores = sorted((-len(set(t.split()) & set(x.split())), d) for d, x in passages.items())
        want |= {(q, i + 1, d, -n) for i, (n, d) in enumerate(scores[:2]) if n}
    assert {tuple(r) for r in search.overlap_top(queries, docs, "item", "doc", "body").collect()} == want


def test_redaction_of_neighbours_and_labels(spark):
    cases = {
        "900101-1234567 900102-2345678": "[REDACTED] [REDACTED]",
        "01012345678 010-2345-6789": "[REDACTED] [REDACTED]",
        "1900101-1234567": "1900101-1234567",
        "policy no AB-12345 x": "policy no: [REDACTED] x",
        "증권번호: KR-99881 끝": "증권번호: [REDACTED] 끝",
        "성명: 홍길동 주소: 서울 1; 기타": "성명: [REDACTED] 주소: [REDACTED]; 기타",
        "full name Jane Roe insurer Acme": "full name: [REDACTED] insurer Acme",
        "insured amount 500": "insured amount 500",
        "to a.b@c.org,d@e.net": "to [REDACTED],[REDACTED]",
        "nothing here": "nothing here",
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(text.redacted(F.col("t"))).collect()]
    assert got == list(cases.values())


def test_lineage_and_reached(spark):
    nodes = spark.range(1, 3001).select(F.col("id").alias("n"), F.when(F.col("id") > 1, F.floor((F.col("id") + 1) / 3)).alias("p"))
    plain = {}
    for i in range(1, 3001):
        at, d = i, 0
        while True:
            plain[i, at] = d
            if at == 1 or (i, (at + 1) // 3) in plain or (at + 1) // 3 == 0:
                break
            at, d = (at + 1) // 3, d + 1
    got = {(r["node"], r["ancestor"]): r["distance"] for r in graphs.lineage(nodes, "n", "p").collect()}
    assert got == plain
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, None), (6, 99)], "n long, p long")
    assert sorted(tuple(r) for r in graphs.lineage(loop, "n", "p").where("node in (1, 4, 5, 6)").collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (4, 4, 0), (5, 5, 0), (6, 6, 0)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 2), (5, 6)], "a long, b long")
    roots = spark.createDataFrame([(1,), (3,), (4,), (5,)], "root long")
    assert sorted(r[0] for r in graphs.affected(edges, spark.createDataFrame([(3,)], "node long"), roots).collect()) == [1, 3, 4]


def test_as_of_and_overlay_with_nulls_and_repeats(spark):
    probes = spark.createDataFrame([(1, "2024-01-03"), (1, "2024-01-03"), (None, "2024-01-03"), (2, None), (3, "2024-01-01")], "k long, day string").withColumn("day", F.col("day").cast("date"))
    history = spark.createDataFrame([(1, "2024-01-01 10:00:00", "a"), (1, "2024-01-03 23:00:00", "b"), (None, "2024-01-02 00:00:00", "n"), (3, "2024-01-01 05:00:00", "x"), (3, "2024-01-01 05:00:00", "y")], "k long, at string, s string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    out = temporal.status_as_of(probes, history, ["k"], "day", "at", "s", F.lit("now"))
    assert sorted((str(r["k"]), r["as_of"]) for r in out.collect()) == sorted([("1", "b"), ("1", "b"), ("None", "n"), ("2", "now"), ("3", "conflicting")])
    events = spark.createDataFrame([("x", "u", "2024-01-05"), ("x", "v", "2024-01-05"), ("y", "u", "2024-03-05"), (None, "u", "2024-01-05"), ("x", "u", None)], "a string, b string, day string").withColumn("day", F.col("day").cast("date"))
    changes = spark.createDataFrame([(None, None, None, "2024-01-31", "wide"), ("x", None, "2024-01-01", None, "ax"), (None, "u", None, None, "bu"), ("x", "u", "2024-01-01", "2024-01-31", "both")], "a string, b string, start string, stop string, choice string")
    changes = changes.withColumn("start", F.col("start").cast("date")).withColumn("stop", F.col("stop").cast("date"))
    got = {(r["a"], r["b"], str(r["day"])): (r["choice"], r["specificity"], r["state"]) for r in temporal.overlay(events, changes, ["a", "b"], "day", "start", "stop", "choice").collect()}
    assert got == {("x", "u", "2024-01-05"): ("both", 2, "APPLIED"), ("x", "v", "2024-01-05"): ("ax", 1, "APPLIED"), ("y", "u", "2024-03-05"): ("bu", 1, "APPLIED"), (None, "u", "2024-01-05"): ("bu", 1, "APPLIED"), ("x", "u", "None"): (None, None, "NONE")}
    ties = spark.createDataFrame([("x", None, "one"), (None, "u", "two")], "a string, b string, choice string").withColumn("start", F.lit(None).cast("date")).withColumn("stop", F.lit(None).cast("date"))
    state = temporal.overlay(events.limit(1), ties, ["a", "b"], "day", "start", "stop", "choice").first()
    assert (state["state"], state["choice"]) == ("COMPETING", None)


def test_line_groups_by_centre(spark):
    rng = random.Random(4)
    rows = [(p, i, float(rng.randrange(100)), top, top + rng.choice([4.0, 8.0])) for p in range(6) for i in range(25) for top in [float(rng.randrange(60))]]
    df = spark.createDataFrame([(p, i, left, left + 5, top, bottom) for p, i, left, top, bottom in rows], "page long, block long, left double, right double, top double, bottom double")
    want = {}
    for page in range(6):
        lines = []
        for _, i, left, top, bottom in sorted((r for r in rows if r[0] == page), key=lambda r: (r[3], r[2], r[1])):
            near = [x for x in lines if abs((min(b[1] for b in x) + max(b[2] for b in x)) / 2 - (top + bottom) / 2) <= 3]
            (near[0] if len(near) == 1 else lines.append([]) or lines[-1]).append((i, top, bottom))
        want |= {(page, i): n for n, x in enumerate(lines) for i, *_ in x}
    assert {(r["page"], r["block"]): r["line"] for r in documents.line_groups(df).collect()} == want


def test_decide_with_a_precondition(spark):
    results = {"m": [True, True], "n": [True, False], "u": [True, None]}
    rows = [(f"{k}{p}", r, p) for k, rs in results.items() for p in (True, False, None) for r in rs]
    df = spark.createDataFrame(rows, "k string, r boolean, p boolean")
    out = decisions.decide(df, ["k"], F.col("r"), F.lit(True), None, F.col("p"))
    got = {r["k"]: (r["verdict"], r["n_match"], r["n_no_match"], r["n_unknown"]) for r in out.collect()}
    # A precondition that fails wins; one that is not known only demotes a match.
    verdicts = {"mTrue": "MATCH", "mFalse": "NO_MATCH", "mNone": "UNKNOWN", "nTrue": "NO_MATCH", "nFalse": "NO_MATCH", "nNone": "NO_MATCH", "uTrue": "UNKNOWN", "uFalse": "NO_MATCH", "uNone": "UNKNOWN"}
    counts = {"m": (2, 0, 0), "n": (1, 1, 0), "u": (1, 0, 1)}
    assert got == {k: (v, *counts[k[0]]) for k, v in verdicts.items()}


def test_folded_tokens(spark, tmp_path):
    spark.createDataFrame([(1, "Straße STRASSE ﬁne Fine", "x", "y"), (2, None, "x", "y"), (3, "A ÉCOLE école", "x", "y")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert dict(text_queries.folded_tokens(spark, str(tmp_path)).collect()) == {1: 2, 2: 0, 3: 1}


def test_new_rows_and_recompiled_rules(spark):
    from verdict.plans.rules import Field, RuleError, recompiled
    from verdict.sources.tables import new_rows

    schema = "a int, b int, c string"
    incoming = spark.createDataFrame([(1, 1, "y"), (1, 1, "x"), (2, 1, "z"), (None, 1, "n"), (None, 1, "n")], schema)
    existing = spark.createDataFrame([(2, 1, "old"), (None, 1, "n")], schema)
    assert sorted(map(str, (tuple(r) for r in new_rows(incoming, existing, ["a", "b"]).collect()))) == sorted(map(str, [(1, 1, "x"), (None, 1, "n"), (None, 1, "n")]))
    document = {"schema_version": "1", "rule_kind": "eligibility", "required": True, "input_field_paths": ["A.kind"], "expression": {"op": "present", "field": "A.kind"}, "result_reason_code": "CHECKED", "evidence_ids": ["e1"]}
    stored = {"name": "r", "kind": "eligibility", "required": True, "reason": "CHECKED", "fields": ["A.kind"]}
    assert recompiled(document, stored, {"A.kind": Field("string")}).name == "r"
    try:
        recompiled(document, stored | {"required": False}, {"A.kind": Field("string")})
        raise AssertionError
    except RuleError as e:
        assert e.code == "RULE_METADATA_MISMATCH"


def test_phrases_with_endings(spark):
    entries = [("위암", "Event.kind", "x", 2), ("갑상선 암", "Event.kind", "y", 2), ("암", "Event.kind", "z", 1), ("clinic", "Event.place", "c", 1)]
    cases = {"위암을 진단": {"Event.kind": ("x", "RESOLVED")}, "갑상선의 암으로부터": {"Event.kind": ("y", "RESOLVED")}, "위암 갑상선 암": {"Event.kind": (None, "CONFLICTING")}, "위암종 clinics": {}, "a clinic, 암": {"Event.kind": ("z", "RESOLVED"), "Event.place": ("c", "RESOLVED")}}
    df = spark.createDataFrame(list(enumerate(cases)), "id int, t string").select("id", text.folded("t").alias("folded"))
    got = {t: {} for t in cases}
    for r in decisions.phrase_facts(df, "id", "folded", entries).collect():
        got[list(cases)[r["id"]]][r["path"]] = (r["value"], r["state"])
    assert got == cases


def test_closure_follows_ways_longer_than_any_depth(spark):
    edges = spark.range(1, 36).selectExpr("id AS a", "id + 1 AS b")
    got = graphs.closure(edges, spark.range(1, 36).withColumnRenamed("id", "node"), spark.createDataFrame([(1,)], "root long"))
    assert [tuple(r) for r in got.collect()] == [(1, 35, 1, "MISSING")]


def test_equal_places_are_compared_once(spark):
    tables = spark.range(3000).selectExpr("0 AS page", "id AS table_id", "0.0D AS left", "10.0D AS right", "IF(id % 3 = 2, 100.0D, 20.0D * (id % 3)) AS top")
    notes = spark.range(3000).selectExpr("0 AS page", "0.0D AS left", "10.0D AS right", "0.0D AS bottom", "IF(id = 7, 'b', 'a') AS unit")
    out = evidence.captions(tables, notes)
    assert {(r["table_id"] % 3, r["state"], r["unit"]) for r in out.collect()} == {(0, "AMBIGUOUS", None), (1, "AMBIGUOUS", None), (2, "NONE", None)}
    assert {(r["table_id"] % 3, r["state"], r["unit"]) for r in evidence.captions(tables, notes.where("unit = 'a'")).collect()} == {(0, "UNIQUE", "a"), (1, "UNIQUE", "a"), (2, "NONE", None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 4
