"""Queries of reading: situations, witnesses, grounding, footnotes, lines, editions, JSON, inserts, negative controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.operators import audits, decisions, documents, grounding, search, situations
from verdict.plans.decision_queries import IN_AMOUNT, IN_DAYS, IS_FP
from verdict.plans.rules import compile_witnesses
from verdict.plans.stand_ins import FACTS_SQL, FIELDS, order_facts
from verdict.sources.tables import new_rows, table


#: What is said of an order, in its days {d}, price {p} and date {t}. An order's text is two of them.
SAID = (
    "admitted for {d} days", "had surgery", "did not have surgery", "surgery is planned", "my mother was admitted", "surgery cancelled", "received outpatient care",
    "paid medical cost {p} EUR", "estimated hospital bill {p} USD", "had surgery on {t}", "surgery consultation completed", "was diagnosed", "수술을 받았습니다", "{d}일간 입원했습니다",
    "작년에 수술했습니다", "수술하지 않았습니다", "visit date {t}", "paid medical cost about {p} EUR", "maybe admitted", "nothing more today", "admitted for 3 to 5 days", "never diagnosed", "수술 상담을 받았습니다",
)


def _said_sql(cast: str) -> str:
    """The texts of orders, and the day that each is read for, in either SQL."""
    fill = lambda s: "concat(" + ", ".join(repr(x) if x not in "dpt" else {"d": "d", "p": "p", "t": "t"}[x] for x in s.replace("{", "\0").replace("}", "\0").split("\0") if x) + ")"
    of = lambda n: "CASE " + " ".join(f"WHEN {n} % {len(SAID)} = {i} THEN {fill(s)}" for i, s in enumerate(SAID)) + " END"
    return f"""
SELECT o_orderkey, concat({of("o_orderkey")}, CASE WHEN o_custkey % 2 = 0 THEN '; ' ELSE ' but ' END, {of("k2")}) AS text, day FROM (
  SELECT o_orderkey, o_custkey, CAST(floor(o_orderkey / {len(SAID)}) AS BIGINT) + o_custkey AS k2, CAST(o_custkey % 30 AS {cast}) AS d, CAST(CAST(o_totalprice AS DECIMAL(16,2)) AS {cast}) AS p,
    CAST(CAST(o_orderdate AS DATE) AS {cast}) AS t, CASE WHEN o_custkey % 3 = 0 THEN date_trunc('month', o_orderdate)::DATE WHEN o_custkey % 3 = 1 THEN o_orderdate::DATE END AS day
  FROM orders) x"""


def situation_reading(spark: SparkSession, folder: str) -> DataFrame:
    """What told orders say, read for the order's day, for another day, or for none."""
    told = spark.sql(_said_sql("STRING").replace("FROM orders", "FROM {orders}"), orders=table(spark, folder, "orders"))
    found = situations.merged(situations.facts(situations.clauses(told, "o_orderkey", "text", event_date="day"), "o_orderkey"), "o_orderkey")
    return found.select("o_orderkey", "path", F.coalesce("value", F.lit("")).alias("value"), "state", F.coalesce("currency", F.lit("")).alias("currency"), F.array_join("reasons", ",").alias("reasons"))


def situation_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What whole documents say of clauses: how many are negated, planned, uncertain. Rows that repeat an id and text are read once."""
    own = table(spark, folder, "documents").select("doc_id", "text").where("text is not null").distinct()
    own = own.withColumn("_key", F.struct("doc_id", F.xxhash64("text").alias("text")))
    said = situations.guard(F.col("body"), F.col("reasons"), F.lit(0), F.length("body"))
    read = situations.clauses(own, "_key", "text").select(F.col("_key.doc_id").alias("doc_id"), said.alias("g"))
    return read.select("doc_id", "g.state", F.array_join("g.reasons", ",").alias("reason")).groupBy("doc_id", "state", "reason").agg(F.count(F.lit(1)).alias("n"))


PHRASES = [("of the", "Event.kind", "A", 2), ("in the", "Event.kind", "B", 2), ("the", "Event.kind", "C", 1), ("and", "Event.place", "D", 1), ("the and", "Event.place", "E", 1)]


def phrase_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What a small dictionary says of documents; texts are lower-cased, which is all that SQL can fold."""
    lower = table(spark, folder, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("folded"))
    out = decisions.phrase_facts(lower, "doc_id", "folded", PHRASES)
    return out.select("doc_id", "path", F.coalesce("value", F.lit("")).alias("value"), "state")


RELEVANCE = {"op": "all", "args": [{"op": "any", "args": [IS_FP, IN_AMOUNT]}, {"op": "any", "args": [IN_DAYS, {"op": "present", "field": "Event.day"}, {"op": "not", "args": [IN_AMOUNT]}]}]}


def relevance_witness(spark: SparkSession, folder: str) -> DataFrame:
    """Why each order bears on a rule: facts that hold, or its topic where the fact is not known."""
    topic = F.when(F.col("o_custkey") % 3 == 0, "F").when(F.col("o_custkey") % 3 == 1, "X")
    found = compile_witnesses(RELEVANCE, FIELDS, {"Event.kind": "topic"})
    rows = order_facts(spark, folder).withColumn("topic", topic).select("o_orderkey", found.alias("w"))
    return rows.select("o_orderkey", F.array_join(F.transform("w", lambda x: F.concat_ws(":", x["field"], x["kind"])), ",").alias("witnesses"))


#: Orders as certificates of a rider, some with another rider's row, and the candidates read from them, of which some are wrong.
_CERTIFICATES = """
SELECT k, concat('Enrolled rider: Plan ', c, ' | sum assured: ', {price}, CASE k % 3 WHEN 0 THEN ' KRW' WHEN 1 THEN ' EUR' ELSE '만원' END, ' | coverage start ', t,
    CASE k % 4 WHEN 0 THEN ' | fixed' WHEN 1 THEN ' | indemnity' WHEN 2 THEN ' | unfixed' ELSE ' | fixed, indemnity' END,
    CASE WHEN k % 11 = 0 THEN ' | sum assured 5 EUR' WHEN k % 7 = 0 THEN ' | premium 10 EUR' ELSE '' END, CASE WHEN k % 17 = 0 THEN ' | not enrolled' ELSE '' END,
    CASE WHEN k % 2 = 0 THEN concat('\n', 'Plan ', c, '0 | indemnity | sum assured 7 KRW | not enrolled') ELSE '' END, CASE WHEN k % 23 = 0 THEN concat('\n', 'Plan ', c, ' again') ELSE '' END) AS text,
  concat('plan ', c, CASE WHEN k % 6 = 0 THEN '9' ELSE '' END) AS name, n * CASE WHEN k % 3 = 2 THEN 10000 ELSE 1 END + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS amount,
  CASE WHEN k % 19 = 0 THEN 'USD' WHEN k % 3 = 1 THEN 'EUR' ELSE 'KRW' END AS currency, CASE k % 8 WHEN 0 THEN 'fixed' WHEN 1 THEN 'indemnity' WHEN 2 THEN 'fixed' WHEN 3 THEN 'fixed' WHEN 4 THEN 'unknown' END AS benefit,
  {day} AS day, CASE WHEN k % 13 = 0 THEN 'REJECTED' ELSE 'AI_VERIFIED' END AS status
FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS n, CAST(o_orderdate AS DATE) AS d, {point} AS t FROM orders) x"""


def candidate_grounding(spark: SparkSession, folder: str) -> DataFrame:
    """Which candidates stand in their certificate, and the kind of benefit that is left to each."""
    how = {"price": "format_number(n, 0)", "day": "date_add(d, CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END)", "point": "date_format(o_orderdate, 'yyyy.M.d')"}
    x = spark.sql(_CERTIFICATES.format(**how).replace("FROM orders", "FROM {orders}"), orders=table(spark, folder, "orders"))
    said = (("rider_name", "name"), ("sum_assured", "amount"), ("currency", "currency"), ("coverage_start", "day"), ("benefit_type", "benefit"))
    each = F.filter(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(f).alias("field"), F.col(c).cast("string").alias("value")) for i, (f, c) in enumerate(said))), lambda f: f["value"].isNotNull())
    fields = x.select(F.col("k").alias("candidate"), F.lit("rider").alias("kind"), "status", "text", F.lit(True).alias("primary"), F.lit(1).alias("n_evidence"), F.lit(False).alias("missing"), F.inline(each))
    benefit = F.inline(F.transform(F.filter("fields", lambda f: f["field"] == "benefit_type"), lambda f: F.struct(f["value"].alias("benefit"))))
    return grounding.grounded(fields).select(F.col("candidate").alias("o_orderkey"), "status", F.coalesce("issue", F.lit("")).alias("issue"), benefit)


def footnotes(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as tables with markers, suppliers as notes on the same pages."""
    key, s = F.col("p_partkey"), F.col("s_suppkey")
    d = lambda c: c.cast("double")
    tables = table(spark, folder, "part").select((key % 50).alias("page"), key.alias("table_id"), d(F.col("p_size")).alias("left"), d(F.col("p_size") + 30).alias("right"), (key % 7 * 40.0).alias("bottom"))
    cells = table(spark, folder, "part").select(key.alias("table_id"), F.explode(F.array(F.when(key % 3 != 0, F.concat(F.lit("*"), (key % 2).cast("string"))), F.when(key % 5 == 0, F.lit("*2")))).alias("marker"))
    notes = table(spark, folder, "supplier").select((s % 50).alias("page"), s.alias("note"), F.concat(F.lit("*"), (F.col("s_nationkey") % 3).cast("string")).alias("marker"), d(s % 40).alias("left"), d(s % 40 + 20).alias("right"), (s % 7 * 40.0 + 5).alias("top"))
    return documents.footnotes(tables, cells, notes).select("table_id", "marker", "state", F.coalesce("note", F.lit(-1)).alias("note"))


def line_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as blocks on the page of their order."""
    top = F.col("l_linenumber") * 4.0 + F.col("l_suppkey") % 5
    blocks = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("page"), F.xxhash64("l_partkey", "l_suppkey", "l_extendedprice", "l_linenumber").alias("block"), F.col("l_quantity").alias("left"), (F.col("l_quantity") + 5).alias("right"), top.alias("top"), (top + 8).alias("bottom"))
    return documents.line_groups(blocks).groupBy("page").agg((F.max("line") + 1).alias("n_lines"), F.count(F.lit(1)).alias("n_blocks"))


def search_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of the editions (customers) that are in force on a day, of one insurer and product."""
    key = F.col("c_custkey")
    start, end = F.date_add(F.lit("1995-01-01").cast("date"), (key % 2000).cast("int")), F.date_add(F.lit("1997-01-01").cast("date"), (key % 1500).cast("int"))
    editions = table(spark, folder, "customer").select(key.alias("edition"), F.when(key % 5 != 0, start).alias("start"), F.when(key % 7 != 0, end).alias("end"), F.concat(F.lit("i"), (F.col("c_nationkey") % 3).cast("string")).alias("insurer"), F.col("c_mktsegment").alias("product"))
    corpus = table(spark, folder, "orders").select(F.col("o_custkey").alias("edition"), "o_orderkey")
    return search.in_force(corpus, editions, "edition", on="1998-03-01", insurer="i1", product="BUILDING").select("edition", "o_orderkey")


def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's lines as one JSON text, in order."""
    line = F.struct(F.col("l_linenumber").cast("int").alias("line"), F.col("l_partkey").cast("long").alias("part"), F.col("l_returnflag").alias("flag"))
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.sort_array(F.collect_list(line))).alias("lines"))


def json_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Beside each order the digest of the JSON of all keys of its customer, and their number: a frame without bounds is one row for each
    customer, so it is made once and joined, not carried by every row."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    keys = F.to_json(F.sort_array(F.collect_list(F.col("o_orderkey").cast("long"))))
    frames = orders.groupBy("o_custkey").agg(F.md5(keys.cast("binary")).alias("digest"), F.count(F.lit(1)).alias("n"))
    return orders.join(frames, "o_custkey").select("o_orderkey", "digest", "n")


def dedup_before_write(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of part and supplier to insert: those of returned lines that no other line has."""
    lines = table(spark, folder, "lineitem")
    pair = lambda x: x.select(F.when(F.col("l_suppkey") % 50 != 0, F.col("l_suppkey")).alias("supplier"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("quantity"))
    return new_rows(pair(lines.where("l_returnflag = 'R'")), pair(lines.where("l_returnflag <> 'R'")), ["part", "supplier"]).select("part", F.coalesce("supplier", F.lit(-1)).alias("supplier"), "quantity")


def negative_controls(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    some = lambda when, *x: F.when(when, F.array(*map(F.lit, x))).otherwise(F.array().cast("array<string>"))
    cases = table(spark, folder, "orders").select(some(key % 3 == 0, "a").alias("expected_primary"), some(key % 2 == 0, "b").alias("expected_conditional"), some(key % 5 != 0, "a", "b", "c").alias("pool"), (key % 3 == 0).alias("answerable"))
    out = audits.negative_controls(cases, "pool")
    return out.select("control", *(F.coalesce(F.col(c), F.lit(-1.0)).alias(c) for c in out.columns if c != "control"))


QUERIES = {f.__name__: f for f in (phrase_facts, situation_reading, situation_documents, relevance_witness, candidate_grounding, footnotes, line_groups, search_filters, json_documents, json_windows, dedup_before_write, negative_controls)}


SQL = {
    "phrase_facts": r"""
WITH w AS (SELECT doc_id, ' ' || regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g') || ' ' AS t FROM documents),
u AS (SELECT doc_id, regexp_replace(t, ' +', ' ', 'g') AS t FROM w),
f AS (
  SELECT doc_id, 'Event.kind' AS path, 'A' AS value, 2 AS p FROM u WHERE contains(t, ' of the ') UNION ALL SELECT doc_id, 'Event.kind', 'B', 2 FROM u WHERE contains(t, ' in the ')
  UNION ALL SELECT doc_id, 'Event.kind', 'C', 1 FROM u WHERE contains(t, ' the ') UNION ALL SELECT doc_id, 'Event.place', 'D', 1 FROM u WHERE contains(t, ' and ')
  UNION ALL SELECT doc_id, 'Event.place', 'E', 1 FROM u WHERE contains(t, ' the and ')),
m AS (SELECT *, max(p) OVER (PARTITION BY doc_id, path) AS top FROM f)
SELECT doc_id, path, CASE WHEN count(DISTINCT value) = 1 THEN min(value) ELSE '' END AS value, CASE WHEN count(DISTINCT value) > 1 THEN 'CONFLICTING' ELSE 'RESOLVED' END AS state FROM m WHERE p = top GROUP BY 1, 2""",
    "situation_reading": f"""
WITH told AS ({_said_sql("VARCHAR")}),
c AS (SELECT o_orderkey AS k, day, unnest(string_split_regex(text, ';| but ')) AS b, generate_subscripts(string_split_regex(text, ';| but '), 1) AS i, contains(text, 'today') AS now FROM told),
m AS (SELECT *, try_cast(nullif(regexp_extract(b, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), '') AS DATE) AS t, contains(b, 'visit date') AS visit FROM c),
w AS (
  SELECT *, bool_or(contains(b, 'mother')) OVER o AS other, last_value(CASE WHEN NOT visit THEN t END IGNORE NULLS) OVER o AS prior,
    coalesce(last_value(CASE WHEN contains(b, '작년') THEN now WHEN contains(b, 'today') THEN false END IGNORE NULLS) OVER o, false) AS old,
    coalesce(day IS NULL AND min(CASE WHEN NOT visit THEN t END) OVER (PARTITION BY k) <> max(CASE WHEN NOT visit THEN t END) OVER (PARTITION BY k), false) AS several
  FROM m WINDOW o AS (PARTITION BY k ORDER BY i)),
r AS (
  SELECT *, list_filter([CASE WHEN other THEN 'SUBJECT_UNRESOLVED' END, CASE WHEN NOT visit AND (old OR several OR coalesce(prior <> day, false)) THEN 'OTHER_EVENT_TIME' END], lambda x: x IS NOT NULL) AS why,
    CASE WHEN regexp_matches(b, '\\bcancelled\\b') THEN 'UNKNOWN:PLAN_CANCELLED' WHEN regexp_matches(b, '\\bmaybe\\b') THEN 'UNKNOWN:STATEMENT_UNCERTAIN'
      WHEN regexp_matches(b, '\\b(?:not|never)\\b|않') THEN 'NEGATED:ACTIVITY_NEGATED' WHEN regexp_matches(b, '\\bplanned\\b') THEN 'PLANNED:ACTIVITY_PLANNED' ELSE 'AFFIRMED:' END AS said,
    regexp_matches(b, '\\badmitted\\b|입원했') AS stayed FROM w),
g AS (SELECT *, CASE WHEN len(why) > 0 THEN 'UNKNOWN' ELSE split_part(said, ':', 1) END AS s, CASE WHEN len(why) > 0 THEN array_to_string(why, ',') ELSE split_part(said, ':', 2) END AS q FROM r),
a AS (
  SELECT k, i, 'admission' AS what, s, q, stayed AS done FROM g WHERE regexp_matches(b, '\\badmitted\\b|입원')
  UNION ALL SELECT k, i, 'outpatient', s, q, contains(b, 'received outpatient care') FROM g WHERE contains(b, 'outpatient')
  UNION ALL SELECT k, i, 'surgery', CASE WHEN s <> 'UNKNOWN' AND talk OR talk AND len(why) = 0 THEN 'UNKNOWN' ELSE s END, CASE WHEN talk AND len(why) = 0 THEN 'ACTIVITY_UNRESOLVED' ELSE q END, regexp_matches(b, 'had surgery|수술을 받았|수술했')
    FROM (SELECT *, regexp_matches(b, 'surgery consultation|수술 상담') AS talk FROM g) WHERE regexp_matches(b, '\\bsurgery\\b|수술')),
n AS (SELECT *, regexp_extract(b, '(?:admitted for |^ ?)([0-9]+)(?: days|일간 입원)', 1) AS d, regexp_extract(b, '([0-9]+(?:\\.[0-9]{{1,2}})?) (EUR|USD)', ['p', 'u']) AS money FROM g),
f AS (
  SELECT k, i, 'Event.' || what AS path, CASE WHEN s = 'NEGATED' THEN 'false' WHEN s = 'AFFIRMED' AND done THEN 'true' ELSE '' END AS value,
    CASE WHEN s = 'NEGATED' OR s = 'AFFIRMED' AND done THEN 'CONFIRMED' WHEN s = 'PLANNED' THEN 'SCENARIO' ELSE 'UNKNOWN' END AS state, '' AS currency,
    CASE WHEN s = 'AFFIRMED' THEN CASE WHEN done THEN 'ACTIVITY_PERFORMED' ELSE 'ACTIVITY_UNRESOLVED' END ELSE q END AS reasons FROM a
  UNION ALL SELECT k, i, 'Event.treatment_kind', 'surgery', 'CONFIRMED', '', 'ACTIVITY_PERFORMED' FROM a WHERE what = 'surgery' AND s = 'AFFIRMED' AND done
  UNION ALL SELECT k, i, 'Event.diagnosis_confirmed', CASE WHEN s = 'NEGATED' THEN 'false' WHEN s = 'AFFIRMED' THEN 'true' ELSE '' END, CASE WHEN s = 'UNKNOWN' THEN s ELSE 'CONFIRMED' END, '',
    CASE WHEN s = 'AFFIRMED' THEN 'DIAGNOSIS_CONFIRMED' ELSE q END FROM g WHERE contains(b, 'diagnosed')
  UNION ALL SELECT k, i, 'Event.admission_days', CASE WHEN s = 'AFFIRMED' THEN d ELSE '' END, CASE WHEN s = 'AFFIRMED' THEN 'CONFIRMED' ELSE 'UNKNOWN' END, '', CASE WHEN s = 'AFFIRMED' THEN 'ADMISSION_DAYS' ELSE q END FROM n WHERE d <> '' AND NOT contains(b, ' to ')
  UNION ALL SELECT k, i, path, CASE WHEN sure THEN money.p::DECIMAL(18,2)::VARCHAR ELSE '' END, CASE WHEN NOT sure THEN 'UNKNOWN' WHEN path = 'Receipt.estimated' THEN 'SCENARIO' ELSE 'CONFIRMED' END, CASE WHEN sure THEN money.u ELSE '' END,
    CASE WHEN NOT sure THEN CASE WHEN s = 'UNKNOWN' THEN q ELSE 'COST_UNRESOLVED' END WHEN path = 'Receipt.estimated' THEN 'ESTIMATED_COST' ELSE 'BILLED_COST' END
    FROM (SELECT *, CASE WHEN contains(b, 'estimated') THEN 'Receipt.estimated' ELSE 'Receipt.billed' END AS path, s = 'AFFIRMED' AND NOT contains(b, 'about') AS sure FROM n WHERE regexp_matches(b, 'medical cost|hospital bill'))
  UNION ALL SELECT k, i, CASE WHEN visit THEN 'Event.visit_date' ELSE 'Event.event_date' END, CASE WHEN s = 'UNKNOWN' THEN '' ELSE t::VARCHAR END, CASE WHEN s = 'UNKNOWN' THEN s ELSE 'CONFIRMED' END, '', CASE WHEN s = 'UNKNOWN' THEN q ELSE 'EXPLICIT_DATE' END
    FROM g WHERE t IS NOT NULL AND (visit OR coalesce(t = day, true))),
x AS (SELECT *, state = 'UNKNOWN' AND len(list_filter(string_split(reasons, ','), lambda y: y NOT IN ('SUBJECT_UNRESOLVED', 'OTHER_EVENT_TIME'))) = 0 AS aside FROM f),
y AS (SELECT * FROM x QUALIFY NOT aside OR bool_and(aside) OVER (PARTITION BY k, path)),
z AS (SELECT k, path, count(DISTINCT (value, state, currency)) = 1 AS one, min(value) AS v, min(state) AS s, min(currency) AS c, list(reasons ORDER BY i) AS why FROM y GROUP BY k, path)
SELECT k AS o_orderkey, path, CASE WHEN one THEN v ELSE '' END AS value, CASE WHEN one THEN s ELSE 'UNKNOWN' END AS state, CASE WHEN one THEN c ELSE '' END AS currency,
  CASE WHEN NOT one THEN 'FACT_CONFLICT' WHEN len(why) = 1 OR why[1] = why[2] THEN why[1] WHEN contains(why[2], why[1]) THEN why[2] WHEN contains(why[1], why[2]) THEN why[1] ELSE why[1] || ',' || why[2] END AS reasons FROM z""",
    "relevance_witness": f"""
WITH {FACTS_SQL},
x AS (SELECT o_orderkey, is_fp, in_amount, in_days, CASE WHEN is_fp THEN 'CONFIRMED_EVENT' WHEN is_fp IS NULL AND o_custkey % 3 = 0 THEN 'LOCAL_TOPIC' END AS kind, CASE WHEN day IS NOT NULL THEN TRUE END AS dated FROM leaves),
y AS (SELECT *, (is_fp OR in_amount) AS a, (in_days OR dated OR NOT in_amount) AS b FROM x)
SELECT o_orderkey, CASE WHEN coalesce(NOT (a AND b), FALSE) THEN '' ELSE
  concat_ws(',', CASE WHEN NOT coalesce(NOT a, FALSE) AND kind IS NOT NULL THEN 'Event.kind:' || kind END, CASE WHEN NOT coalesce(NOT a, FALSE) AND in_amount THEN 'Event.amount:CONFIRMED_EVENT' END,
            CASE WHEN NOT coalesce(NOT b, FALSE) AND dated THEN 'Event.day:CONFIRMED_EVENT' END) END AS witnesses FROM y""",
    "candidate_grounding": f"""
WITH x AS ({_CERTIFICATES.format(price="format('{:,}', n)", day="d + CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END", point="strftime(o_orderdate, '%Y.%-m.%-d')")}),
l AS (SELECT k, name, unnest(string_split(text, chr(10))) AS line FROM x),
h AS (SELECT k, list(DISTINCT line) AS own, bool_or(regexp_matches(line, '\\| not enrolled$')) AS out FROM l WHERE regexp_matches(lower(line), '(?:^|[^0-9a-z_])' || name || '(?:[^0-9a-z_]|$)') GROUP BY k),
r AS (SELECT x.*, CASE WHEN len(own) = 1 THEN own[1] ELSE '' END AS row, coalesce(out, false) AS out FROM x LEFT JOIN h USING (k)),
m AS (
  SELECT *, regexp_extract_all(row, 'sum assured:? ?[0-9,]+ ?(?:KRW|EUR|만원)') AS sums, regexp_extract(row, 'coverage start ([0-9]+)[.]([0-9]+)[.]([0-9]+)', ['y', 'm', 'd']) AS t,
    regexp_matches(row, '\\bfixed\\b') AS fixed, regexp_matches(row, '\\bindemnity\\b') AS indemnity, regexp_matches(lower(row), '^enrolled rider: ' || name || '(?:[^0-9a-z_]|$)') AS enrolled FROM r),
g AS (
  SELECT *, CASE WHEN len(sums) = 1 THEN regexp_extract(sums[1], '([0-9,]+) ?(KRW|EUR|만원)', ['n', 'u']) END AS s,
    CASE WHEN benefit IN ('fixed', 'indemnity') AND enrolled AND NOT fixed AND NOT indemnity THEN 'unknown' ELSE coalesce(benefit, 'unknown') END AS kept FROM m),
j AS (
  SELECT *, row <> '' AND (enrolled OR coalesce(benefit, 'unknown') <> 'unknown') AND coalesce(try_cast(replace(s.n, ',', '') AS BIGINT) * CASE WHEN s.u = '만원' THEN 10000 ELSE 1 END = amount, false)
    AND coalesce(CASE WHEN s.u = 'EUR' THEN 'EUR' ELSE 'KRW' END = currency AND s.u IS NOT NULL, false) AND coalesce(make_date(try_cast(t.y AS INT), try_cast(t.m AS INT), try_cast(t.d AS INT)) = day, false)
    AND (kept = 'unknown' OR kept = 'fixed' AND fixed AND NOT indemnity OR kept = 'indemnity' AND indemnity AND NOT fixed) AS proved FROM g)
SELECT k AS o_orderkey, CASE WHEN status = 'AI_VERIFIED' AND (out OR NOT proved) THEN 'NEEDS_REVIEW' ELSE status END AS status,
  CASE WHEN out THEN 'NOT_ENROLLED' WHEN status = 'AI_VERIFIED' AND NOT proved THEN 'INVENTED_FIELD' ELSE '' END AS issue, kept AS benefit FROM j""",
    "footnotes": """
WITH t AS (SELECT p_partkey % 50 AS page, p_partkey AS id, p_size AS l, p_size + 30 AS r, p_partkey % 7 * 40 AS b FROM part),
c AS (SELECT p_partkey AS id, '*' || p_partkey % 2 AS m FROM part WHERE p_partkey % 3 <> 0 UNION SELECT p_partkey, '*2' FROM part WHERE p_partkey % 5 = 0),
n AS (SELECT s_suppkey % 50 AS page, s_suppkey AS note, '*' || s_nationkey % 3 AS m, s_suppkey % 40 AS l, s_suppkey % 40 + 20 AS r, s_suppkey % 7 * 40 + 5 AS t FROM supplier),
f AS (
  SELECT c.id, c.m, note FROM c JOIN t ON c.id = t.id JOIN n ON n.page = t.page AND n.m = c.m
  WHERE n.t - b BETWEEN 0 AND 20 AND least(t.r, n.r) - greatest(t.l, n.l) >= 0.5 * least(t.r - t.l, n.r - n.l)),
k AS (SELECT note, count(DISTINCT id) AS k FROM f GROUP BY 1),
u AS (SELECT DISTINCT id FROM f JOIN k ON f.note = k.note WHERE k > 1),
o AS (SELECT id, m, count(*) AS n, min(f.note) AS note FROM f JOIN k ON f.note = k.note WHERE k = 1 GROUP BY 1, 2)
SELECT c.id AS table_id, c.m AS marker, CASE WHEN o.n IS NULL THEN 'REFERENCE_UNRESOLVED' WHEN o.n > 1 THEN 'AMBIGUOUS' WHEN u.id IS NOT NULL THEN 'TABLE_AMBIGUOUS' ELSE 'RESOLVED' END AS state,
  CASE WHEN o.n = 1 AND u.id IS NULL THEN o.note ELSE -1 END AS note FROM c LEFT JOIN o ON c.id = o.id AND c.m = o.m LEFT JOIN u ON c.id = u.id""",
    "search_filters": """
WITH e AS (
  SELECT c_custkey AS k FROM customer WHERE (c_custkey % 5 = 0 OR DATE '1995-01-01' + (c_custkey % 2000)::INT <= DATE '1998-03-01') AND (c_custkey % 7 = 0 OR DATE '1997-01-01' + (c_custkey % 1500)::INT >= DATE '1998-03-01')
    AND c_nationkey % 3 = 1 AND c_mktsegment = 'BUILDING')
SELECT o_custkey AS edition, o_orderkey FROM orders WHERE o_custkey IN (SELECT k FROM e)""",
    "json_documents": """
SELECT l_orderkey, to_json(list({'line': l_linenumber::INT, 'part': l_partkey::BIGINT, 'flag': l_returnflag} ORDER BY l_linenumber, l_partkey, l_returnflag))::VARCHAR AS lines FROM lineitem GROUP BY 1""",
    "json_windows": """
WITH g AS (SELECT o_custkey, to_json(list(o_orderkey::BIGINT ORDER BY o_orderkey))::VARCHAR AS keys, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, md5(keys) AS digest, n FROM orders JOIN g USING (o_custkey)""",
    "dedup_before_write": """
WITH p AS (SELECT l_partkey AS part, CASE WHEN l_suppkey % 50 <> 0 THEN l_suppkey END AS supplier, l_quantity::INT AS quantity, l_returnflag = 'R' AS fresh FROM lineitem)
SELECT part, supplier, min(quantity) AS quantity FROM p WHERE fresh AND supplier IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p o WHERE NOT o.fresh AND o.part = p.part AND o.supplier = p.supplier) GROUP BY 1, 2
UNION ALL SELECT part, -1, quantity FROM p WHERE fresh AND supplier IS NULL""",
    "negative_controls": """
WITH c AS (SELECT (o_orderkey % 3 = 0)::INT AS a, (o_orderkey % 2 = 0)::INT AS b, o_orderkey % 5 <> 0 AS p FROM orders),
m AS (
  SELECT sum(a + b)::DOUBLE AS expected, (sum(a + b) FILTER (p))::DOUBLE AS hit, (sum(a) FILTER (p))::DOUBLE AS hit_a, (sum(b) FILTER (p))::DOUBLE AS hit_b, (3 * count(*) FILTER (p))::DOUBLE AS given,
    (count(*) FILTER (a + b = 0 AND p))::DOUBLE / count(*) FILTER (a + b = 0) AS unrelated FROM c)
SELECT 'all_hold' AS control, 0.0::DOUBLE AS recall, -1.0::DOUBLE AS primary_precision, -1.0::DOUBLE AS conditional_precision, 0.0::DOUBLE AS unrelated_rate, 1.0::DOUBLE AS unnecessary_hold_rate FROM m
UNION ALL SELECT 'all_primary', hit / expected, hit_a / given, -1.0, unrelated, 0.0 FROM m
UNION ALL SELECT 'all_conditional', hit / expected, -1.0, hit_b / given, unrelated, 0.0 FROM m""",
}
