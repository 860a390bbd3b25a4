"""Queries of reconciliation, inventory, audits, scores and streaming counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.operators import audits
from verdict.sources.tables import table
from verdict.streaming import queues


def label_match_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    """Parts matched by name to the parts of the largest size."""
    part = table(spark, folder, "part").select("p_partkey", "p_size", F.concat_ws("/", "p_name", "p_brand").alias("key"))
    right = part.where("p_size >= 48").select(F.col("p_partkey").alias("other"), "key")
    out = audits.match_by_label(part.where("p_size <= 10").select("p_partkey", "key"), right, "key", "p_partkey", "other")
    return out.select("p_partkey", "state", "n_candidates", F.coalesce("candidate", F.lit(-1)).alias("candidate"))


def reconcile_states(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of documents from three sources in order: the label, a rule on the length, the language."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("labelled")), "doc_id", "left")
    items = docs.select("doc_id", "labelled", F.when(F.col("n_chars") < 200, "0").alias("by_length"), F.when(F.col("lang") == "de", "1").alias("by_language"))
    out = audits.reconcile(items, [("LINK", "labelled"), ("SNAPSHOT", "by_length"), ("DEFAULT", "by_language")])
    return out.groupBy("state", F.coalesce("origin", F.lit("NONE")).alias("origin"), F.coalesce("value", F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def change_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What bringing labels up to date with documents would do."""
    want = table(spark, folder, "documents").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("quality"), F.col("lang").alias("lang"))
    return audits.change_plan(want, table(spark, folder, "labels"), "doc_id", "quality", F.col("lang") == "es").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def orphan_audit(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    return audits.orphans([
        ("lineitem.orders", t("lineitem"), "l_orderkey", t("orders").where("o_orderkey % 100 <> 0"), "o_orderkey"),
        ("lineitem.part", t("lineitem"), "l_partkey", t("part"), "p_partkey"),
        ("labels.documents", t("labels"), "doc_id", t("documents"), "doc_id"),
    ])


def archive_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Documents against labels as if these were an archive: sizes are lengths, some of them off by one."""
    expected = table(spark, folder, "documents").where("doc_id % 9 <> 0").select("doc_id", "n_chars")
    stored = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)).alias("n_chars"))
    return audits.archive_audit(expected.unionByName(expected.where("doc_id % 50 = 1")), stored, "doc_id", "n_chars")


def inventory_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by source: distinct texts, languages, and contents that stand for more than one document."""
    docs = table(spark, folder, "documents").withColumn("content", F.md5(F.col("text").cast("binary")))
    shared = audits.bundles(docs, "content", "doc_id").select("content", F.lit(1).alias("bundled"))
    joined = docs.join(shared, "content", "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content").alias("n_contents"), F.count_distinct("lang").alias("n_langs"), F.count("bundled").alias("n_bundled"))


def review_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers' lines of two flags compared as behaviours: added, removed, changed or the same."""
    by = lambda flag: table(spark, folder, "lineitem").where(F.col("l_returnflag") == flag).groupBy("l_orderkey").agg(F.max("l_linestatus").alias("status"), F.count(F.lit(1)).alias("n"))
    return audits.differences(by("N"), by("R"), "l_orderkey", ["status", "n"]).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


STATES = {"signup": ("view", "click", "error"), "view": ("click", "purchase", "view"), "click": ("purchase", "view", "click"), "purchase": ("signup",), "error": ("signup", "error")}


def state_transition_check(spark: SparkSession, folder: str) -> DataFrame:
    """Steps of users' histories that the table of transitions does not allow."""
    events = table(spark, folder, "events")
    return audits.invalid_transitions(events, "user_id", ["ts", "event_id"], "event_type", STATES).groupBy("from_state", "to_state").agg(F.sum("n").alias("n"))


def benchmark_score(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as cases: parts with a large discount are expected, parts of a large quantity are given."""
    lines = table(spark, folder, "lineitem")
    pick = lambda c: F.array_distinct(F.array_compact(F.collect_list(F.when(c, F.col("l_partkey")))))
    cases = lines.groupBy("l_orderkey").agg(
        pick((F.col("l_discount") > 0.05) & (F.col("l_partkey") % 3 != 0)).alias("expected_primary"),
        pick((F.col("l_discount") > 0.05) & (F.col("l_partkey") % 3 == 0)).alias("expected_conditional"),
        pick((F.col("l_quantity") > 25) & (F.col("l_partkey") % 3 != 0)).alias("primary"),
        pick((F.col("l_quantity") > 25) & (F.col("l_partkey") % 3 == 0)).alias("conditional"),
    )
    return audits.benchmark_score(cases.withColumn("answerable", F.col("l_orderkey") % 4 != 0).withColumn("held", F.col("l_orderkey") % 10 == 1))


def daily_quota(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return queues.daily_quota(events, "ts", ["event_type"]).withColumn("day", F.col("day").cast("string"))


def sliding_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Users with errors, in windows of six hours that start every two."""
    errors = table(spark, folder, "events").where("event_type = 'error'")
    out = queues.attempts(errors, "ts", ["user_id"], "6 hours", "2 hours")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


def lease_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Users as jobs: events claim, renew, finish or fail them; leases run out after ten hours."""
    kind = F.when(F.col("event_type").isin("signup", "view"), "claim").when(F.col("event_type") == "click", "heartbeat").when(F.col("event_type") == "purchase", "done").otherwise("fail")
    events = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("job"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    return queues.leases_batch(events, lease="10 hours", most=3)


QUERIES = {f.__name__: f for f in (label_match_cardinality, reconcile_states, change_plan, orphan_audit, archive_audit, inventory_summary, review_difference, state_transition_check, benchmark_score, daily_quota, sliding_attempts, lease_queue)}

_ALLOWED = ", ".join(f"'{a}>{b}'" for a, to in STATES.items() for b in to)
SQL = {
    "label_match_cardinality": """
WITH r AS (SELECT p_name || '/' || p_brand AS key, count(DISTINCT p_partkey) AS n, min(p_partkey) AS one FROM part WHERE p_size >= 48 GROUP BY 1)
SELECT p_partkey, CASE WHEN n = 1 THEN 'REVIEW' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END AS state, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN one ELSE -1 END AS candidate
FROM part LEFT JOIN r ON r.key = p_name || '/' || p_brand WHERE p_size <= 10""",
    "reconcile_states": """
WITH x AS (
  SELECT l.quality::VARCHAR AS a, CASE WHEN n_chars < 200 THEN '0' END AS b, CASE WHEN lang = 'de' THEN '1' END AS c
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT CASE WHEN a <> b OR a <> c OR b <> c THEN 'CONFLICT' WHEN coalesce(a, b, c) IS NULL THEN 'PENDING' ELSE 'RESOLVED' END AS state,
  CASE WHEN a IS NOT NULL THEN 'LINK' WHEN b IS NOT NULL THEN 'SNAPSHOT' WHEN c IS NOT NULL THEN 'DEFAULT' ELSE 'NONE' END AS origin, coalesce(a, b, c, '') AS value, count(*) AS n
FROM x GROUP BY 1, 2, 3""",
    "change_plan": """
SELECT CASE WHEN lang = 'es' THEN 'BLOCKED' WHEN l.doc_id IS NULL THEN 'CREATE' WHEN l.quality = (n_chars > 500)::INT THEN 'NO_OP' ELSE 'SUPERSEDE' END AS action, count(*) AS n
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
    "orphan_audit": """
SELECT 'lineitem.orders' AS reference, count(*) AS n_orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 <> 0)
UNION ALL SELECT 'lineitem.part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'labels.documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "archive_audit": """
WITH e AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 50 = 1 THEN 2 ELSE 1 END AS n FROM documents WHERE doc_id % 9 <> 0),
s AS (SELECT l.doc_id, n_chars + (l.doc_id % 10 = 0)::INT AS size FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT count(*) FILTER (e.n_chars = s.size) AS matched, count(*) FILTER (e.doc_id IS NOT NULL AND s.doc_id IS NULL) AS missing, count(*) FILTER (e.n_chars <> s.size) AS size_mismatch,
  count(*) FILTER (e.doc_id IS NULL) AS unreferenced, coalesce(sum(e.n - 1), 0)::BIGINT AS duplicate_references
FROM e FULL JOIN s ON e.doc_id = s.doc_id""",
    "inventory_summary": """
WITH b AS (SELECT md5(text) AS content FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)
SELECT source, count(*) AS n, count(DISTINCT md5(text)) AS n_contents, count(DISTINCT lang) AS n_langs, count(b.content) AS n_bundled
FROM documents LEFT JOIN b ON md5(text) = b.content GROUP BY source""",
    "review_difference": """
WITH a AS (SELECT l_orderkey AS k, max(l_linestatus) AS s, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), b AS (SELECT l_orderkey AS k, max(l_linestatus) AS s, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT CASE WHEN a.k IS NULL THEN 'ADDED' WHEN b.k IS NULL THEN 'REMOVED' WHEN a.s = b.s AND a.n = b.n THEN 'SAME' ELSE 'CHANGED' END AS state, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""",
    "state_transition_check": f"""
WITH x AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events)
SELECT from_state, to_state, count(*) AS n FROM x WHERE from_state IS NOT NULL AND from_state || '>' || to_state NOT IN ({_ALLOWED}) GROUP BY 1, 2""",
    "benchmark_score": """
WITH x AS (
  SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem),
f AS (
  SELECT l_orderkey AS k, l_partkey AS p, bool_or(l_discount > 0.05::DOUBLE) AS e, bool_or(l_quantity > 25) AS g, l_partkey % 3 = 0 AS c FROM lineitem GROUP BY 1, 2),
s AS (SELECT k, count(*) FILTER (e) AS ne, count(*) FILTER (g) AS ng FROM f GROUP BY k)
SELECT (SELECT count(*) FILTER (e AND g)::DOUBLE / nullif(count(*) FILTER (e), 0) FROM f) AS recall,
  (SELECT count(*) FILTER (e AND g AND NOT c)::DOUBLE / nullif(count(*) FILTER (g AND NOT c), 0) FROM f) AS primary_precision,
  (SELECT count(*) FILTER (e AND g AND c)::DOUBLE / nullif(count(*) FILTER (g AND c), 0) FROM f) AS conditional_precision,
  (SELECT count(*) FILTER (ne = 0 AND ng > 0)::DOUBLE / nullif(count(*) FILTER (ne = 0), 0) FROM s) AS unrelated_rate,
  (SELECT count(*) FILTER (k % 4 <> 0 AND k % 10 = 1)::DOUBLE / nullif(count(*) FILTER (k % 4 <> 0), 0) FROM s) AS unnecessary_hold_rate""",
    "daily_quota": "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_attempts": """
WITH e AS (SELECT user_id, ts, epoch_ms(ts) // 7200000 AS slot FROM events WHERE event_type = 'error'),
w AS (SELECT user_id, (slot - unnest([0, 1, 2])) * 7200000 AS start FROM e)
SELECT strftime(make_timestamp(start * 1000), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM w GROUP BY 1, 2""",
}
