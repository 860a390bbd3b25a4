"""Queries of fact merging, grounding, layout joins and canonical digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.operators import evidence
from verdict.operators.components import components
from verdict.sources.tables import table


def fact_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Statuses of a customer's orders of a year as facts; undecided ones count only by themselves."""
    key = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "P", "UNKNOWN").otherwise("KNOWN")
    value = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    facts = table(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), value.alias("value"), state.alias("state"), F.when(key % 29 == 0, "USD").alias("currency"))
    out = evidence.merge_facts(facts, ["o_custkey", "year"])
    return out.select("o_custkey", "year", *(F.coalesce(c, F.lit("")).alias(c) for c in ("value", "state", "reason")))


def suggested_demotion(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", F.lit("MATCH").alias("verdict"), (F.col("l_returnflag") == "A").alias("suggested"))
    return evidence.demoted(rows, ["l_orderkey"])


def event_freshness(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    as_of = F.when(key % 7 == 0, "unknown").when(key % 7 == 1, "expired").when(key % 7 == 2, "conflicting").otherwise("active")
    state = evidence.freshness(as_of, key % 2 == 0, F.when(key % 5 == 0, "inactive").otherwise("active"))
    return table(spark, folder, "orders").groupBy(F.coalesce(state, F.lit("DROPPED")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def link_validation(spark: SparkSession, folder: str) -> DataFrame:
    """The first thing that is wrong with each line's links."""
    t = lambda n: table(spark, folder, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    code = evidence.first_failure([
        ("ORDER_MISSING", F.col("o_orderkey").isNotNull()),
        ("PART_MISSING", F.col("p_partkey").isNotNull()),
        ("SHIPPED_BEFORE_ORDER", F.col("l_shipdate") >= F.col("o_orderdate")),
        ("PRICE_TOO_LOW", F.col("l_extendedprice") >= F.col("p_retailprice")),
        ("SIZE_TOO_LARGE", F.col("p_size") <= 40),
    ])
    return joined.groupBy(F.coalesce(code, F.lit("VALID")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def page_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as evidence on pages (their number), orders' ranges of pages as clauses."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"))
    clauses = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 4 + 1).alias("first"), (F.col("o_orderkey") % 4 + F.col("o_custkey") % 3 + 1).alias("last"))
    return evidence.contained(lines, clauses, "doc", "page", "first", "last").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


def span_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Users' events as spans of an hour, merged to disjoint ones."""
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    spans = table(spark, folder, "events").select("user_id", second.alias("start"), (second + 3600 * (F.col("event_id") % 5 + 1)).alias("end"))
    return evidence.merged_spans(spans, ["user_id"], "start", "end")


def chosen_page_text(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as pages: users' turns are the native blocks, assistants' the scanner's."""
    turns = table(spark, folder, "conversations").where("role <> 'system'")
    blocks = turns.select(F.col("conv_id").alias("page"), F.when(F.col("role") == "user", "native").otherwise("scan").alias("origin"), F.col("turn").alias("position"), F.coalesce("text", F.lit("")).alias("text"))
    pages = blocks.select("page").distinct().withColumn("needs_scan", F.col("page") % 3 == 0)
    return evidence.chosen_text(pages, blocks)


LABELS = {"name": ["small", "red"], "amount": ["ring", "bolt"], "period": ["widget"]}


def table_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Words of part names as cells of rows."""
    part = table(spark, folder, "part")
    cells = part.select((F.col("p_partkey") % 10).alias("table_id"), F.col("p_partkey").alias("row"), F.explode(F.split(F.concat_ws(" ", "p_name", F.when(F.col("p_size") > 40, "17")), " ")).alias("text"))
    return evidence.header_rows(cells, LABELS)


def unit_captions(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as tables and suppliers' lines as notes on pages."""
    d = lambda c: F.col(c).cast("double")
    tables = table(spark, folder, "part").select((F.col("p_partkey") % 50).alias("page"), F.col("p_partkey").alias("table_id"), d("p_size").alias("left"), (d("p_size") + 30).alias("right"), ((F.col("p_partkey") % 7) * 40.0).alias("top"))
    notes = table(spark, folder, "supplier").select((F.col("s_suppkey") % 50).alias("page"), (F.col("s_suppkey") % 40).cast("double").alias("left"), (F.col("s_suppkey") % 40 + 20).cast("double").alias("right"), ((F.col("s_suppkey") % 7) * 40.0 - 5).alias("bottom"), F.when(F.col("s_nationkey") % 2 == 0, "thousand").otherwise("one").alias("unit"))
    return evidence.captions(tables, notes).select("table_id", "state", F.coalesce("unit", F.lit("")).alias("unit"))


def scanner_words(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a scanner, put together from line items, read back."""
    fields = [F.when(F.col("l_linenumber") % 3 == 0, "4").otherwise("5"), F.col("l_orderkey").cast("string"), *[F.lit("1")] * 4, F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.when(F.col("l_suppkey") % 11 == 0, "x").otherwise("12"), F.lit("9"), (F.col("l_quantity") * 2.5).cast("string"), F.col("l_returnflag")]
    lines = table(spark, folder, "lineitem").select(F.concat_ws("\t", *fields).alias("line"))
    return evidence.scanner_rows(lines, "line").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("most"))


def override_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Orders' statuses replaced by those of lines of the same shape."""
    base = table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("shape"), F.col("o_orderstatus").alias("value"))
    changed = table(spark, folder, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 3).alias("shape"), F.col("l_returnflag").alias("value"))
    return evidence.overrides(base, changed, "o_orderkey").select("o_orderkey", F.coalesce("value", F.lit("")).alias("value"), "state")


def contract_subtotals(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as contracts; neighbours by tens are aliases of one."""
    supplier = table(spark, folder, "supplier")
    edges = supplier.where("s_suppkey % 10 in (1, 2)").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") - 1).alias("b"))
    amounts = supplier.select(F.col("s_suppkey").alias("contract"), F.when(F.col("s_nationkey") < 20, "EUR").otherwise("USD").alias("currency"), F.abs(F.col("s_acctbal")).cast("decimal(18,2)").alias("amount"), (F.col("s_suppkey") % 10 - F.when(F.col("s_suppkey") % 10 == 2, 1).otherwise(0)).alias("signature"))
    out = evidence.contract_subtotals(amounts, components(edges))
    return out.withColumn("subtotal", F.col("subtotal").cast("double"))


def canonical_digests(spark: SparkSession, folder: str) -> DataFrame:
    columns = {"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.when(F.col("p_size") > 5, F.col("p_size"))}
    return table(spark, folder, "part").select("p_partkey", evidence.canonical_digest(columns).alias("digest"))


QUERIES = {f.__name__: f for f in (fact_merge, suggested_demotion, event_freshness, link_validation, page_containment, span_merge, chosen_page_text, table_headers, unit_captions, scanner_words, override_resolution, contract_subtotals, canonical_digests)}

SQL = {
    "fact_merge": """
WITH f AS (SELECT o_custkey, year(o_orderdate)::INT AS year, o_orderstatus AS s, CASE WHEN o_orderkey % 29 = 0 THEN 'USD' ELSE '' END AS c FROM orders),
k AS (SELECT *, max((s <> 'P')::INT) OVER (PARTITION BY o_custkey, year) AS others FROM f),
g AS (SELECT o_custkey, year, count(DISTINCT s || '/' || c) AS n, min(s) AS s FROM k WHERE NOT (s = 'P' AND others = 1) GROUP BY 1, 2)
SELECT o_custkey, year, CASE WHEN n = 1 AND s <> 'P' THEN s ELSE '' END AS value, CASE WHEN n = 1 AND s <> 'P' THEN 'KNOWN' ELSE 'UNKNOWN' END AS state, CASE WHEN n > 1 THEN 'LOCAL_FACT_CONFLICT' ELSE '' END AS reason FROM g""",
    "suggested_demotion": "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'A') THEN 'UNKNOWN' ELSE 'MATCH' END AS verdict, bool_or(l_returnflag = 'A') AS hold FROM lineitem GROUP BY 1",
    "event_freshness": """
SELECT CASE WHEN o_orderkey % 7 > 2 THEN 'CONFIRMED_AT_EVENT' WHEN o_orderkey % 7 = 1 THEN 'DROPPED' WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN 'DOCUMENT_CONTINUITY' ELSE 'STATUS_UNRESOLVED' END AS state, count(*) AS n
FROM orders GROUP BY 1""",
    "link_validation": """
SELECT CASE WHEN o_orderkey IS NULL THEN 'ORDER_MISSING' WHEN p_partkey IS NULL THEN 'PART_MISSING' WHEN NOT coalesce(l_shipdate >= o_orderdate, FALSE) THEN 'SHIPPED_BEFORE_ORDER'
  WHEN NOT coalesce(l_extendedprice >= p_retailprice, FALSE) THEN 'PRICE_TOO_LOW' WHEN NOT coalesce(p_size <= 40, FALSE) THEN 'SIZE_TOO_LARGE' ELSE 'VALID' END AS code, count(*) AS n
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    "page_containment": """
SELECT l_orderkey AS doc, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber BETWEEN o_orderkey % 4 + 1 AND o_orderkey % 4 + o_custkey % 3 + 1 GROUP BY 1""",
    "span_merge": """
WITH s AS (SELECT user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 3600 * (event_id % 5 + 1) AS b FROM events),
r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
n AS (SELECT *, sum((reach IS NULL OR a > reach)::INT) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT user_id, min(a) AS start, max(b) AS "end" FROM n GROUP BY user_id, run""",
    "chosen_page_text": """
WITH b AS (SELECT conv_id AS page, role = 'assistant' AS scan, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS spot FROM conversations WHERE role <> 'system'),
t AS (SELECT page, string_agg(text, ' ' ORDER BY spot) FILTER (scan) AS s, string_agg(text, ' ' ORDER BY spot) FILTER (NOT scan) AS n FROM b WHERE spot <= 64 GROUP BY page)
SELECT page, CASE WHEN page % 3 = 0 AND coalesce(length(s), 0) > 0 THEN 'scan' ELSE 'native' END AS origin,
  substr(CASE WHEN page % 3 = 0 AND coalesce(length(s), 0) > 0 THEN s ELSE coalesce(n, '') END, 1, 240) AS text FROM t""",
    "table_headers": """
WITH c AS (SELECT p_partkey % 10 AS table_id, p_partkey AS row, lower(unnest(string_split(p_name || CASE WHEN p_size > 40 THEN ' 17' ELSE '' END, ' '))) AS t FROM part)
SELECT table_id, row FROM c GROUP BY 1, 2 HAVING NOT bool_or(regexp_matches(t, '[0-9]')) AND count(*) FILTER (t IN ('small', 'red', 'ring', 'bolt', 'widget')) >= 2
  AND bool_or(t IN ('small', 'red')) AND (bool_or(t IN ('ring', 'bolt')) OR bool_or(t = 'widget'))""",
    "unit_captions": """
WITH t AS (SELECT p_partkey % 50 AS page, p_partkey AS id, p_size::DOUBLE AS l, p_size + 30.0 AS r, (p_partkey % 7) * 40.0 AS top FROM part),
n AS (SELECT s_suppkey % 50 AS page, s_suppkey % 40 AS l, s_suppkey % 40 + 20 AS r, (s_suppkey % 7) * 40.0 - 5 AS b, CASE WHEN s_nationkey % 2 = 0 THEN 'thousand' ELSE 'one' END AS unit FROM supplier),
f AS (SELECT id, count(DISTINCT unit) AS n, min(unit) AS u FROM t JOIN n ON t.page = n.page AND top - b BETWEEN 0 AND 20 AND least(t.r, n.r) - greatest(t.l, n.l) >= 10 GROUP BY id)
SELECT t.id AS table_id, CASE WHEN n = 1 THEN 'UNIQUE' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'NONE' END AS state, CASE WHEN n = 1 THEN u ELSE '' END AS unit FROM t LEFT JOIN f ON t.id = f.id""",
    "scanner_words": """
SELECT l_returnflag AS word, count(*) AS n, max(l_quantity * 2.5::DOUBLE) AS most FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_suppkey % 11 <> 0 AND l_quantity * 2.5 <= 100 GROUP BY 1""",
    "override_resolution": """
WITH c AS (SELECT l_orderkey AS k, l_suppkey % 3 AS shape, count(*) AS n, min(l_returnflag) AS v FROM lineitem WHERE l_quantity > 30 GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN n = 1 THEN v WHEN n IS NULL THEN o_orderstatus ELSE '' END AS value, CASE WHEN n > 1 THEN 'CONFLICT' WHEN n = 1 THEN 'REPLACED' ELSE 'BASE' END AS state
FROM orders LEFT JOIN c ON k = o_orderkey AND shape = o_custkey % 3""",
    "contract_subtotals": """
WITH s AS (
  SELECT CASE s_suppkey % 10 WHEN 1 THEN s_suppkey - 1 WHEN 2 THEN s_suppkey - 2 ELSE s_suppkey END AS contract, CASE WHEN s_nationkey < 20 THEN 'EUR' ELSE 'USD' END AS currency,
    abs(s_acctbal)::DECIMAL(18,2) AS amount, s_suppkey % 10 - CASE WHEN s_suppkey % 10 = 2 THEN 1 ELSE 0 END AS signature FROM supplier),
c AS (SELECT currency, contract, count(DISTINCT signature) = count(*) AS ok, max(amount) AS amount FROM s GROUP BY 1, 2)
SELECT currency, CASE WHEN count(*) FILTER (ok) >= 2 THEN (sum(amount) FILTER (ok))::DOUBLE END AS subtotal, count(*) FILTER (ok) AS n_contracts, count(*) FILTER (NOT ok) AS n_omitted FROM c GROUP BY 1""",
    "canonical_digests": """
SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || CASE WHEN p_size > 5 THEN '"' || p_size || '"' ELSE 'null' END || '}') AS digest FROM part""",
}
