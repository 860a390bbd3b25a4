"""Queries of search, text quality, redaction, chunking and document structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.functions import text as texts
from verdict.operators import documents, search
from verdict.sources.tables import table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))


def token_and_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best documents that hold all tokens of a query, or have them in their title; their first 320 characters come from a join after the limit."""
    docs = _docs(spark, folder).withColumn("title", F.substring("text", 1, 40))
    hits = search.search(docs, "is the", id_column="doc_id", title="title", text="text", limit=20)
    own = docs.select("doc_id", texts.excerpt(F.col("text")).alias("excerpt"))
    return hits.join(own, "doc_id").select("doc_id", "position", F.round("relevance", 4).alias("relevance"), "excerpt")


RANKED = ("of the", "the is and", "that", "die der und", "de la", "Le  des, les", "in in the", "nowhere found")


def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """Several queries over whole documents in one pass, by cover density."""
    docs = _docs(spark, folder).withColumn("title", F.substring("text", 1, 12))
    return search.ranked(docs, list(RANKED), id_column="doc_id", title="title", text="text", limit=50).select("query", "position", "doc_id", F.round("relevance", 4).alias("relevance"))


def trigram_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Part names with their similarity to a misspelt one."""
    names = table(spark, folder, "part").select("p_name").distinct()
    close = texts.similarity(texts.trigrams(F.col("p_name")), texts.trigrams(F.lit("smal widgett")))
    return names.select("p_name", close.alias("similarity")).where(F.col("similarity") > 0.2)


def overlap_topk(spark: SparkSession, folder: str) -> DataFrame:
    """For each benchmark passage the two documents that share most tokens with it."""
    queries = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("body"))
    docs = _docs(spark, folder).select("doc_id", F.col("text").alias("body"))
    return search.overlap_top(queries, docs, "item_id", "doc_id", "body")


def substring_score(spark: SparkSession, folder: str) -> DataFrame:
    asked = F.array(*map(F.lit, ("the", "tion", "ung", "que", "zzz")))
    return _docs(spark, folder).select("doc_id", search.substring_score(F.col("text"), asked).alias("score"))


def text_normalization(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", texts.spaced(texts.nfc("text")).alias("normalized")).select("doc_id", F.length("normalized").alias("length"), F.md5(F.col("normalized").cast("binary")).alias("digest"))


def search_tokens(spark: SparkSession, folder: str) -> DataFrame:
    tokens = texts.tokens(F.col("text"), 64)
    return _docs(spark, folder).select("doc_id", F.size(tokens).alias("n"), F.array_join(tokens, " ").alias("tokens"))


def folded_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct tokens after compatibility composition and case folding."""
    return _docs(spark, folder).select("doc_id", texts.folded("text").alias("folded")).select("doc_id", F.size(texts.tokens(F.col("folded"))).alias("n_tokens"))


def page_quality(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", texts.quality(F.col("text")).alias("quality"))


def page_quality_measures(spark: SparkSession, folder: str) -> DataFrame:
    m = texts.quality_measures(F.col("text"))
    return _docs(spark, folder).select("doc_id", m["solid"].alias("solid"), m["alphanumeric_ratio"].alias("alphanumeric_ratio"), m["replacement_ratio"].alias("replacement_ratio"))


def redact_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts without identifiers: how many marks there are, and a digest."""
    redacted = texts.redacted(F.col("text"), ("Apache License",), None)
    marks = (F.length("redacted") - F.length(F.replace("redacted", F.lit(texts.REDACTED), F.lit("")))) / len(texts.REDACTED)
    return _docs(spark, folder).select("doc_id", redacted.alias("redacted")).select("doc_id", marks.cast("int").alias("n_marks"), F.length("redacted").alias("length"))


ROLES = {"licence": [r"licen[sc]e"], "mail": [r"@[a-z0-9.-]+\.[a-z]{2,}"], "table": [r"\|", r"\n"]}


def role_classify(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", documents.role(F.col("text"), ROLES).alias("role"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "text"))


def chunk_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each document as nodes: short ones stay whole, every third is running text that may be cut."""
    lines = _lines(spark, folder)
    kind = F.when(F.col("line") % 3 == 0, "TEXT").when(F.col("line") % 3 == 1, "LINE").otherwise("ROW")
    nodes = lines.select("doc", F.col("line").alias("node"), kind.alias("kind"), "text", F.when(F.col("line") % 7 == 6, 900).otherwise(100).alias("context_chars"))
    return documents.chunk_plan(nodes, max_content=400, max_context=500, max_chunks=12).select("doc", "node", "start", "end", F.coalesce("reason", F.lit("CHUNK")).alias("reason"))


def envelope_packing(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder).where(F.length("text") > 0)
    slices = lines.select("doc", F.col("line").alias("slice"), F.length("text").alias("chars"), (F.col("line") % 4).cast("string").alias("context"), (F.col("line") % 4 * 50).alias("context_chars"))
    packed = documents.pack(slices, max_slices=8, max_chars=1500, max_envelopes=4)
    return packed.groupBy("doc").agg(F.count_distinct("envelope").alias("n_envelopes"), F.count("envelope").alias("n_packed"), F.count("reason").alias("n_left"))


def heading_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of pages that begin with a numbered heading tag open regions, if the numbers increase."""
    lines = _pages(spark, folder).select(F.col("page_id").alias("doc"), F.posexplode(F.split("html", "\n")).alias("line", "text"))
    return documents.regions(lines, r"<h([1-6])")


def _tables(spark: SparkSession, folder: str) -> DataFrame:
    """Line items of an order as tables on pages: the line number is the page."""
    t = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_suppkey") % 3).alias("n_columns")).agg(F.min("l_partkey").alias("table_id"), F.min("l_quantity").alias("left"), F.bool_or(F.col("l_tax") < 0.06).alias("marked"))
    return t


def table_continuation(spark: SparkSession, folder: str) -> DataFrame:
    return documents.continuation(_tables(spark, folder), 10.0).select("doc", "page", "table_id", F.coalesce("parent", F.lit(-1)).alias("parent"))


def role_propagation(spark: SparkSession, folder: str) -> DataFrame:
    """One table for each page of an order; unknown ones take the role of the table that they continue."""
    one = _tables(spark, folder).groupBy("doc", "page").agg(F.min("table_id").alias("table_id"), F.bool_or("marked").alias("marked"))
    before = one.select("doc", (F.col("page") + 1).alias("page"), F.col("table_id").alias("_before"))
    linked = one.join(before, ["doc", "page"], "left").withColumn("parent", F.when(F.col("marked"), F.col("_before")))
    role = F.when(F.col("table_id") % 5 == 0, "policy").when(F.col("table_id") % 5 == 1, "terms").otherwise("unknown")
    return documents.carried_role(linked.withColumn("role", role)).select("doc", "page", "role", "carried")


def box_normalize(spark: SparkSession, folder: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    b = documents.box(d("l_discount") * 100, d("l_tax") * 100, d("l_quantity"), d("l_quantity") + 5, F.lit(45.0), F.lit(60.0))
    lines = table(spark, folder, "lineitem").select("l_orderkey", b.alias("b"))
    return lines.groupBy("l_orderkey").agg(F.count("b").alias("n_boxes"), F.count(F.lit(1)).alias("n"))


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Words of pages laid out by a rule, grouped to lines."""
    words = _pages(spark, folder).select(F.col("page_id").alias("page"), F.posexplode(F.split("html", r"\s+")).alias("position", "word"))
    row = F.floor(F.col("position") / 7)
    left = (F.col("position") % 7) * 50.0
    boxes = words.select("page", "position", left.alias("left"), (left + F.least(F.length("word"), F.lit(12)) * 4.0).alias("right"), (row * 12.0 + F.col("position") % 2).alias("top"), (row * 12.0 + 10 + F.col("position") % 2).alias("bottom"))
    return documents.text_lines(boxes).groupBy("page").agg((F.max("line") + 1).alias("n_lines"), F.count(F.lit(1)).alias("n_words"))


def line_views(spark: SparkSession, folder: str) -> DataFrame:
    """Words of pages in two columns, some in rows of tables, some of another layer, as views of lines; how many compete with another column."""
    words = _pages(spark, folder).select(F.col("page_id").alias("page"), F.posexplode(F.split("html", r"\s+")).alias("position", "word"))
    row, place = F.floor(F.col("position") / 6), F.col("position") % 6
    left = (row % 2) * 300.0 + place * 48.0 + F.when(F.col("position") % 11 == 0, 16.0).otherwise(0.0)
    top = F.floor(row / 2) * 14.0 + F.when(F.length("word") % 5 == 0, 3.0).otherwise(0.0)
    nodes = words.select(
        "page", "position", F.concat_ws("-", "page", "position").alias("node"), F.when(F.length("word") % 17 == 0, "TABLE_ROW").otherwise("BLOCK").alias("kind"), (F.length("word") % 19 != 0).alias("schedulable"),
        F.col("position").alias("reading_order"), F.when(F.length("word") % 13 == 0, "ocr").otherwise("native").alias("layer"), F.col("word").alias("text"), left.alias("left"), top.alias("top"),
        (left + F.least(F.length("word"), F.lit(12)) * 4.0).alias("right"), (top + 10).alias("bottom"),
    )
    views, _ = documents.line_views(nodes)
    return views.groupBy("page").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("spans")).alias("n_words"), F.count("issue").alias("n_unresolved"), F.sum(F.length("text")).alias("n_chars"))


QUERIES = {f.__name__: f for f in (line_views, token_and_search, ranked_search, trigram_titles, overlap_topk, substring_score, text_normalization, search_tokens, folded_tokens, page_quality, page_quality_measures, redact_pii, role_classify, chunk_plan, envelope_packing, heading_regions, table_continuation, role_propagation, box_normalize, text_lines)}

_TOKENS = r"list_sort(list_distinct(list_filter(string_split(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) BETWEEN 2 AND 64)))"
_TRIGRAMS = r"list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_D = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_NODES = """
lines AS (
  SELECT doc_id AS doc, unnest(range(len(string_split(coalesce(text, ''), chr(10)))))::INT AS node, unnest(string_split(coalesce(text, ''), chr(10))) AS text
  FROM documents)"""
_TABLES = "t AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_suppkey % 3 AS n_columns, min(l_partkey) AS table_id, min(l_quantity) AS l, bool_or(l_tax < 0.06::DOUBLE) AS marked FROM lineitem GROUP BY 1, 2, 3)"


def _ranked_sql(queries: tuple[str, ...], title: int, limit: int, more: str = "") -> str:
    """Cover density by windows: at each place of a term the last places of all terms (up to three)."""
    split = r"list_filter(string_split(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    last = lambda c: [f"max(CASE WHEN term = {i} OR n < {i} THEN {c} END) OVER w" for i in (1, 2, 3)]
    least = lambda c: f"CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in last(c))} THEN least({', '.join(last(c))}) END"
    return f"""
WITH {_D}, t AS (SELECT doc_id, text, substr(text, 1, {title}) AS title, {split.format(x=f"substr(text, 1, {title}) || ' ' || text")} AS words, {_TRIGRAMS.format(x=f"substr(text, 1, {title})")} AS g FROM d),
q AS (SELECT query, list_distinct({split.format(x="query")}) AS terms, {_TRIGRAMS.format(x="query")} AS h FROM (SELECT unnest({list(queries)!r}) AS query)),
hit AS (
  SELECT *, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h)))::DOUBLE AS similarity FROM (SELECT doc_id, words, g FROM t) CROSS JOIN q
  WHERE len(terms) > 0 AND len(list_filter(terms, lambda x: NOT list_contains(words, x))) = 0 OR len(list_intersect(g, h)) >= 0.4 * (len(g) + len(h) - len(list_intersect(g, h)))),
p AS (SELECT query, doc_id, len(terms) AS n, pos, list_position(terms, words[pos]) AS term FROM hit, unnest(range(1, len(words) + 1)) AS r(pos) WHERE list_contains(terms, words[pos])),
o AS (SELECT *, row_number() OVER (PARTITION BY query, doc_id ORDER BY pos) AS nth FROM p),
s AS (SELECT *, {least("pos")} AS begun, {least("nth")} AS begun_nth FROM o WINDOW w AS (PARTITION BY query, doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
c AS (SELECT * FROM s QUALIFY begun IS NOT NULL AND begun > coalesce(lag(begun) OVER (PARTITION BY query, doc_id ORDER BY pos), 0)),
r AS (SELECT query, doc_id, sum(0.1::DOUBLE / (1 + (pos - begun) - (nth - begun_nth)) ORDER BY pos)::FLOAT AS relevance FROM c GROUP BY query, doc_id),
z AS (
  SELECT query, (row_number() OVER (PARTITION BY query ORDER BY coalesce(relevance, 0) DESC, similarity DESC, doc_id))::INT AS position, doc_id, coalesce(relevance, 0)::FLOAT AS relevance
  FROM hit LEFT JOIN r USING (query, doc_id) QUALIFY position <= {limit})
SELECT {more or "query"}, doc_id, position, round(relevance, 4)::FLOAT AS relevance FROM z{" JOIN d USING (doc_id)" if more else ""}"""


SQL = {
    "token_and_search": _ranked_sql(("is the",), 40, 20, "substr(text, 1, 320) AS excerpt"),
    "ranked_search": _ranked_sql(RANKED, 12, 50),
    "trigram_titles": f"""
WITH x AS (SELECT DISTINCT p_name, {_TRIGRAMS.format(x="p_name")} AS a, {_TRIGRAMS.format(x="'smal widgett'")} AS b FROM part),
y AS (SELECT p_name, len(list_intersect(a, b)) AS n, len(a) + len(b) AS m FROM x)
SELECT p_name, n::DOUBLE / (m - n) AS similarity FROM y WHERE n::DOUBLE / (m - n) > 0.2::DOUBLE""",
    "overlap_topk": f"""
WITH {_D}, p AS (SELECT doc_id, unnest({_TOKENS.format(x="text")}) AS w FROM d),
q AS (SELECT item_id, unnest({_TOKENS.format(x="text")}[1:64]) AS w FROM benchmark),
s AS (SELECT item_id, doc_id, count(*) AS score FROM q JOIN p USING (w) GROUP BY 1, 2)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS position, doc_id, score::INT AS score FROM s QUALIFY position <= 2""",
    "substring_score": f"WITH {_D} SELECT doc_id, (contains(text, 'the')::INT + contains(text, 'tion')::INT + contains(text, 'ung')::INT + contains(text, 'que')::INT + contains(text, 'zzz')::INT) AS score FROM d",
    "text_normalization": rf"""
WITH {_D}, x AS (SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '\p{{P}}', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM d)
SELECT doc_id, length(n)::INT AS length, md5(n) AS digest FROM x""",
    "search_tokens": f"""
WITH {_D}, x AS (SELECT doc_id, {_TOKENS.format(x="text")}[1:64] AS t FROM d)
SELECT doc_id, len(t)::INT AS n, array_to_string(t, ' ') AS tokens FROM x""",
    "page_quality_measures": rf"""
WITH {_D}, x AS (SELECT doc_id, text, length(regexp_replace(text, '\s', '', 'g')) AS solid, length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS letters FROM d)
SELECT doc_id, solid::INT AS solid, letters::DOUBLE / greatest(solid, 1) AS alphanumeric_ratio,
  (length(text) - length(replace(text, chr(65533), '')))::DOUBLE / greatest(length(text), 1) AS replacement_ratio FROM x""",
    "role_classify": rf"""
WITH {_D}, x AS (
  SELECT doc_id, regexp_matches(lower(text), 'licen[sc]e') AS a, regexp_matches(lower(text), '@[a-z0-9.-]+\.[a-z]{{2,}}') AS b, contains(text, '|') AND contains(text, chr(10)) AS c FROM d)
SELECT doc_id, CASE WHEN a::INT + b::INT + c::INT > 1 THEN 'ambiguous' WHEN a THEN 'licence' WHEN b THEN 'mail' WHEN c THEN 'table' ELSE 'unknown' END AS role FROM x""",
    "chunk_plan": f"""
WITH {_NODES},
n AS (
  SELECT doc, node, length(text) AS size, CASE node % 3 WHEN 0 THEN 'TEXT' WHEN 1 THEN 'LINE' ELSE 'ROW' END AS kind, CASE WHEN node % 7 = 6 THEN 900 ELSE 100 END AS context
  FROM lines WHERE length(text) > 0),
r AS (SELECT *, CASE WHEN kind <> 'TEXT' AND size > 400 THEN kind || '_EXCEEDS_CONTENT_BUDGET' WHEN context > 500 THEN 'CONTEXT_EXCEEDS_BUDGET' END AS reason FROM n),
p AS (SELECT *, CASE WHEN reason IS NULL THEN ceil(size / 400)::INT ELSE 0 END AS parts FROM r),
f AS (SELECT *, least(parts, greatest(12 - coalesce(sum(parts) OVER (PARTITION BY doc ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0))::INT AS fit FROM p)
SELECT doc, node, (i * 400)::INT AS start, least(i * 400 + 400, size)::INT AS "end", 'CHUNK' AS reason FROM (SELECT *, unnest(range(fit)) AS i FROM f)
UNION ALL SELECT doc, node, CASE WHEN reason IS NULL THEN fit * 400 ELSE 0 END::INT, size::INT, coalesce(reason, 'CHUNK_BUDGET_EXHAUSTED') FROM f WHERE fit < parts OR reason IS NOT NULL""",
    "heading_regions": """
WITH lines AS (
  SELECT page_id AS doc, unnest(range(len(string_split(coalesce(html, ''), chr(10)))))::INT AS line, unnest(string_split(coalesce(html, ''), chr(10))) AS text FROM pages),
m AS (SELECT doc, line, CASE WHEN regexp_matches(text, '<h([1-6])') THEN regexp_extract(text, '<h([1-6])', 1)::INT END AS n FROM lines),
r AS (SELECT *, count(n) OVER (PARTITION BY doc ORDER BY line) AS region FROM m),
h AS (SELECT doc, n, region, lag(n) OVER (PARTITION BY doc ORDER BY line) AS b FROM r WHERE n IS NOT NULL),
ok AS (SELECT doc, max(region) AS last FROM h GROUP BY doc HAVING bool_and(coalesce(b < n, TRUE)))
SELECT r.doc, max(n)::INT AS number, min(line)::INT AS first_line, max(line)::INT AS last_line, r.region < last AS complete
FROM r JOIN ok ON r.doc = ok.doc WHERE region > 0 GROUP BY r.doc, r.region, last""",
    "table_continuation": f"""
WITH {_TABLES},
p AS (SELECT t.doc, t.table_id, count(*) AS n, min(b.table_id) AS parent FROM t JOIN t b ON t.doc = b.doc AND b.page + 1 = t.page AND b.n_columns = t.n_columns AND abs(t.l - b.l) <= 10 WHERE t.marked GROUP BY 1, 2)
SELECT t.doc, t.page, t.table_id, coalesce(CASE WHEN n = 1 THEN parent END, -1) AS parent FROM t LEFT JOIN p ON t.doc = p.doc AND t.table_id = p.table_id""",
    "role_propagation": f"""
WITH RECURSIVE {_TABLES},
o AS (SELECT doc, page, min(table_id) AS id, bool_or(marked) AS marked FROM t GROUP BY 1, 2),
r AS (SELECT *, CASE id % 5 WHEN 0 THEN 'policy' WHEN 1 THEN 'terms' ELSE 'unknown' END AS role FROM o),
c AS (
  SELECT r.doc, r.page, r.role, r.role AS carried FROM r LEFT JOIN r b ON r.doc = b.doc AND b.page + 1 = r.page WHERE NOT (r.marked AND b.id IS NOT NULL)
  UNION ALL SELECT r.doc, r.page, r.role, CASE WHEN r.role = 'unknown' THEN c.carried ELSE r.role END FROM c JOIN r ON r.doc = c.doc AND r.page = c.page + 1 WHERE r.marked)
SELECT doc, page, role, carried FROM c""",
    "box_normalize": """
SELECT l_orderkey, count(*) FILTER (l_discount * 100 >= 0 AND l_tax * 100 >= 0 AND l_discount * 100 < l_quantity AND l_tax * 100 < l_quantity + 5 AND l_quantity <= 45 AND l_quantity + 5 <= 60) AS n_boxes, count(*) AS n
FROM lineitem GROUP BY l_orderkey""",
}
