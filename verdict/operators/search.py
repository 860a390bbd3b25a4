"""Text search and ranking over token arrays: no index is assumed, tokens are columns that prune like any others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from verdict.functions.binding import let
from verdict.functions.checkpoints import checkpoint
from verdict.functions.text import similarity, tokens, trigrams, words

#: Bounds of a query.
QUERY_CHARS, RESULTS, SIMILAR = 160, 50, 0.4


#: Passages that are counted against a block of queries at once.
PASSAGES = 128
#: Fixed value: what a cover without other words adds to a rank.
COVER = 0.1


def cover_density(found: Column, n_terms: Column) -> Column:
    """The cover-density rank of a text from the places of a query's terms: array<struct<pos,term>> by place, terms from 1 to n_terms.

    A cover is a stretch that holds every term and no shorter stretch that does; each adds COVER / (1 + its other words). The stretch that
    ends at a place begins at the least of the terms' last places; it is a cover where it begins later than the one before it. One pass
    with the last place of each term as state; 0 where a term is missing.
    """
    place = "struct<pos:int,nth:int>"
    start = F.struct(F.array_repeat(F.lit(None).cast(place), n_terms).alias("last"), F.lit(0).alias("nth"), F.lit(0).alias("begun"), F.lit(0.0).alias("rank"))

    def step(state: Column, x: Column) -> Column:
        nth = (state["nth"] + 1).alias("nth")
        own = F.struct(x["pos"].cast("int").alias("pos"), nth)
        moved = F.transform(state["last"], lambda v, i: F.when(i + 1 == x["term"], own).otherwise(v))

        def judged(last: Column) -> Column:
            first = F.when(F.forall(last, lambda v: v.isNotNull()), F.array_min(last))
            fresh = F.coalesce(first["pos"] > state["begun"], F.lit(False))
            others = (x["pos"] - first["pos"]) - (state["nth"] + 1 - first["nth"])
            return F.struct(last.alias("last"), nth, F.when(fresh, first["pos"]).otherwise(state["begun"]).alias("begun"), (state["rank"] + F.when(fresh, COVER / (1 + others)).otherwise(0.0)).alias("rank"))

        return let(moved, judged)

    return F.aggregate(found, start, step, lambda s: s["rank"]).cast("float")


def ranked(corpus: DataFrame, queries: list[str], *, id_column: str, title: str, text: str, page: str | None = None, limit: int = 10) -> DataFrame:
    """For each query its best `limit` rows: query, position, id, relevance, similarity.

    A row is found that holds every token of the query in title or text, or whose title is similar to it. Order: cover-density rank,
    similarity of the title, page, id. Each text is cut to words once for all queries; what no query finds ends there, and only the
    best of each task are shuffled. A query is 1 to 160 characters; anything else, or another limit than 1 to 50, is INVALID_QUERY.
    """
    asked = [q.strip() for q in queries]
    if not asked or any(not 0 < len(q) <= QUERY_CHARS for q in asked) or not 1 <= limit <= RESULTS:
        raise ValueError("INVALID_QUERY")
    each = F.array(*(F.struct(F.lit(q).alias("query"), words(F.lit(q)).alias("all"), trigrams(F.lit(q)).alias("grams")) for q in asked))
    own = corpus.select(F.col(id_column), (F.col(page) if page else F.lit(0)).alias("_page"), F.coalesce(F.col(title), F.lit("")).alias("_title"), words(F.concat_ws(" ", title, text)).alias("_words"))
    own = own.withColumn("_held", F.array_distinct("_words")).withColumn("_grams", trigrams(F.col("_title")))
    tried = own.select("*", F.explode(F.filter(F.transform(each, lambda q: F.struct(q["query"].alias("query"), F.array_distinct(q["all"]).alias("terms"), similarity(F.col("_grams"), q["grams"]).alias("similarity"))),
        lambda q: (q["similarity"] >= SIMILAR) | (F.size(q["terms"]) > 0) & (F.size(F.array_except(q["terms"], F.col("_held"))) == 0))).alias("q"))
    places = F.filter(F.transform("_words", lambda w, i: F.struct((i + 1).alias("pos"), F.array_position(F.col("q.terms"), w).alias("term"))), lambda x: x["term"] > 0)
    scored = tried.select(F.col("q.query").alias("query"), id_column, "_page", cover_density(places, F.size("q.terms")).alias("relevance"), F.col("q.similarity").alias("similarity"))
    best = Window.partitionBy("query").orderBy(F.col("relevance").desc(), F.col("similarity").desc(), "_page", id_column)
    return scored.withColumn("position", F.row_number().over(best)).where(F.col("position") <= limit).select("query", "position", id_column, "relevance", "similarity")


def search(corpus: DataFrame, query: str, **how) -> DataFrame:
    """The best rows for one query, as `ranked` finds them."""
    return ranked(corpus, [query], **how).drop("query")


def overlap_top(queries: DataFrame, passages: DataFrame, query_id: str, passage_id: str, text: str, *, per_query: int = 2, least: int = 1, query_block: int = 4096) -> DataFrame:
    """For each query the passages that share most distinct tokens with it: (query_id, position, passage_id, score).

    Every query is scored against every passage, common tokens included. Queries have at most 64 tokens each; a block
    of `query_block` queries is broadcast as lists of queries by token, passages are cut to tokens once, and a
    task keeps its best `per_query` passages of each query, so only these are shuffled. Ties go to the smaller id. A
    query without tokens, or that shares fewer than `least` with every passage, has no row. Ids of queries are unique.
    """
    spark = queries.sparkSession
    asked = checkpoint(queries.select(query_id, tokens(F.col(text), 64).alias("_q")).where(F.size("_q") > 0))
    blocks = max(1, -(-asked.count() // query_block))
    q_kind, p_kind = dict(queries.dtypes)[query_id], dict(passages.dtypes)[passage_id]
    held = passages.select(passage_id, F.array_distinct(F.filter(words(F.col(text)), lambda w: F.length(w).between(2, 64))).alias("_p"))
    held = checkpoint(held) if blocks > 1 else held  # cut to tokens once for all blocks
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == block).collect()
        by_token: dict[str, list[int]] = {}
        for i, (_, asked_words) in enumerate(rows):
            for w in asked_words:
                by_token.setdefault(w, []).append(i)
        ends = np.cumsum([0, *map(len, by_token.values())])
        of_token = np.array([i for own in by_token.values() for i in own], np.int64)
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], list(by_token), ends, of_token))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vocabulary, ends, of_token = shared.value
            vocabulary = pa.array(vocabulary, pa.string())
            every = np.arange(len(ids))
            score = np.zeros((per_query, len(ids)), np.int64)
            passage = np.full((per_query, len(ids)), None, object)
            for batch in batches:
                own_ids = batch.column(0).to_pylist()
                order = sorted((j for j, x in enumerate(own_ids) if x is not None), key=own_ids.__getitem__)
                for start in range(0, len(order), PASSAGES):
                    part = order[start : start + PASSAGES]
                    lists = batch.column(1).take(pa.array(part))
                    of = np.repeat(np.arange(len(part)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                    token = pc.index_in(lists.flatten().cast(pa.string()), vocabulary)
                    asked_for = pc.is_valid(token).to_numpy(zero_copy_only=False)
                    token, of = pc.drop_null(token).to_numpy(), of[asked_for]
                    many = ends[token + 1] - ends[token]
                    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    cell = np.repeat(of, many) * len(ids) + of_token[np.repeat(ends[token], many) + inside]
                    n = np.bincount(cell, minlength=len(part) * len(ids)).reshape(len(part), len(ids))
                    for _ in range(per_query):
                        top = n.argmax(0)  # the first of equals, which has the smallest id
                        most = n[top, every]
                        n[top, every] = 0
                        for i in np.flatnonzero((most >= least) & (most >= score[-1])):
                            own = own_ids[part[top[i]]]
                            at = next((k for k in range(per_query) if passage[k, i] is None or (-most[i], own) < (-score[k, i], passage[k, i])), None)
                            if at is not None:
                                score[at + 1 :, i], passage[at + 1 :, i] = score[at:-1, i].copy(), passage[at:-1, i].copy()
                                score[at, i], passage[at, i] = most[i], own
            k, i = np.nonzero(score)
            columns = ([ids[x] for x in i], passage[k, i].tolist(), score[k, i].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], names)

        names = [query_id, passage_id, "score"]
        kinds = list(to_arrow_schema(StructType([queries.schema[query_id], passages.schema[passage_id], StructField("score", IntegerType())])))
        own = held.mapInArrow(best, f"`{query_id}` {q_kind}, `{passage_id}` {p_kind}, score int")
        found = own if found is None else found.unionByName(own)
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("score").desc(), passage_id))
    return found.withColumn("position", place).where(F.col("position") <= per_query).select(query_id, "position", passage_id, "score")


def substring_score(text, asked):
    """How many of the tokens in the array occur in the text as substrings."""
    return F.size(F.filter(asked, lambda w: F.contains(text, w)))


def in_force(corpus: DataFrame, editions: DataFrame, edition: str, *, only: object | None = None, on: object | None = None, insurer: str | None = None, product: str | None = None) -> DataFrame:
    """The rows of corpus whose edition passes the filters that are set: itself, in force on a day, of an insurer, of a product.

    editions: edition, start, end (inclusive, null is open), insurer, product. The filters reach the editions before the join.
    """
    kept = editions
    if only is not None:
        kept = kept.where(F.col(edition) == F.lit(only))
    if on is not None:
        day = F.lit(on).cast("date")
        kept = kept.where(F.coalesce(F.col("start") <= day, F.lit(True)) & F.coalesce(F.col("end") >= day, F.lit(True)))
    if insurer is not None:
        kept = kept.where(F.col("insurer") == insurer)
    if product is not None:
        kept = kept.where(F.col("product") == product)
    return corpus.join(kept.select(edition).distinct(), edition, "left_semi")


def recommended(scored: DataFrame, coverage: str, order: list[str], *, per_coverage: int = 2, most: int = 12) -> DataFrame:
    """The best associations of passages with coverages: two for each coverage and priority, twelve in all.

    scored: coverage, priority (1, 2), score, coverage_score, clause_score and the columns of order, which break ties. Priority 2
    needs a score, priority 1 also words of the coverage and of the clause; priority 2 comes first.
    """
    usable = ((F.col("priority") == 2) & (F.col("score") > 0)) | ((F.col("priority") == 1) & (F.col("coverage_score") > 0) & (F.col("clause_score") > 0))
    place = F.row_number().over(Window.partitionBy(coverage, "priority").orderBy(F.col("score").desc(), *order))
    kept = scored.where(usable).withColumn("place", place).where(F.col("place") <= per_coverage)
    return kept.orderBy(F.col("priority").desc(), "place", F.col("score").desc(), coverage, *order).limit(most)
