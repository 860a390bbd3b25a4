"""Operator 8, mixing sources to target weights by weighted fair queueing, with DataFrame functions alone.

A document's size is its number of words. Each source's documents are shuffled (by the MD5 of their ids, of the text where
the id is null) and
queued twice over; an item's virtual finish time is the words its source has sent up to and including it, divided
by the source's target. All items are taken in the order of that time, until the budget is spent, so every source
advances at the pace of its target and no document is taken more than twice.

Targets: sources in code point order (null last) get the weights in turn and share `share` times all words; a
target stops at `repeats` times its source's size, and what it leaves is reshared by weight until none is above.

Running sums never gather a source in one task: documents are cut into ranges of their shuffle key, and these into
coarser ones. Sums of ranges are added up within the coarser range, those of coarser ranges within the source, and a
document adds its range's offset to the sum within its range. The cut is found the same way over ranges of the
finish time. The number of ranges follows the number of rows and does not change any result. The sources themselves, a
row each, are ordered in one task.

Null text has size 0. A null source is a source of its own. Rows of size 0 are never taken. Repeated rows are
documents each; rows that share an id are in order of size, then of a hash of the text. An empty table gives an empty
result. Other columns pass through `apply_mix` whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdict.llm.common import WORD, checkpoint

#: All finish times later than this many units fall in one range.
_LATE = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """_source, _rank, _total and _target from one row for each source with its words (_source, _total).

    The water level is the share that each unit of weight gets in the end: with sources in the order of the level
    at which they are full, it is the highest that the unfilled ones' weights allow.
    """
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("_rank", rank).withColumn("_weight", weight).withColumn("_full", F.lit(repeats) * F.col("_total"))
    by_level = Window.orderBy(F.col("_full") / F.col("_weight"), "_rank")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("_full").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("_level", (F.lit(share) * F.sum("_total").over(everything) - before) / open_weight)
    level = F.max(F.when(F.col("_level") <= F.col("_full") / F.col("_weight"), F.col("_level"))).over(everything)
    return x.withColumn("_target", F.least(F.col("_full").cast("double"), level * F.col("_weight"))).select("_source", "_rank", "_total", "_target")


def _timed(keyed: DataFrame, offsets: DataFrame) -> DataFrame:
    """keyed with _first and _second: the finish times of a document's two items."""
    within = Window.partitionBy("_rank", "_range").orderBy("_key", "_size", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    x = keyed.join(offsets, keyed["_source"].eqNullSafe(offsets["_of"]) & (keyed["_range"] == offsets["_at"]), "left").drop("_of", "_at")
    sent = F.col("_offset") + F.sum("_size").over(within)
    return x.withColumn("_first", F.try_divide(sent.cast("double"), "_target")).withColumn("_second", F.try_divide((F.col("_total") + sent).cast("double"), "_target"))


def _offsets(ranges: DataFrame, coarse: int) -> DataFrame:
    """ranges (_source, _range, _sum) with _offset, the words of the source's ranges before; coarse: digits of a coarser range."""
    wide = F.substring("_range", 1, coarse)
    until = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("_source", wide.alias("_wide")).agg(F.sum("_sum").alias("_sum"))
    sums = sums.select(F.col("_source").alias("_of"), "_wide", F.coalesce(F.sum("_sum").over(until("_source").orderBy("_wide")), F.lit(0)).alias("_before"))
    own = ranges.withColumn("_own", wide)
    own = own.withColumn("_offset", F.coalesce(F.sum("_sum").over(until("_source", "_own").orderBy("_range")), F.lit(0)))
    both = own.join(sums, own["_source"].eqNullSafe(sums["_of"]) & (own["_own"] == sums["_wide"]))
    return both.select("_source", "_range", (F.col("_offset") + F.col("_before")).alias("_offset"))


def mixed(docs: DataFrame, kept: list[str], *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Of every row of docs: _row, a struct of its kept columns, _size, _total (its source's words), _target (its source's) and _taken (words taken)."""
    if repeats != 2:
        raise ValueError("items are queued twice")
    rows = docs.count()
    digits = max(1, math.ceil(math.log(max(1, rows / 20_000), 16)) + 1)
    doc_id, text = F.col(f"`{id_column}`").cast("string"), F.col(f"`{text_column}`")
    key = F.md5(F.coalesce(doc_id, text, F.lit("")).cast("binary"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col(f"`{source_column}`").alias("_source"), word_count(text).alias("_size"), key.alias("_key"), F.xxhash64(text).alias("_tie"))
    keyed = own.withColumn("_range", F.substring("_key", 1, digits))
    slim = checkpoint(keyed.drop("_row"))
    ranges = slim.groupBy("_source", "_range").agg(F.sum("_size").alias("_sum"))
    sources = checkpoint(targets(ranges.groupBy("_source").agg(F.sum("_sum").alias("_total")), weights, share, repeats))
    offsets = _offsets(ranges, (digits + 1) // 2).join(sources.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of")))
    offsets = checkpoint(offsets.select("_of", F.col("_range").alias("_at"), "_offset", "_rank", "_total", "_target"))
    time, rank = _cut(_timed(slim, offsets), share * (sources.agg(F.sum("_total")).first()[0] or 0), 1 << math.ceil(math.log2(max(1024, 16 * math.sqrt(rows)))))
    last = F.struct(F.lit(time).cast("double"), F.lit(rank).cast("int"))
    taken = sum((F.when(F.struct(F.col(c), F.col("_rank")) <= last, F.col("_size")).otherwise(F.lit(0)) for c in ("_first", "_second")), F.lit(0).cast("long"))
    return _timed(keyed, offsets).select("_row", "_size", "_total", "_target", taken.alias("_taken"))


def _cut(timed: DataFrame, budget: float, per_unit: int) -> tuple[float, int]:
    """The finish time and source of the last item taken: the one before the first that would exceed the budget.

    per_unit: ranges of finish time in each unit; with their number near the square root of that of the rows,
    neither the sums of the ranges nor the items of the range that holds the cut are many.
    """
    items = timed.where("_size > 0").select("_size", "_rank", F.explode(F.array("_first", "_second")).alias("_time"))
    items = items.where("_time is not null").withColumn("_step", F.least(F.floor(F.col("_time") * per_unit), F.lit(_LATE * per_unit)).cast("long"))
    steps = items.groupBy("_step").agg(F.sum("_size").alias("_sum"))
    spent = F.sum("_sum").over(Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, 0))
    at = steps.withColumn("_spent", spent).where(F.col("_spent") > F.lit(budget)).orderBy("_step").first()
    if at is None:  # the budget covers everything
        return math.inf, 0
    before = at["_spent"] - at["_sum"]
    spent = F.lit(before) + F.sum("_size").over(Window.orderBy("_time", "_rank").rowsBetween(Window.unboundedPreceding, 0))
    inside = items.where(F.col("_step") == at["_step"]).groupBy("_time", "_rank").agg(F.sum("_size").alias("_size")).withColumn("_spent", spent)
    last = inside.where(F.col("_spent") <= F.lit(budget)).agg(F.max(F.struct("_time", "_rank")).alias("last")).first()["last"]
    return (last["_time"], last["_rank"]) if last else (at["_step"] / per_unit, -1)


def mix(docs: DataFrame, *, id_column: str = "doc_id", **how) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    x = mixed(docs, [id_column], id_column=id_column, **how)
    return x.select(F.col(f"_row.`{id_column}`").alias("doc_id"), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    x = mixed(docs, docs.columns, **how)
    times = F.when(F.col("_size") > 0, (F.col("_taken") / F.col("_size")).cast("int")).otherwise(0)
    return x.select("_row", F.explode(F.array_repeat(F.lit(1), times))).select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, text, '')) AS key
  FROM documents),
ranked AS (
  SELECT source, total, row_number() OVER (ORDER BY source NULLS LAST) AS rank, 2 * total AS filled
  FROM (SELECT source, sum(size)::BIGINT AS total FROM docs GROUP BY source)),
weighed AS (SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(total) OVER ())::DOUBLE
             - coalesce(sum(filled) OVER (ORDER BY filled / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY filled / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
targets AS (
  SELECT source, rank, total,
         least(filled::DOUBLE, (SELECT max(level) FROM levels WHERE level <= filled / weight) * weight) AS target
  FROM levels),
queued AS (
  SELECT doc_id, size, key, t.*, sum(size) OVER (PARTITION BY rank ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS sent
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
items AS (
  SELECT rank, size, sent::DOUBLE / target AS time FROM queued WHERE size > 0
  UNION ALL SELECT rank, size, (total + sent)::DOUBLE / target FROM queued WHERE size > 0),
spent AS (
  SELECT time, rank, sum(sum(size)) OVER (ORDER BY time, rank ROWS UNBOUNDED PRECEDING) AS spent FROM items GROUP BY time, rank),
last AS (
  SELECT time, rank FROM spent WHERE spent <= (SELECT 1.5 * sum(total) FROM targets) ORDER BY time DESC, rank DESC LIMIT 1)
SELECT doc_id, size, total AS source_size, target,
       CASE WHEN size > 0 THEN size * ((SELECT count(*) FROM last l WHERE (sent::DOUBLE / target, q.rank) <= (l.time, l.rank))
                                     + (SELECT count(*) FROM last l WHERE ((total + sent)::DOUBLE / target, q.rank) <= (l.time, l.rank)))
            ELSE 0 END AS taken
FROM queued q
"""
