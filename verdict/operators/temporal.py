"""As-of, interval, overlay and latest-version joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_as_of(probes: DataFrame, history: DataFrame, keys: list[str], day: str, at: str, status: str, current: Column) -> DataFrame:
    """probes with `as_of`: the status at the end of the probe's day.

    A probe without a day has `current`. Otherwise the rows at the latest moment up to and including the day count,
    all of them: several distinct statuses are "conflicting", none is "unknown", never the current one.
    Keys compare null-safe. The history is reduced to one row for each key and moment before the join, and the join
    is on the keys; the day is a condition within a key.
    """
    moments = history.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.collect_set(status).alias("_states"))
    renamed = moments.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(at).alias("_at"), "_states")
    # The answer depends on keys and day alone, so each of these is looked up once.
    asked = probes.select(*keys, day).distinct()
    on = F.col("_at") < F.date_add(F.col(day).cast("date"), 1).cast("timestamp_ntz")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    latest = asked.join(renamed, on).groupBy(*keys, day).agg(F.max_by("_states", "_at").alias("_states"))
    out = _beside(probes, latest, [*keys, day])
    state = (
        F.when(F.col(day).isNull(), current)
        .when(F.col("_states").isNull() | (F.size("_states") == 0), "unknown")
        .when(F.size("_states") > 1, "conflicting")
        .otherwise(F.col("_states")[0])
    )
    return out.withColumn("as_of", state).drop("_states")


def _beside(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of found, which has one row for each of the keys at most; nulls are equal."""
    renamed = found.select(*(F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)), *(c for c in found.columns if c not in keys))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_b{i}"))
    return rows.join(renamed, on, "left").drop(*(f"_b{i}" for i in range(len(keys))))


def within(day: Column, start: Column, end: Column) -> Column:
    """Inclusive at both ends; a null end is open. A null day is unknown."""
    return F.when(day.isNotNull(), F.coalesce(start <= day, F.lit(True)) & F.coalesce(day <= end, F.lit(True)))


def overlay(events: DataFrame, changes: DataFrame, scope: list[str], day: str, start: str, end: str, choice: str) -> DataFrame:
    """events with the choice of the most specific change in force on the day; several distinct ones conflict.

    A change's null scope column matches any value. The answer depends on scope and day alone, so each of these is looked
    up once. The join is by each set of scope columns that changes fill in, so it is an equality join for each, and
    specificity is the number of columns filled in; changes without any are joined by the months that they are in force.
    """
    asked = events.select(*scope, day).where(F.col(day).isNotNull()).distinct()
    month = lambda d: F.year(d) * 12 + F.month(d)
    found = None
    for mask in range(2 ** len(scope)):
        on = [c for i, c in enumerate(scope) if mask >> i & 1]
        own = changes
        for c in scope:
            own = own.where(F.col(c).isNotNull() if c in on else F.col(c).isNull())
        own = own.select(*on, F.col(start).alias("_from"), F.col(end).alias("_to"), F.col(choice).alias("_choice"))
        pairs = asked.select(*on, day).distinct()
        if on:
            joined = pairs.join(own, on)
        else:
            first, last = asked.agg(F.min(month(F.col(day))), F.max(month(F.col(day)))).first()
            months = F.sequence(F.greatest(F.coalesce(month(F.col("_from")), F.lit(first)), F.lit(first)), F.least(F.coalesce(month(F.col("_to")), F.lit(last)), F.lit(last)))
            inside = F.coalesce(month(F.col("_from")) <= F.lit(last), F.lit(True)) & F.coalesce(month(F.col("_to")) >= F.lit(first), F.lit(True))
            inside &= F.coalesce(month(F.col("_from")) <= month(F.col("_to")), F.lit(True))
            if first is None:
                continue
            joined = pairs.withColumn("_month", month(F.col(day))).join(own.where(inside).withColumn("_month", F.explode(months)), "_month")
        top = joined.where(within(F.col(day), F.col("_from"), F.col("_to"))).groupBy(*on, day).agg(F.countDistinct("_choice").alias("_n"), F.min("_choice").alias("_one"))
        best = F.struct(F.lit(len(on)).alias("_depth"), F.col("_n"), F.col("_one"))
        placed = asked.join(top.withColumnRenamed(day, "_day"), [*on] if on else (F.col(day) == F.col("_day"))) if not on else asked.join(top, [*on, day])
        placed = placed.select(*scope, day, best.alias("_best"))
        found = placed if found is None else found.unionByName(placed)
    if found is None:
        found = asked.where("false").withColumn("_best", F.lit(None).cast("struct<_depth: int, _n: bigint, _one: string>"))
    # Sets of equal depth that name several choices conflict.
    deepest = found.groupBy(*scope, day, F.col("_best._depth").alias("_depth")).agg(F.max("_best._n").alias("_n"), F.min("_best._one").alias("_one"), F.max("_best._one").alias("_last"))
    best = deepest.groupBy(*scope, day).agg(F.max_by(F.struct("_n", "_one", "_last", "_depth"), "_depth").alias("_best"))
    out = _beside(events, best, [*scope, day])
    single = (F.col("_best._n") == 1) & (F.col("_best._one") == F.col("_best._last"))
    state = F.when(F.col("_best").isNull(), "NONE").when(single, "APPLIED").otherwise("COMPETING")
    return out.withColumn("choice", F.when(single, F.col("_best._one"))).withColumn("specificity", F.col("_best._depth")).withColumn("state", state).drop("_best")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (what DISTINCT ON gives)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def prior_count(rows: DataFrame, keys: list[str], day: str) -> Column:
    """How many rows of a key lie on strictly earlier days; null (not 0) where there are none: no history is unknown."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(F.datediff(F.col(day), F.lit("1970-01-01"))).rangeBetween(Window.unboundedPreceding, -1))
    return F.when(n > 0, n)


def keyset_page(rows: DataFrame, key: str, after: object | None, size: int) -> DataFrame:
    """The next page after a key, one row more than asked for: its presence says that there is another page."""
    kept = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return kept.orderBy(key).limit(size + 1)
