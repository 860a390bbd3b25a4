"""Reconciliation, inventory, audits and scores: joins with cardinality checks and closed summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_by_label(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """Each left row's match by label: REVIEW for exactly one candidate, AMBIGUOUS for more, else UNMATCHED. Null labels match nothing."""
    found = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(right_id).alias("n_candidates"), F.min(right_id).alias("_one"))
    out = left.join(found, key, "left")
    n = F.coalesce("n_candidates", F.lit(0))
    state = F.when(n == 1, "REVIEW").when(n > 1, "AMBIGUOUS").otherwise("UNMATCHED")
    return out.select(left_id, state.alias("state"), n.alias("n_candidates"), F.when(n == 1, F.col("_one")).alias("candidate"))


def reconcile(items: DataFrame, precedence: list[tuple[str, str]]) -> DataFrame:
    """items with `value`, `origin` and `state`: the first non-null of the named sources, in order of precedence.

    CONFLICT where two sources with a value disagree, RESOLVED where there is a value, else PENDING.
    """
    columns = [F.col(c) for _, c in precedence]
    origin = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(name)) for name, c in precedence))
    distinct = F.size(F.array_distinct(F.array_compact(F.array(*columns))))
    state = F.when(distinct > 1, "CONFLICT").when(distinct == 1, "RESOLVED").otherwise("PENDING")
    return items.withColumn("value", F.coalesce(*columns)).withColumn("origin", origin).withColumn("state", state)


def change_plan(wanted: DataFrame, current: DataFrame, key: str, digest: str, blocked: Column) -> DataFrame:
    """What applying the wanted rows would do: BLOCKED, NO_OP, CREATE or SUPERSEDE."""
    old = current.select(key, F.col(digest).alias("_old"))
    action = F.when(F.coalesce(blocked, F.lit(False)), "BLOCKED").when(F.col("_old").isNull(), "CREATE").when(F.col("_old") == F.col(digest), "NO_OP").otherwise("SUPERSEDE")
    return wanted.join(old, key, "left").select(key, action.alias("action"))


def orphans(references: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(reference, n_orphans) for each (name, child, child column, parent, parent column): children without a parent."""
    out = None
    for name, child, column, parent, parent_column in references:
        keys = parent.select(F.col(parent_column).alias("_k")).distinct()
        lost = child.select(F.col(column).alias("_k")).where("_k is not null").join(keys, "_k", "left_anti")
        one = lost.agg(F.count(F.lit(1)).alias("n_orphans")).select(F.lit(name).alias("reference"), "n_orphans")
        out = one if out is None else out.unionByName(one)
    return out


def archive_audit(expected: DataFrame, stored: DataFrame, key: str, size: str) -> DataFrame:
    """One row of counts: matched, missing, size_mismatch, unreferenced, and duplicate references (an error if not 0)."""
    want = expected.groupBy(key).agg(F.min(size).alias("_want"), F.count(F.lit(1)).alias("_n"))
    have = stored.groupBy(key).agg(F.min(size).alias("_have"))
    both = want.join(have, key, "full")
    return both.agg(
        F.count_if(F.col("_want") == F.col("_have")).alias("matched"),
        F.count_if(F.col("_n").isNotNull() & F.col("_have").isNull()).alias("missing"),
        F.count_if(F.col("_want") != F.col("_have")).alias("size_mismatch"),
        F.count_if(F.col("_n").isNull()).alias("unreferenced"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).alias("duplicate_references"),
    )


def bundles(sources: DataFrame, content: str, identity: str) -> DataFrame:
    """The contents that stand for more than one identity: (content, n_identities, n_sources)."""
    return sources.groupBy(content).agg(F.count_distinct(identity).alias("n_identities"), F.count(F.lit(1)).alias("n_sources")).where("n_identities > 1")


def differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """ADDED, REMOVED, CHANGED or SAME for each key of either side, by null-safe comparison of the fields."""
    a = left.select(key, F.struct(*fields).alias("_a"))
    b = right.select(key, F.struct(*fields).alias("_b"))
    state = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(F.col("_a").eqNullSafe(F.col("_b")), "SAME").otherwise("CHANGED")
    return a.join(b, key, "full").select(key, state.alias("state"))


#: The states of a claim and what may follow each.
TRANSITIONS = {
    "preparing": ("submitted",),
    "submitted": ("supplementation_requested", "paid", "partially_paid", "denied"),
    "supplementation_requested": ("submitted", "paid", "partially_paid", "denied"),
    "paid": ("closed",),
    "partially_paid": ("closed",),
    "denied": ("closed",),
    "closed": (),
}


def invalid_transitions(history: DataFrame, key: str, order: list[str], state: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """The steps of each key's history that `allowed` does not list: (key, from_state, to_state, n)."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    steps = history.select(key, before.alias("from_state"), F.col(state).alias("to_state")).where("from_state is not null")
    listed = F.array(*(F.lit(f"{a}>{b}") for a, to in allowed.items() for b in to))
    ok = F.array_contains(listed, F.concat_ws(">", "from_state", "to_state"))
    return steps.where(~ok).groupBy(key, "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def benchmark_score(cases: DataFrame) -> DataFrame:
    """One row of micro-averaged measures; a measure without cases is null.

    cases: expected_primary, expected_conditional, primary, conditional (arrays), answerable, held.
    recall: expected candidates that were given; precisions: given ones that were expected, by group;
    unrelated: cases that expect nothing and got something; unnecessary hold: answerable cases that were held.
    """
    size = lambda c: F.sum(F.size(c))
    both = lambda a, b: F.sum(F.size(F.array_intersect(a, b)))
    expected, given = F.array_union("expected_primary", "expected_conditional"), F.array_union("primary", "conditional")
    nothing = F.size(expected) == 0
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return cases.agg(
        ratio(F.sum(F.size(F.array_intersect(expected, given))), F.sum(F.size(expected))).alias("recall"),
        ratio(both("expected_primary", "primary"), size("primary")).alias("primary_precision"),
        ratio(both("expected_conditional", "conditional"), size("conditional")).alias("conditional_precision"),
        ratio(F.count_if(nothing & (F.size(given) > 0)), F.count_if(nothing)).alias("unrelated_rate"),
        ratio(F.count_if(F.col("answerable") & F.col("held")), F.count_if(F.col("answerable"))).alias("unnecessary_hold_rate"),
    )


def negative_controls(cases: DataFrame, pool: str) -> DataFrame:
    """(control, measures): the scores of predictions that are wrong on purpose, one row each; a scorer that passes one is broken.

    all_hold gives nothing and holds every case, all_primary and all_conditional give the whole pool of a case as one group.
    """
    none = F.array().cast(dict(cases.dtypes)[pool])
    controls = {"all_hold": (none, none, True), "all_primary": (F.col(pool), none, False), "all_conditional": (none, F.col(pool), False)}
    out = None
    for name, (primary, conditional, held) in controls.items():
        own = benchmark_score(cases.withColumn("primary", primary).withColumn("conditional", conditional).withColumn("held", F.lit(held)))
        own = own.select(F.lit(name).alias("control"), *own.columns)
        out = own if out is None else out.unionByName(own)
    return out
