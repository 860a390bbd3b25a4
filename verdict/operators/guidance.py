"""Guidance over coverages: preconditions, scoped facts, estimates and their grouping, reviewed meanings, applicability.

Every operator is a set of columns or one join and one aggregation over all rows; nothing is read row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The decisions that a coverage needs besides its enrolment, and statuses that end it.
AUTHORITIES = ("subject", "mapping_enrollment", "document", "edition", "section", "overall", "current")
ENDED = ("inactive", "lapsed", "terminated")


def coverage_precondition(coverages: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """key, verdict and reason of each coverage: an ordered cascade, in which what rules a coverage out comes first.

    coverages: key (unique), day, disposition, enrollment, AUTHORITIES (MATCH, NO_MATCH, UNKNOWN), applicability,
    component, current_status, contract_start, contract_end. intervals: key, from, through (both inclusive), decision,
    status. Only a single interval that holds the day counts; none or several leave it unconfirmed.
    """
    day = F.col("day")
    held = coverages.select(key, "day").join(intervals, key).where(day.between(F.col("from"), F.col("through")))
    one = held.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("decision").alias("_decision"), F.min("status").alias("_status"))
    x = coverages.join(one, key, "left")
    single = F.coalesce(F.col("_n") == 1, F.lit(False))
    no = F.lit(False)
    for name in AUTHORITIES:
        no |= F.col(name) == "NO_MATCH"
    needed = (F.col("enrollment") == "MATCH") & (F.col("component") == "BENEFIT_COVERAGE") & (F.col("applicability") == "APPLICABLE") & (F.col("current_status") == "active")
    for name in AUTHORITIES:
        needed &= F.col(name) == "MATCH"
    outside = (day < F.col("contract_start")) | (day > F.col("contract_end"))
    inactive = F.coalesce(F.col("_status") != "active", F.lit(True))
    cascade = (
        (F.col("disposition") == "BLOCKED", "UNKNOWN", "PUBLICATION_BLOCKED"),
        (F.col("enrollment") == "NO_MATCH", "NO_MATCH", "ENROLLMENT_NO_MATCH"),
        (no | (F.col("applicability") == "NOT_APPLICABLE"), "NO_MATCH", "AUTHORITY_NO_MATCH"),
        ((F.col("current") == "MATCH") & F.col("current_status").isin(*ENDED), "NO_MATCH", "CONTRACT_INACTIVE"),
        (outside, "NO_MATCH", "DAY_OUTSIDE_TERM"),
        (single & (F.col("_decision") == "NO_MATCH"), "NO_MATCH", "DAY_STATUS_NO_MATCH"),
        (single & (F.col("_decision") == "MATCH") & inactive, "NO_MATCH", "DAY_CONTRACT_INACTIVE"),
        (~F.coalesce(needed, F.lit(False)), "UNKNOWN", "AUTHORITY_INCOMPLETE"),
        (day.isNull(), "UNKNOWN", "DAY_REQUIRED"),
        (~single | (F.col("_decision") != "MATCH"), "UNKNOWN", "DAY_STATUS_UNCONFIRMED"),
        (F.col("disposition") == "ADVISORY", "UNKNOWN", "PUBLICATION_ADVISORY"),
    )
    verdict, reason = F.lit("MATCH"), F.lit("AUTHORITY_MATCH")
    for when, a, b in reversed(cascade):
        verdict, reason = F.when(when, a).otherwise(verdict), F.when(when, b).otherwise(reason)
    return x.select(key, verdict.alias("verdict"), reason.alias("reason"))


def suppressed(facts: DataFrame, path: str, receipt_currency: Column, currency: Column, prefix: str = "Receipt.") -> DataFrame:
    """facts without those of a receipt whose currency is known to be another than the coverage's."""
    other = receipt_currency.isNotNull() & currency.isNotNull() & (receipt_currency != currency)
    return facts.where(~(F.col(path).startswith(prefix) & F.coalesce(other, F.lit(False))))


def certificate_estimate(benefit: Column, amount: Column, currency: Column, decision: Column, evidence: Column, hold: Column) -> Column:
    """What a certificate's amount gives where no calculation is published: a conditional amount, never a confirmed one.

    struct(status, conditional_amount, hold): an amount that is not read directly from matching evidence needs a review.
    """
    usable = (benefit == "FIXED") & (amount >= 0) & currency.isNotNull()
    direct = (decision == "MATCH") & (evidence == "DIRECT")
    made = F.struct(F.lit("CALCULATED").alias("status"), amount.alias("conditional_amount"), F.when(F.coalesce(direct, F.lit(False)), hold).otherwise("AMOUNT_EVIDENCE_REVIEW_REQUIRED").alias("hold"))
    none = F.struct(F.lit("UNAVAILABLE").alias("status"), F.lit(None).cast("decimal(18,2)").alias("conditional_amount"), F.lit("CALCULATION_NOT_PUBLISHED").alias("hold"))
    return F.when(F.coalesce(usable, F.lit(False)), made).otherwise(none)


def indemnity_summary(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """For each group how many indemnity candidates there are and how many are calculated: NONE, CALCULATED or UNKNOWN.

    candidates: benefit, result, executable, status. One that does not match is no candidate; one that is calculated but
    not matched is unresolved.
    """
    counts = (F.col("benefit") == "INDEMNITY") & (F.col("result") != "NO_MATCH") & F.col("executable")
    done = counts & (F.col("status") == "CALCULATED") & (F.col("result") == "MATCH")
    out = candidates.groupBy(*keys).agg(F.count_if(counts).alias("n_candidates"), F.count_if(done).alias("n_calculated"))
    unresolved = F.col("n_candidates") - F.col("n_calculated")
    state = F.when(F.col("n_candidates") == 0, "NONE").when(unresolved == 0, "CALCULATED").otherwise("UNKNOWN")
    return out.select(*keys, state.alias("state"), "n_candidates", "n_calculated", unresolved.alias("n_unresolved"))


def added(operands: DataFrame, key: str, position: str, value: str, status: str) -> DataFrame:
    """The sum of each key's operands, or, where one is not available, those that are: addends, never a subtotal.

    status of operands: AVAILABLE, UNAVAILABLE, FAILED. Result: key, status (COMPLETE, PARTIAL, UNAVAILABLE, FAILED; a
    negative sum fails), amount (null unless complete) and addends (position, value), in order of position.
    """
    available = F.col(status) == "AVAILABLE"
    held = F.sort_array(F.collect_list(F.when(available, F.struct(F.col(position).alias("position"), F.col(value).alias("value")))))
    out = operands.groupBy(key).agg(F.count_if(F.col(status) == "FAILED").alias("_failed"), F.count_if(~available).alias("_open"), F.sum(F.when(available, F.col(value))).alias("_sum"), held.alias("_held"))
    state = F.when((F.col("_failed") > 0) | ((F.col("_open") == 0) & (F.col("_sum") < 0)), "FAILED").when(F.col("_open") == 0, "COMPLETE").when(F.size("_held") > 0, "PARTIAL").otherwise("UNAVAILABLE")
    amount = F.when(state == "COMPLETE", F.col("_sum"))
    return out.select(key, state.alias("status"), amount.alias("amount"), F.when(state == "PARTIAL", F.col("_held")).otherwise(F.slice("_held", 1, 0)).alias("addends"))


def estimate(published: Column, cited: Column, supported: Column, terms_match: Column, bound: Column, status: Column, amount: Column, receipt_based: Column, partial_costs: Column) -> Column:
    """What a calculation may tell: struct(kind, reason, amount, partial_amount, basis).

    POINT only for a complete amount whose source is bound and whose terms apply; a subset of costs is a FORMULA with a partial
    amount; without a valid publication nothing is told.
    """
    kinds = "struct<kind: string, reason: string, amount: decimal(28,2), partial_amount: decimal(28,2), basis: string>"

    def told(kind: str, reason: Column | str, whole: Column | None = None, part: Column | None = None, basis: Column | None = None) -> Column:
        null = F.lit(None)
        fields = (F.lit(kind), reason if isinstance(reason, Column) else F.lit(reason), *(null if x is None else x for x in (whole, part, basis)))
        return F.struct(*(f.alias(n) for f, n in zip(fields, ("kind", "reason", "amount", "partial_amount", "basis"), strict=True))).cast(kinds)

    waiting = F.when(status == "FAILED", "SOURCE_UNSUPPORTED").otherwise("INPUT_NEEDED")
    return (
        F.when(~published, told("UNAVAILABLE", "NOT_PUBLISHED"))
        .when(~cited, told("UNAVAILABLE", "CITATION_INVALID"))
        .when(~supported, told("UNAVAILABLE", "UNSUPPORTED"))
        .when(~terms_match, told("FORMULA", "TERMS_UNRESOLVED"))
        .when(amount.isNull() | ~bound, told("FORMULA", waiting))
        .when(receipt_based & partial_costs, told("FORMULA", "CONFIRMED_COST_SUBSET", None, amount, F.lit("CONFIRMED_COST_SUBSET")))
        .otherwise(told("POINT", "DOCUMENT_BASED", amount, None, F.when(receipt_based, "REGISTERED_COSTS").otherwise("DOCUMENT_FORMULA")))
    )


def planned(facts: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    """facts (key, days, daily) with what a plan would give: `scenario`, days planned times the daily amount.

    plans: key, days. Only an event without actual days and with exactly one planned number of days has a scenario.
    """
    one = plans.where(F.col("days").isNotNull()).groupBy(key).agg(F.count_distinct("days").alias("_n"), F.min("days").alias("_days"))
    x = facts.join(one, key, "left")
    usable = F.col("days").isNull() & (F.col("_n") == 1)
    state = F.when(F.col("days").isNotNull(), "ACTUAL").when(F.col("_n") == 1, "PLANNED").when(F.col("_n") > 1, "AMBIGUOUS_PLAN").otherwise("NO_PLAN")
    return x.select(key, state.alias("state"), F.when(F.coalesce(usable, F.lit(False)), F.col("_days") * F.col("daily")).alias("scenario"))


def grouping(rules: DataFrame, keys: list[str], freshness: Column, dated: Column, incomplete: Column) -> DataFrame:
    """PRIMARY or CONDITIONAL for each coverage that is relevant at all, with its assumptions in order.

    rules: required, result, terms (applicability), witness (CONFIRMED_EVENT, LOCAL_TOPIC or null). A coverage without any
    witness is not relevant. freshness, dated and incomplete are functions of the keys.
    """
    relevant = F.col("witness").isNotNull()
    unresolved = F.count_if((F.col("terms") != "MATCH") & (F.col("required") | relevant)) > 0
    confirmed = F.count_if(F.col("witness") == "CONFIRMED_EVENT") > 0
    open_ = F.count_if(F.col("required") & (F.col("result") == "UNKNOWN")) > 0
    out = rules.groupBy(*keys).agg(F.count_if(relevant).alias("_relevant"), (unresolved | ~confirmed | open_).alias("_open")).where("_relevant > 0")
    conditions = F.when(F.col("_open") | incomplete, "UNKNOWN").otherwise("MATCH")
    assumed = F.array_compact(F.array(F.when(freshness == "DOCUMENT_CONTINUITY", "DOCUMENT_CONTINUITY_ASSUMED").when(freshness == "STATUS_UNRESOLVED", "STATUS_UNRESOLVED"), F.when(~dated, "DAY_REQUIRED")))
    group = F.when((conditions == "UNKNOWN") | (freshness == "STATUS_UNRESOLVED") | ~dated, "CONDITIONAL").otherwise("PRIMARY")
    return out.select(*keys, group.alias("grouping"), conditions.alias("conditions"), F.array_join(assumed, ",").alias("assumptions"))


def merge_roots(original: DataFrame, reviewed: DataFrame, anchor: str, meaning: str) -> DataFrame:
    """Original meanings with the reviewed ones put in their place: anchor, meaning, complete, code.

    Both have anchor, meaning, complete; anchors of original are unique. Only complete reviews count. Reviews of one
    anchor that differ conflict, and the original stays; an anchor that only reviews have is an ADDITION; one that differs
    is a CORRECTION (DISAGREEMENT where the original was complete); else the code is SAME or ORIGINAL.
    """
    own = reviewed.where("complete").groupBy(anchor).agg(F.count_distinct(meaning).alias("_n"), F.min(meaning).alias("_new"))
    both = original.join(own, anchor, "full")
    single, known = F.col("_n") == 1, F.col("complete").isNotNull()
    differs = ~F.col(meaning).eqNullSafe(F.col("_new"))
    code = (
        F.when(F.col("_n") > 1, "CONFLICT")
        .when(F.col("_n").isNull(), "ORIGINAL")
        .when(~known, "ADDITION")
        .when(differs & F.col("complete"), "DISAGREEMENT")
        .when(differs, "CORRECTION")
        .otherwise("SAME")
    )
    kept = both.where(known | single)
    return kept.select(anchor, F.when(single, F.col("_new")).otherwise(F.col(meaning)).alias(meaning), F.when(single, F.lit(True)).otherwise(F.col("complete")).alias("complete"), code.alias("code"))


def scoped_codes(facts: DataFrame, required: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """facts (keys, value) with coded values kept only where the one required and the one actual scope are equal.

    required, actual: keys, scope. Others lose their value, with reason SCOPE_MISMATCH (one of each, but not the same) or
    SCOPE_UNRESOLVED; a fact without a value has no reason.
    """
    count = lambda x, n: x.groupBy(*keys).agg(F.count_distinct("scope").alias(f"_{n}_n"), F.min("scope").alias(f"_{n}"))
    x = facts.join(count(required, "r"), keys, "left").join(count(actual, "a"), keys, "left")
    single = F.coalesce((F.col("_r_n") == 1) & (F.col("_a_n") == 1), F.lit(False))
    kept = single & (F.col("_r") == F.col("_a"))
    reason = F.when(F.col("value").isNotNull() & ~kept, F.when(single, "SCOPE_MISMATCH").otherwise("SCOPE_UNRESOLVED"))
    return x.select(*keys, F.when(kept, F.col("value")).alias("value"), reason.alias("reason"))


def overlaid_facts(read: DataFrame, keys: list[str]) -> DataFrame:
    """One fact for each key and path: what was entered, else what was interpreted, else topics, which confirm nothing.

    read: keys, path, origin (explicit, interpreted, topic), value, confirmed. Result: keys, path, value, provenance,
    conflict. Origins of a lower rank that say something else are a conflict, and the higher one stays; interpreted values
    or topics that differ among themselves have no value. Interpreted admission days go where admission was entered
    and is not true.
    """
    of = lambda origin, what: F.when(F.col("origin") == origin, what)
    least = lambda origin: F.min(of(origin, F.col("value")))
    # How many values there are, up to two: that is all that is asked of them.
    distinct = lambda origin: F.when(F.max(of(origin, F.col("value"))) != least(origin), 2).when(least(origin).isNotNull(), 1).otherwise(0)
    x = read.groupBy(*keys, "path").agg(
        F.count_if(F.col("origin") == "explicit").alias("_e"), least("explicit").alias("_ev"), F.bool_and(of("explicit", F.col("confirmed"))).alias("_ec"),
        F.count_if(F.col("origin") == "interpreted").alias("_i"), distinct("interpreted").alias("_in"), least("interpreted").alias("_iv"), F.bool_and(of("interpreted", F.col("confirmed"))).alias("_ic"),
        distinct("topic").alias("_tn"), least("topic").alias("_tv"),
    )
    read_value = F.when((F.col("_in") == 1) & F.col("_ic"), F.col("_iv"))
    value = F.when(F.col("_e") > 0, F.col("_ev")).when(F.col("_i") > 0, read_value)
    provenance = (
        F.when(F.col("_e") > 0, F.when(F.col("_ec"), "EXPLICIT").otherwise("UNCONFIRMED"))
        .when(F.col("_i") > 0, F.when(F.col("_in") > 1, "CONFLICTING").when(read_value.isNotNull(), "DERIVED_CONFIRMED").otherwise("UNCONFIRMED"))
        .otherwise(F.when(F.col("_tn") > 1, "CONFLICTING").otherwise("UNCONFIRMED"))
    )
    against = lambda n, v: (F.col(n) > 1) | ((F.col(n) == 1) & (F.col(v) != F.col("_ev")))
    conflict = F.when(F.col("_e") > 0, F.coalesce(against("_in", "_iv"), F.lit(False)) | F.coalesce(against("_tn", "_tv"), F.lit(False))).otherwise((F.col("_in") > 1) | (F.col("_tn") > 1))
    out = x.select(*keys, "path", value.alias("value"), provenance.alias("provenance"), conflict.alias("conflict"))
    entered = (F.col("path") == "Event.admission") & F.col("provenance").isin("EXPLICIT", "UNCONFIRMED") & F.col("value").isNotNull()
    refuted = entered & ((F.col("value") != "true") | (F.col("provenance") != "EXPLICIT"))
    marked = out.withColumn("_refuted", F.bool_or(refuted).over(Window.partitionBy(*keys)))
    lost = F.coalesce("_refuted", F.lit(False)) & (F.col("path") == "Event.admission_days") & (F.col("provenance") == "DERIVED_CONFIRMED")
    return marked.select(*keys, "path", F.when(~lost, F.col("value")).alias("value"), F.when(lost, "CONFLICTING").otherwise(F.col("provenance")).alias("provenance"), (F.col("conflict") | lost).alias("conflict"))


def applicable_topics(positions: DataFrame, keys: list[str]) -> DataFrame:
    """The topics that count: of each key and path those of the top priority among the positions that no guard excludes.

    positions: keys, path, topic, priority, guarded (negated, planned, or of somebody else). Result: keys, path, topics
    (sorted, comma-joined), ambiguous (more than one).
    """
    allowed = positions.where(~F.col("guarded"))
    top = allowed.groupBy(*keys, "path").agg(F.max("priority").alias("priority"))
    kept = allowed.join(top, [*keys, "path", "priority"])
    return kept.groupBy(*keys, "path").agg(F.array_join(F.sort_array(F.collect_set("topic")), ",").alias("topics"), (F.count_distinct("topic") > 1).alias("ambiguous"))


def applicability(policy: dict[str, Column], terms: dict[str, Column], references: bool) -> Column:
    """struct(verdict, reason): whether printed terms apply to a contract, by exact references or by product and printed period.

    Both have insurer, product_code; policy has terms_reference, edition_reference and contract_date, terms have
    terms_code, edition_code, start and end. Texts are arrays of the values found: one value is known, none is absent,
    several are uncertain. What contradicts comes first, then what is uncertain. references: whether the policy's references are
    said to be those of the terms.
    """
    known = lambda x: F.when(F.size(x) == 1, x[0])
    unsure = lambda x: F.coalesce(F.size(x) > 1, F.lit(False))
    compared = [("insurer", "insurer", "INSURER_MISMATCH"), ("product_code", "product_code", "PRODUCT_CODE_MISMATCH")]
    if references:
        compared += [("edition_reference", "edition_code", "EDITION_REFERENCE_MISMATCH"), ("terms_reference", "terms_code", "TERMS_REFERENCE_MISMATCH")]
    same = {a: F.coalesce(known(policy[a]) == known(terms[b]), F.lit(False)) for a, b, _ in compared}
    day, start, end = policy["contract_date"], terms["start"], terms["end"]
    broken = F.coalesce(end < start, F.lit(False))
    outside = F.coalesce(day < start, F.lit(False)) | F.coalesce(day > end, F.lit(False))
    cases: list[tuple[Column, str, str]] = [(known(policy[a]) != known(terms[b]), "NO_MATCH", code) for a, b, code in compared]
    cases.append((outside & ~broken, "NO_MATCH", "CONTRACT_DATE_OUTSIDE_PRINTED_PERIOD"))
    cases += [(unsure(policy[a]) | unsure(terms[b]), "UNKNOWN", "IDENTITY_METADATA_UNCERTAIN") for a, b, _ in compared]
    cases.append((broken, "UNKNOWN", "INVALID_PRINTED_PERIOD"))
    if references:
        cases.append((same["insurer"] & same["terms_reference"] & same["edition_reference"], "MATCH", "EXPLICIT_EDITION_REFERENCE_MATCH"))
    cases.append((same["insurer"] & same["product_code"] & day.isNotNull() & start.isNotNull(), "MATCH", "PRODUCT_CODE_PRINTED_PERIOD_MATCH"))
    said = lambda a, b: F.struct(F.lit(a).alias("verdict"), F.lit(b).alias("reason"))
    out = said("UNKNOWN", "INSUFFICIENT_APPLICABILITY_EVIDENCE")
    for when, a, b in reversed(cases):
        out = F.when(when, said(a, b)).otherwise(out)
    return out


def covered_roots(members: DataFrame, spans: DataFrame, represented: DataFrame | Column, regions: DataFrame) -> DataFrame:
    """(root, covered): whether every body span of a root's regions is represented or refers to one region of the root.

    members: root, region. spans: region, span, target (label that it refers to, or null). represented: root, region, span,
    or, where that table follows from its keys, a condition on these columns: then no pair of root and span that it holds for is shuffled.
    regions: region, label, edition, complete. A target counts if exactly one region of the edition has the label and the
    root holds it; a region that is missing or not complete leaves its root uncovered.
    """
    own = members.distinct()
    labels = regions.groupBy("edition", "label").agg(F.count(F.lit(1)).alias("_n"), F.min("region").alias("_to"))
    body = own.join(spans, "region")
    body = body.where(~F.coalesce(represented, F.lit(False))) if isinstance(represented, Column) else body.join(represented, ["root", "region", "span"], "left_anti")
    named = body.join(regions.select("region", "edition"), "region", "left").join(labels.withColumnRenamed("label", "target"), ["edition", "target"], "left")
    held = named.join(own.select("root", F.col("region").alias("_to"), F.lit(True).alias("_held")), ["root", "_to"], "left")
    failed = held.where(~F.coalesce((F.col("_n") == 1) & F.col("_held"), F.lit(False))).select("root")
    broken = own.join(regions, "region", "left").where(~F.coalesce("complete", F.lit(False))).select("root")
    bad = failed.unionByName(broken).distinct().withColumn("_bad", F.lit(True))
    return own.select("root").distinct().join(bad, "root", "left").select("root", F.col("_bad").isNull().alias("covered"))
