"""Graphs read from the regions of a text (articles, appendices, footnotes): what each line means, which regions a line applies or
replaces, what a root rests on, and the calculation and rules that follow for each root.

Everything is a table and covers all editions at once: a line's meaning is a column over a list of sentence forms, references
are joined to the one region of the edition that has the label, closures are a fixpoint over region pairs, and a root's calculation is an
aggregate over the lines of its closure. Lines that no form fits, references without a target, cycles and replacements that do not
match are kept as what they are, and leave the roots that rest on them unresolved.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdict.functions.binding import let
from verdict.functions.checkpoints import checkpoint, written
from verdict.functions.money import rounded
from verdict.operators.components import reachable

# The forms of sentences, whole lines only.
NUMBER = r"(?:0|[1-9][0-9]{0,17})(?:\.[0-9]{1,12})?"
INTEGER = r"(?:0|[1-9][0-9]{0,4})"
CURRENCY = r"[A-Z]{3}"
ROUNDING = r"half up|half even|up|down"
IDENTIFIER = r"[a-z0-9][a-z0-9._:-]{0,63}"
#: (kind, detail, rule, field, unit, form, what its groups are)
FORMS = (
    ("condition", "equals", "eligibility", "treatment_kind", None, r"The treatment kind must be (surgery|admission|outpatient)\.", ("value",)),
    ("condition", "equals", "eligibility", "performed", None, r"Surgery must have been performed\.", ()),
    ("condition", "equals", "eligibility", "diagnosis_confirmed", None, r"Diagnosis must be confirmed\.", ()),
    ("condition", "equals", "eligibility", "admission", None, r"Admission is required\.", ()),
    ("calculation", "daily", None, None, None, rf"For each payable admission day, pay the insured amount in ({CURRENCY}); multiply first, then round the total ({ROUNDING}) to whole currency units\.", ("currency", "rounding")),
    ("calculation", "daily", None, None, None, rf"지급 대상 입원일수와 보험가입금액을 곱하여 ({CURRENCY})로 지급하며, 곱한 총액을 통화 정수 단위로 (반올림|올림|내림)합니다\.", ("currency", "rounding")),
    ("calculation", "fixed", None, None, None, rf"The benefit is ({CURRENCY}) ({NUMBER}), rounded ({ROUNDING}) to whole currency units\.", ("currency", "value", "rounding")),
    ("calculation", "insured_ratio", None, None, None, rf"Pay ({NUMBER}) of the insured amount in ({CURRENCY}), rounded ({ROUNDING}) to whole currency units\.", ("value", "currency", "rounding")),
    ("calculation", "indemnity", None, None, None, rf"Reimburse the covered receipt amount in ({CURRENCY}), rounded ({ROUNDING}) to whole currency units\.", ("currency", "rounding")),
    ("reduction", None, None, "reduction_applies", None, rf"When the event reduction condition is true, multiply the gross benefit by ({NUMBER}); otherwise keep the gross benefit, before deduction, amount cap and rounding\.", ("value",)),
    ("footnote", "initial_excluded_days", None, None, "days", rf"Exclude the first ({INTEGER}) admission days\.", ("value",)),
    ("footnote", "initial_excluded_days", None, None, "days", rf"최초 입원 ({INTEGER})일은 지급일수에서 제외합니다\.", ("value",)),
    ("limit", "payable_days", None, None, "days", rf"The maximum is ({INTEGER}) payable days\.", ("value",)),
    ("limit", "payable_days", None, None, "days", rf"지급일수는 최대 ({INTEGER})일입니다\.", ("value",)),
    ("deductible", None, None, None, None, rf"Deduct ({CURRENCY}) ({NUMBER}) from the gross benefit before applying the amount cap and rounding; floor at zero\.", ("currency", "value")),
    ("limit", "maximum_amount", None, None, "amount", rf"The maximum benefit is ({CURRENCY}) ({NUMBER})\.", ("currency", "value")),
    ("classification", None, None, None, None, rf"Medical event (classification|diagnosis code|procedure code) uses ({IDENTIFIER}) version ({IDENTIFIER}): ({IDENTIFIER}(?:, {IDENTIFIER}){{0,63}})\.", ("field", "system", "version", "codes")),
    ("condition", "range", "eligibility", "admission_days", "days", rf"Eligible admission days range from ({INTEGER}) to ({INTEGER}) inclusive\.", ("value", "high")),
    ("condition", "days_since", "temporal", "contract_start", "days", rf"The waiting period is ({INTEGER}) days from contract start\.", ("value",)),
    ("condition", "count_below", "frequency", "counted_occurrence", "occurrences", rf"Payment requires fewer than ({INTEGER}) prior occurrences\.", ("value",)),
)
ROUNDINGS = {"반올림": "half_up", "올림": "up", "내림": "down"}
REFERENCE = r"Apply ((?:Article|Appendix|Footnote) [1-9][0-9]{0,3})\."
REFERENCE_KO = r"((?:제[1-9][0-9]{0,3}조|별표\s?[1-9][0-9]{0,3}|각주\s?[1-9][0-9]{0,3}))(?:을|를) 적용합니다\."
OVERRIDE = r"((?:Article|Appendix|Footnote) [1-9][0-9]{0,3}) replaces ((?:Article|Appendix|Footnote) [1-9][0-9]{0,3})\."
EXCLUDED = ("LOCAL_EXAMPLE_EXCLUDED", "SEMANTIC_TERMS_TITLE_CONTEXT")
MOST_CHARS, MOST_STATEMENT, MOST_DAYS = 8192, 4096, 36500
# Fixed values end.

#: Nodes and references that the closure of a root may have; more are refused whole, never cut.
NODES, REFERENCES = 256, 1024
_MEANING = ("kind", "detail", "rule", "field", "unit", "currency", "rounding", "value", "high", "system", "version", "codes")
_KEY = ["edition", "region"]


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def meaning(text: Column, stripped: Column | None = None) -> Column:
    """What a line means, a struct of texts (codes apart by commas), by the one form that fits all of it; null where none does. stripped: the
    text without white space around it, where a column holds that; it is stripped once for each form otherwise."""
    line, out = _stripped(text) if stripped is None else stripped, F.lit(None)
    for kind, detail, rule, field, unit, form, groups in reversed(FORMS):
        own = dict(zip(_MEANING, (kind, detail, rule, field, unit), strict=False))
        parts = {k: F.lit(v).cast("string") for k, v in own.items()}
        for i, g in enumerate(groups, 1):
            parts[g] = F.regexp_extract(line, f"^{form}$", i)
        if "rounding" in parts:
            parts["rounding"] = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ROUNDINGS.items() for x in kv)), parts["rounding"]), F.replace(parts["rounding"], F.lit(" "), F.lit("_")))
        if kind == "classification":
            parts["field"] = F.replace(parts["field"], F.lit(" "), F.lit("_"))
        fits = line.rlike(f"^{form}$")
        if kind == "footnote":
            fits &= parts["value"].try_cast("int") <= MOST_DAYS
        if "high" in parts:
            fits &= parts["value"].try_cast("int") <= parts["high"].try_cast("int")
        if kind == "classification":
            codes = F.split(parts["codes"], ", ")
            fits &= F.size(codes) == F.size(F.array_distinct(codes))
        out = F.when(fits, F.struct(*(parts.get(n, F.lit(None).cast("string")).alias(n) for n in _MEANING))).otherwise(out)
    return F.when(F.length(text).between(1, MOST_CHARS) & ~text.rlike("[\n\r\u0000]"), out)


@dataclass(frozen=True)
class Graph:
    """nodes: edition, region, ordinal, m (its meaning), supported, anchor. edges: edition, region, ordinal, to_region, to_ordinal, label, relation.
    regions: edition, region, label, kind, excluded, unresolved. within: edition, root, region, for each root what it rests on. conflicts:
    edition, region, of replacements that do not match. cyclic: edition, region."""

    nodes: DataFrame
    edges: DataFrame
    regions: DataFrame
    within: DataFrame
    conflicts: DataFrame
    cyclic: DataFrame


def read(regions: DataFrame, spans: DataFrame) -> Graph:
    """The graph of each edition. regions: edition, region, label, kind (article, appendix, footnote, unresolved), complete, reasons. spans: edition,
    region, ordinal, text, a region's lines.

    A region's first calculation, or else its first line, is its anchor, which the other lines, and what the region applies, hang on.
    A replacement counts only in the region that replaces; it goes line by line, between lines of the same shape. A region is unresolved
    if it is not complete, has a line without meaning or a reference that not exactly one region answers, or rests on a region that is.
    """
    known = F.array(*map(F.lit, EXCLUDED))
    reasons = F.coalesce("reasons", F.array().cast("array<string>"))
    plans = regions.withColumn("excluded", F.col("complete") & (F.col("kind") == "unresolved") & (F.size(reasons) > 0) & (F.size(F.array_except(reasons, known)) == 0))
    lines = spans.join(plans.where("not excluded").select(*_KEY, F.col("label").alias("_own")), _KEY)
    lines, line = lines.withColumn("_line", _stripped(F.col("text"))), F.col("_line")
    first = lambda pattern, i: F.nullif(F.regexp_extract(line, f"^{pattern}$", i), F.lit(""))
    lines = lines.withColumn("_to", F.coalesce(first(REFERENCE, 1), first(REFERENCE_KO, 1))).withColumn("_by", first(OVERRIDE, 1)).withColumn("_over", first(OVERRIDE, 2))
    lines = lines.withColumn("m", F.when(F.col("_to").isNull() & F.col("_by").isNull(), meaning(F.col("text"), line))).withColumn("_short", F.length("text") <= MOST_STATEMENT)
    linked = F.col("_to").isNotNull() | F.coalesce(F.col("_by") == F.col("_own"), F.lit(False))
    # A region's lines are together here; what its anchor is comes from windows, so that meanings are not dealt again. They are kept compressed.
    whole_region, own_line = Window.partitionBy(*_KEY), F.when(~F.col("linked"), F.struct((~F.col("m.kind").eqNullSafe("calculation")).alias("later"), "ordinal"))
    lines = lines.withColumn("linked", linked).withColumn("supported", F.col("m").isNotNull() & F.col("_short"))
    lines = lines.withColumn("_anchor", F.min(own_line).over(whole_region)["ordinal"]).withColumn("_all", F.min(F.when(~F.col("linked"), F.col("supported"))).over(whole_region))
    lines = written(lines.withColumn("_least", F.min("ordinal").over(whole_region)).drop("text", "_line", "_own", "_by", "_short"))
    own = lines.where("not linked").select(*_KEY, "ordinal", "m", "supported", (F.col("_anchor") == F.col("ordinal")).alias("anchor"))
    only = lines.where("_anchor is null and ordinal = _least").select(*_KEY, "ordinal").distinct()
    nodes = own.unionByName(only.select(*_KEY, "ordinal", F.lit(None).cast(own.schema["m"].dataType).alias("m"), F.lit(False).alias("supported"), F.lit(True).alias("anchor")))
    anchors = lines.where("not linked and _anchor = ordinal").select(*_KEY, F.col("_anchor").alias("anchor"), "_all").distinct()
    anchors = anchors.unionByName(only.select(*_KEY, F.col("ordinal").alias("anchor"), F.lit(False).alias("_all")))
    labels = plans.join(anchors.select(*_KEY, "anchor"), _KEY, "left").groupBy("edition", "label").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("region", "anchor")).alias("_t"))
    wanted = lines.where("linked").select(*_KEY, F.coalesce("_to", "_over").alias("label"), F.when(F.col("_to").isNotNull(), "DEPENDS_ON").otherwise("OVERRIDES").alias("relation")).distinct()
    links = wanted.join(anchors.select(*_KEY, F.col("anchor").alias("ordinal")), _KEY).join(labels, ["edition", "label"], "left")
    met = (F.col("_n") == 1) & F.col("_t.anchor").isNotNull()
    links = written(links.select(*_KEY, "ordinal", "label", "relation", F.when(met, F.col("_t.region")).alias("to_region"), F.when(met, F.col("_t.anchor")).alias("to_ordinal")))

    shape = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (F.col("m.kind"), F.when(~F.col("m.kind").isin("condition"), F.col("m.detail")), F.col("m.field"), F.col("m.rule"))))
    shaped = nodes.select(*_KEY, "ordinal", F.when(F.col("m").isNull(), "information").otherwise(shape).alias("shape"))
    forms = shaped.groupBy(*_KEY).agg(F.sort_array(F.collect_list("shape")).alias("shapes"))
    over = links.where("relation = 'OVERRIDES' and to_region is not null").join(forms, _KEY).join(forms.select("edition", F.col("region").alias("to_region"), F.col("shapes").alias("_shapes")), ["edition", "to_region"])
    alike = (F.col("shapes") == F.col("_shapes")) & (F.size("shapes") == F.size(F.array_distinct("shapes")))
    over = written(over.withColumn("alike", alike))
    by_line = over.where("alike").select(*_KEY, "to_region", "label").join(shaped, _KEY).join(shaped.select("edition", F.col("region").alias("to_region"), F.col("ordinal").alias("to_ordinal"), "shape"), ["edition", "to_region", "shape"])
    columns = [*_KEY, "ordinal", "to_region", "to_ordinal", "label", "relation"]
    whole = over.where("not alike").select(*columns)
    inside = nodes.where("not anchor").join(anchors.select(*_KEY, F.col("anchor").alias("_from")), _KEY)
    edges = [
        inside.select(*_KEY, F.col("_from").alias("ordinal"), F.col("region").alias("to_region"), F.col("ordinal").alias("to_ordinal"), F.lit(None).cast("string").alias("label"), F.lit("DEPENDS_ON").alias("relation")),
        links.where("relation = 'DEPENDS_ON' or to_region is null").select(*columns), whole, by_line.withColumn("relation", F.lit("OVERRIDES")).select(*columns),
    ]
    edges = written(reduce(DataFrame.unionByName, edges).distinct())

    own_faults = plans.where("not excluded").join(anchors, _KEY, "left").where("not complete or kind = 'unresolved' or anchor is null or not _all").select(*_KEY)
    faults = own_faults.unionByName(links.where("to_region is null").select(*_KEY)).unionByName(whole.select(*_KEY)).distinct()
    pair = lambda c: F.struct("edition", F.col(c).alias("region"))
    depends = links.where("to_region is not null").select(pair("region").alias("a"), pair("to_region").alias("b")).distinct()
    # A region that applies none rests on itself alone: only the others are followed.
    reach = reachable(depends, depends.select(F.col("a").alias("root")).distinct())
    reach = reach.select(F.col("root.edition").alias("edition"), F.col("root.region").alias("root"), F.col("node.region").alias("region"))
    alone = anchors.select(*_KEY).join(depends.select("a.*"), _KEY, "left_anti")
    reach = written(reach.unionByName(alone.select("edition", F.col("region").alias("root"), "region")))
    back = links.where("to_region is not null").select("edition", "region", F.col("to_region").alias("root"))
    cyclic = reach.join(back, ["edition", "root", "region"], "left_semi").select("edition", F.col("root").alias("region")).distinct()
    articles = plans.where("kind = 'article'").select("edition", F.col("region").alias("root"))
    from_articles = reach.join(articles, ["edition", "root"], "left_semi")
    alone = anchors.select(*_KEY).join(from_articles.select(*_KEY), _KEY, "left_anti").select("edition", F.col("region").alias("root"))
    within = written(from_articles.unionByName(reach.join(alone, ["edition", "root"], "left_semi")))
    large = reach.join(nodes.select(*_KEY), _KEY).groupBy("edition", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > NODES).select("edition", F.col("root").alias("region"))
    many = reach.join(lines.where("linked").select(*_KEY), _KEY).groupBy("edition", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REFERENCES).select("edition", F.col("root").alias("region"))
    faults = faults.unionByName(cyclic).unionByName(large).unionByName(many).distinct()
    lost = reach.join(faults, _KEY, "left_semi").select("edition", F.col("root").alias("region")).unionByName(faults).distinct()
    judged = plans.join(lost.withColumn("_lost", F.lit(True)), _KEY, "left").select(*_KEY, "label", "kind", "excluded", (F.coalesce("_lost", F.lit(False)) & ~F.col("excluded")).alias("unresolved"))
    return Graph(nodes, edges, judged, within, whole.select(*_KEY).distinct(), cyclic)


_PARTS = {
    "formula": "m.kind = 'calculation'", "excluded_days": "m.kind = 'footnote'", "most_days": "m.kind = 'limit' and m.detail = 'payable_days'", "most": "m.kind = 'limit' and m.detail = 'maximum_amount'",
    "deductible": "m.kind = 'deductible'", "reduction": "m.kind = 'reduction'",
}


def calculations(graph: Graph) -> DataFrame:
    """For each root: edition, root, code (why it has no calculation, null if it has one or needs none), and the parts of its calculation: mode,
    currency, rounding, base (amount or ratio), excluded_days, most_days, factor, deductible, most.

    Lines of the closure that others in it replace are left out; a line may be replaced once. Codes, the first that holds: OVERRIDE_CONFLICT,
    DEPENDENCY_MISSING, DEPENDENCY_CYCLE, SEMANTIC_NODE_UNVERIFIED, CALCULATION_CONFLICT, CALCULATION_CURRENCY_MISMATCH,
    DAILY_EXCLUSION_BASIS_MISSING, CALCULATION_UNIT_MISMATCH, CALCULATION_RATE_INVALID.
    """
    at = ["edition", "root"]
    inside = graph.within.join(graph.edges.where("relation = 'OVERRIDES' and to_region is not null"), _KEY)
    replaced = inside.groupBy("edition", "root", F.col("to_region").alias("region"), F.col("to_ordinal").alias("ordinal")).agg(F.count(F.lit(1)).alias("_times"))
    held = graph.within.join(graph.nodes, _KEY).join(replaced, [*at, *_KEY[1:], "ordinal"], "left")
    flag = lambda df, name: df.select("edition", "root").distinct().withColumn(name, F.lit(True))
    conflict = flag(graph.within.join(graph.conflicts, _KEY, "left_semi").select(*at).unionByName(replaced.where("_times > 1").select(*at)), "_conflict")
    missing = flag(graph.within.join(graph.edges.where("to_region is null"), _KEY, "left_semi"), "_missing")
    cycle = flag(graph.within.join(graph.cyclic, _KEY, "left_semi"), "_cycle")
    active = F.col("_times").isNull()
    parts = {}
    for name, when in _PARTS.items():
        on = active & F.coalesce(F.expr(when), F.lit(False))
        parts[name] = (F.count_if(on), F.min(F.when(on, F.col("m"))))
    x = held.groupBy(*at).agg(F.min("supported").alias("_all"), *(n.alias(f"n_{k}") for k, (n, _) in parts.items()), *(v.alias(k) for k, (_, v) in parts.items()))
    for df in (conflict, missing, cycle):
        x = x.join(df, at, "left")
    number = lambda c, kind="decimal(38,12)": F.col(f"{c}.value").try_cast(kind)
    mode, currency = F.col("formula.detail"), F.col("formula.currency")
    daily = mode == "daily"
    codes = (
        (F.col("_conflict"), "OVERRIDE_CONFLICT"), (F.col("_missing"), "DEPENDENCY_MISSING"), (F.col("_cycle"), "DEPENDENCY_CYCLE"), (~F.col("_all"), "SEMANTIC_NODE_UNVERIFIED"),
        (F.col("n_formula") == 0, None),
        (F.greatest(*(F.col(f"n_{k}") for k in _PARTS)) > 1, "CALCULATION_CONFLICT"),
        ((F.col("most.currency") != currency) | (F.col("deductible.currency") != currency), "CALCULATION_CURRENCY_MISMATCH"),
        (daily & (F.col("n_excluded_days") == 0), "DAILY_EXCLUSION_BASIS_MISSING"),
        (~daily & (F.col("n_excluded_days") + F.col("n_most_days") > 0), "CALCULATION_UNIT_MISMATCH"),
        (((mode == "insured_ratio") & (number("formula") > 1)) | (number("reduction") > 1), "CALCULATION_RATE_INVALID"),
    )
    code = F.lit(None).cast("string")
    for when, then in reversed(codes):
        code = F.when(F.coalesce(when, F.lit(False)), F.lit(then).cast("string")).otherwise(code)
    sound = F.coalesce(~F.col("_conflict"), F.lit(True)) & F.col("_missing").isNull() & F.col("_cycle").isNull() & F.col("_all") & code.isNull() & (F.col("n_formula") == 1)
    kept = {
        "mode": mode, "currency": currency, "rounding": F.col("formula.rounding"), "base": number("formula"), "excluded_days": number("excluded_days", "int"), "most_days": number("most_days", "int"),
        "factor": number("reduction"), "deductible": number("deductible"), "most": number("most"),
    }
    x = x.withColumn("code", code).withColumn("_sound", sound)
    # A row for each root; kept, so that what is computed from its columns does not spell them out again and again.
    return checkpoint(x.select(*at, "code", *(F.when(F.col("_sound"), c).alias(k) for k, c in kept.items())))


def benefit(insured: Column, days: Column, covered: Column, reduced: Column) -> Column:
    """The amount of a root's calculation (columns of `calculations`) for an event; null where a fact that it needs is."""
    money = "decimal(24,6)"
    wide = lambda c: c.cast(money)
    payable = F.greatest(days - F.col("excluded_days"), F.lit(0))
    payable = F.when(days.isNotNull(), F.when(F.col("most_days").isNull(), payable).otherwise(F.least(payable, F.col("most_days"))))
    mode = F.col("mode")
    gross = F.when(mode == "daily", wide(insured * payable.cast("decimal(6,0)"))).when(mode == "fixed", wide(F.col("base"))).when(mode == "insured_ratio", wide(insured * F.col("base").cast("decimal(14,12)"))).when(mode == "indemnity", wide(covered))
    zero = F.lit(0).cast(money)
    reduce_ = lambda g: F.when(F.col("factor").isNull(), g).otherwise(F.when(reduced, wide(g * F.col("factor").cast("decimal(14,12)"))).when(~reduced, g))
    deduct = lambda g: F.when(F.col("deductible").isNull(), g).otherwise(F.when(g.isNotNull(), F.greatest(wide(g - wide(F.col("deductible"))), zero)))
    cap = lambda g: F.when(F.col("most").isNull(), g).otherwise(F.when(g.isNotNull(), F.least(g, wide(F.col("most")))))

    def whole(net: Column) -> Column:
        out = F.lit(None).cast("decimal(18,0)")
        for r in ("half_up", "half_even", "up", "down"):
            out = F.when(F.col("rounding") == r, rounded(net, r).cast("decimal(18,0)")).otherwise(out)
        return out

    return let(gross, lambda g: let(reduce_(g), lambda g: let(deduct(g), lambda g: let(cap(g), whole))))


def rules(graph: Graph) -> DataFrame:
    """The conditions and classifications that hold for each root: edition, root, region, ordinal, kind, operator, field, value, high, unit, codes.

    A line counts if it and the anchors on a way from the root have meaning; an anchor only if all it rests on does. count_below is the
    negation of "at least so many before", so that a history that is not known stays unknown.
    """
    at = ["edition", "root"]
    anchored = graph.nodes.where("anchor and supported").select(*_KEY)
    links = graph.edges.where("to_region is not null and region <> to_region").select(*_KEY, "to_region").distinct()
    links = links.join(anchored, _KEY, "left_semi").join(anchored.withColumnRenamed("region", "to_region"), ["edition", "to_region"], "left_semi")
    pair = lambda c: F.struct("edition", F.col(c).alias("region"))
    roots = graph.within.select("edition", F.col("root").alias("region")).distinct().join(anchored, _KEY, "left_semi")
    way = reachable(links.select(pair("region").alias("a"), pair("to_region").alias("b")), roots.select(pair("region").alias("root")))
    way = way.select(F.col("root.edition").alias("edition"), F.col("root.region").alias("root"), F.col("node.region").alias("region"))
    sound = graph.regions.where("not unresolved").select(*_KEY, F.lit(True).alias("_sound"))
    inside = graph.within.join(graph.edges.where("relation = 'OVERRIDES' and to_region is not null"), _KEY).select(*at, F.col("to_region").alias("region"), F.col("to_ordinal").alias("ordinal")).distinct()
    own = way.join(graph.nodes.where("supported and m.kind in ('condition', 'classification')"), _KEY).join(inside, [*at, "region", "ordinal"], "left_anti").join(sound, _KEY, "left")
    own = own.where(~F.col("anchor") | F.coalesce("_sound", F.lit(False)))
    negated = F.when(F.col("m.detail") == "count_below", "not count_before").otherwise(F.coalesce("m.detail", F.lit("in")))
    return own.select(*at, "region", "ordinal", F.coalesce("m.rule", F.lit("classification")).alias("kind"), negated.alias("operator"), "m.field", F.coalesce("m.value", F.when(F.col("m.kind") == "condition", "true")).alias("value"), "m.high", "m.unit", "m.codes")
