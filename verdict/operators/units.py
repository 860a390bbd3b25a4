"""Units of formulas, bound over tables of expression nodes: up the trees by level, then down again.

A formula is a tree of nodes; a node's own unit follows from its children's, what it is expected to be from its parent's. One round for
each level up (a node's unit, whether fields stand in it, what is wrong with it) and one down (plain numbers take the unit that the sum or the
branch around them has); all formulas at once, so depth, not their number, is the number of rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.functions.checkpoints import checkpoint

#: The units of fields.
FIELDS = {
    "Rider.insured_amount": "MONEY",
    "Receipt.covered_amount": "MONEY",
    "Receipt.confirmed_amount": "MONEY",
    "MedicalEvent.admission_days": "DAYS",
    "ClaimHistory.counted_occurrence": "COUNT",
    "ClaimHistory.remaining_occurrences": "COUNT",
    "MedicalEvent.reduction_applies": "BOOLEAN",
    "MedicalEvent.admission": "BOOLEAN",
    "MedicalEvent.performed": "BOOLEAN",
    "MedicalEvent.planned": "BOOLEAN",
    "MedicalEvent.diagnosis_confirmed": "BOOLEAN",
    "MedicalEvent.separately_billed_treatment": "BOOLEAN",
}
INSURED, DAYS, RECEIPTS = "Rider.insured_amount", "MedicalEvent.admission_days", ("Receipt.covered_amount", "Receipt.confirmed_amount")
DEPTH = 16
UNSUPPORTED, MISMATCH, CURRENCY = "CALCULATION_SOURCE_UNIT_UNSUPPORTED", "CALCULATION_UNIT_MISMATCH", "CALCULATION_CURRENCY_MISMATCH"


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The nodes by their distance from the root, with their path."""
    own = checkpoint(nodes.select("formula", "node", "parent", "position", "op", "field", "number"))  # read by each level
    at = checkpoint(own.where("parent is null").withColumn("path", F.lit("/calculation")).withColumn("order", F.lit("0")))
    out = []
    while not at.isEmpty():
        if len(out) == DEPTH:
            raise ValueError("CALCULATION_SOURCE_BUDGET_EXCEEDED")
        out.append(at)
        above = at.select("formula", F.col("node").alias("parent"), F.col("path").alias("_path"), F.col("order").alias("_order"))
        step = own.join(above, ["formula", "parent"]).withColumn("path", F.concat("_path", F.lit("/args/"), F.col("position").cast("string")))
        at = checkpoint(step.withColumn("order", F.concat("_order", F.lit("."), F.lpad(F.col("position").cast("string"), 4, "0"))).drop("_path", "_order"))
    return out


def _leaf(level: DataFrame) -> tuple[Column, Column]:
    """A field's or a number's unit and error."""
    known = F.element_at(F.create_map(*(F.lit(x) for pair in FIELDS.items() for x in pair)), F.col("field"))
    return F.when(F.col("field").isNotNull(), known).when(F.col("number").isNotNull(), "NUMBER"), F.when(F.col("field").isNotNull() & known.isNull(), UNSUPPORTED)


def _up(level: DataFrame, below: DataFrame | None, kind: DataFrame) -> DataFrame:
    """A level's nodes with unit, fields, n_dimensions, daily and error (order, code), the first in the order of reading."""
    unit, wrong = _leaf(level)
    mine = F.when(wrong.isNotNull(), F.struct(F.concat("order", F.lit("~")).alias("order"), wrong.alias("code")))
    error_type = "struct<order:string,code:string>"
    if below is None:
        return level.select("*", unit.alias("unit"), F.when(F.col("field").isNotNull(), F.array("field")).otherwise(F.array().cast("array<string>")).alias("fields"), F.lit(0).alias("n_dimensions"), F.lit(False).alias("daily"), mine.cast(error_type).alias("error"))
    child = F.struct("position", "unit", "fields", "field", "number")
    inside = below.groupBy("formula", F.col("parent").alias("node")).agg(F.sort_array(F.collect_list(child)).alias("c"), F.min("error").alias("_first"), F.bool_or("daily").alias("_daily"), F.array_distinct(F.flatten(F.collect_list("fields"))).alias("_fields"))
    x = level.join(inside, ["formula", "node"], "left").join(kind, "formula")
    op, c = F.col("op"), F.col("c")
    # Columns of their own, so that what reads them doesn't compute them again.
    x = x.withColumn("_args", F.when(op == "if", F.slice(c, 2, 1000)).otherwise(c))
    args, dims = F.col("_args"), F.col("_dims")
    x = x.withColumn("_dims", F.transform(F.filter(args, lambda a: ~a["unit"].isin("NUMBER", "RATIO")), lambda a: a["unit"]))
    first, last = F.get(c, F.lit(0)), F.get(c, F.lit(1))
    money, days = F.when(first["unit"] == "MONEY", first).otherwise(last), F.when(first["unit"] == "MONEY", last).otherwise(first)
    daily = (op == "multiply") & (F.size(c) == 2) & (F.array_sort(F.transform(c, lambda a: a["unit"])) == F.array(F.lit("DAYS"), F.lit("MONEY")))
    daily &= (F.col("rule_kind") == "rate_amount") & (F.col("calculation_kind") == "FIXED") & money["field"].eqNullSafe(F.lit(INSURED)) & (days["fields"] == F.array(F.lit(DAYS)))
    x = x.withColumn("_by_day", F.coalesce(daily, F.lit(False))).withColumn("_one", F.coalesce(F.get(dims, F.lit(0)), F.lit("NUMBER")))
    daily, one = F.col("_by_day"), F.col("_one")
    # Of a sum or a branch, what is of another unit must be plain numbers, which take that unit.
    unlike = F.exists(args, lambda a: (a["unit"] != one) & (F.size(a["fields"]) > 0))
    early = (op == "if") & ~F.coalesce((F.size(c) == 3) & (first["unit"] == "BOOLEAN") & first["field"].isNotNull(), F.lit(False))
    clash = F.exists(args, lambda a: a["unit"] == "BOOLEAN") | F.when(op == "multiply", (F.size(dims) > 1) & ~daily).otherwise((F.size(F.array_distinct(dims)) > 1) | unlike)
    found = F.when(op.isNull(), mine).when(early, F.struct(F.concat("order", F.lit("!")).alias("order"), F.lit(UNSUPPORTED).alias("code")))
    found = found.when(c.isNull(), F.struct(F.concat("order", F.lit("~")).alias("order"), F.lit(UNSUPPORTED).alias("code"))).when(clash, F.struct(F.concat("order", F.lit("~")).alias("order"), F.lit(MISMATCH).alias("code")))
    whole = F.when(op.isNull(), unit).when(daily, "MONEY").otherwise(one)
    fields = F.when(F.col("field").isNotNull(), F.array("field")).otherwise(F.coalesce("_fields", F.array().cast("array<string>")))
    return x.select(*level.columns, whole.alias("unit"), fields.alias("fields"), F.coalesce(F.size(dims), F.lit(0)).alias("n_dimensions"), (F.coalesce("_daily", F.lit(False)) | daily).alias("daily"), F.least(F.col("_first"), found.cast(error_type)).alias("error"))


def bind_units(formulas: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The binding of each formula, and the unit of each of its places.

    formulas: formula, rule_kind, calculation_kind, currency (the caller's, or null), source_currency (of the text, or null). nodes: formula, node,
    parent (null at the root), position (from 0), op (if, multiply, add, subtract, min, max, round), or field, or number.

    Bindings: formula, state (BOUND, CURRENCY_UNRESOLVED), basis, unit, error (the first in the order of reading; then there is nothing else).
    Places: formula, path, unit, currency; a number that scales money by 0 to 1 in a rate is a RATIO. Money has no place while the currency
    is not known.
    """
    kind = formulas.select("formula", "rule_kind", "calculation_kind")
    levels, done = _levels(nodes), []
    below = None
    for level in reversed(levels):
        below = checkpoint(_up(level, below, kind))
        done.append(below)
    done.reverse()  # from the root down
    if not done:
        raise ValueError("no formulas")
    root = done[0].join(kind, "formula")
    wanted = F.col("rule_kind") == "fixed_amount"
    plain = (F.col("unit") == "NUMBER") & (F.size("fields") == 0)
    final = F.when(wanted & plain, "MONEY").otherwise(F.col("unit"))
    late = F.when(wanted & (final != "MONEY"), MISMATCH).when(final != "MONEY", UNSUPPORTED)
    root = root.withColumn("final", final).withColumn("code", F.coalesce("error.code", late))
    at = checkpoint(root.drop("rule_kind", "calculation_kind"))
    placed = [at]
    for level in done[1:]:
        above = at.select("formula", F.col("node").alias("parent"), F.col("op").alias("_op"), F.col("final").alias("_final"), F.col("n_dimensions").alias("_n"))
        x = level.join(above, ["formula", "parent"]).join(kind, "formula")
        ratio = (F.col("_op") == "multiply") & (F.col("_final") == "MONEY") & (F.col("_n") == 1) & (F.col("rule_kind") == "rate_amount") & F.coalesce(F.col("number").try_cast("decimal(38,18)").between(0, 1), F.lit(False))
        predicate = (F.col("_op") == "if") & (F.col("position") == 0)
        final = F.when(ratio, "RATIO").when((F.col("_op") == "multiply") | predicate, F.col("unit")).otherwise(F.col("_final"))
        at = checkpoint(x.withColumn("final", final).select(*level.columns, "final"))
        placed.append(at)
    places = reduce(DataFrame.unionByName, (p.select("formula", "path", "final") for p in placed))
    scaled = places.where("final = 'RATIO'").select("formula").distinct().withColumn("_ratio", F.lit(True))
    top = formulas.join(placed[0].select("formula", "fields", "daily", F.col("final").alias("unit"), "code"), "formula").join(scaled, "formula", "left")
    has = lambda *f: F.arrays_overlap("fields", F.array(*map(F.lit, f)))
    basis = F.when(F.col("daily"), "DAILY_INSURED_AMOUNT").when(has(*RECEIPTS), "RECEIPT_AMOUNT").when(F.col("_ratio") & has(INSURED), "INSURED_RATIO").when(has(INSURED), "INSURED_AMOUNT")
    basis = basis.when((F.size("fields") == 0) & (F.col("rule_kind") == "fixed_amount"), "FIXED_AMOUNT").otherwise("NUMERIC_EXPRESSION")
    odd = lambda c: F.coalesce(~F.col(c).rlike("^[A-Z]{3}$"), F.lit(False))
    code = F.when(odd("currency") | odd("source_currency"), "CALCULATION_SOURCE_INVALID").when(F.col("currency") != F.col("source_currency"), CURRENCY).otherwise(F.col("code"))
    sound, known = code.isNull(), F.col("currency").isNotNull()
    bound = top.select("formula", F.when(sound, F.when(known, "BOUND").otherwise("CURRENCY_UNRESOLVED")).alias("state"), F.when(sound, basis).alias("basis"), F.when(sound, F.col("unit")).alias("unit"), code.alias("error"), F.col("currency").alias("_currency"))
    bound = checkpoint(bound)
    hints = places.join(bound.where("error is null").select("formula", "_currency"), "formula").where("final <> 'MONEY' or _currency is not null")
    return bound.drop("_currency"), hints.select("formula", "path", F.col("final").alias("unit"), F.when(F.col("final") == "MONEY", F.col("_currency")).alias("currency"))
