"""Terms in force for an event: base editions with the changes of a scope laid over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdict.functions.checkpoints import checkpoint
from verdict.operators.components import led_to
from verdict.operators.graphs import layers

SCOPE = ("space", "contract", "member")


def _codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds (one that is null doesn't)."""
    return F.array_compact(F.array(*(F.when(c, F.lit(code)) for c, code in pairs)))


def _together(column: str) -> Column:
    return F.array_distinct(F.flatten(F.collect_list(column)))


def _none(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def changes(requests: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The changes that may bear on each request, with their `issues`; and the editions (request, node) that its scope's changes lead to.

    A change of a narrower scope that replaces an edition puts aside the wider ones of the same edition, unless it has issues itself.
    """
    within = relations.distinct().where("is_current and status <> 'NO_MATCH'").withColumnsRenamed({"rider": "_rider", "clause": "_clause"}).join(requests, list(SCOPE))
    within = within.where("(_rider is null or _rider = rider) and (_clause is null or _clause = clause)")
    within = within.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("request", "relation")))
    invalid = F.coalesce(F.col("effective_through") < F.col("effective_from"), F.lit(False))
    outside = F.coalesce(F.col("event_date") < F.col("effective_from"), F.lit(False)) | F.coalesce(F.col("event_date") > F.col("effective_through"), F.lit(False))
    adds, replaces = F.col("operation") == "ADD", F.col("operation") == "REPLACE"
    issues = _codes(
        (F.col("event_date").isNull(), "EVENT_DATE_UNRESOLVED"),
        (invalid, "CHANGE_PERIOD_INVALID"),
        (~invalid & F.col("effective_from").isNull(), "CHANGE_START_UNRESOLVED"),
        (F.col("status") == "UNKNOWN", "CHANGE_RELATION_UNRESOLVED"),
        (~F.coalesce(adds | replaces, F.lit(False)), "CHANGE_OPERATION_INVALID"),
        (F.col("next").isNull() | (adds & F.col("previous").isNotNull()) | (replaces & F.col("previous").isNull()), "CHANGE_TARGET_UNRESOLVED"),
        (F.col("previous") == F.col("next"), "CHANGE_CYCLE"),
        (F.col("_same") > 1, "CHANGE_RELATION_ID_CONFLICT"),
    )
    active = within.where(invalid | ~outside).withColumn("issues", issues)
    narrow = F.when(F.col("_clause").isNotNull(), 2).otherwise(F.col("_rider").isNotNull().cast("int"))
    own = Window.partitionBy("request", "previous")
    replacing = active.where(replaces & F.col("previous").isNotNull()).withColumn("_narrow", narrow).withColumn("_most", F.max("_narrow").over(own))
    unsure = F.max((F.col("_narrow") == F.col("_most")) & (F.size("issues") > 0)).over(own)
    replacing = replacing.withColumn("_unsure", unsure).where("_narrow = _most or _unsure")
    kept = replacing.unionByName(active.where(~F.coalesce(replaces & F.col("previous").isNotNull(), F.lit(False))), allowMissingColumns=True)
    kept = kept.select("request", "relation", "operation", "previous", "next", "effective_from", F.coalesce("reasons", _none()).alias("reasons"), "issues")
    return checkpoint(kept), within.where("next is not null").select("request", F.col("next").alias("node")).distinct()


def _start(known: DataFrame) -> DataFrame:
    """(request, node, base, reasons): what the base says of each edition; several statuses of one are a conflict."""
    many = F.min("status") != F.max("status")
    reasons = F.array_distinct(F.concat(F.flatten(F.collect_list(F.coalesce("reasons", _none()))), F.when(many, F.array(F.lit("BASE_EDITION_CONFLICT"))).otherwise(_none())))
    return known.groupBy("request", F.col("edition").alias("node")).agg(F.when(many, "UNKNOWN").otherwise(F.min("status")).alias("base"), reasons.alias("reasons"))


def _seeds(kept: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(request, node, codes, ids): marks that make an edition, and all that follows it, unknown. cyclic: the editions on a cycle or behind one."""
    id_, faulty = F.array("relation").alias("ids"), kept.where(F.size("issues") > 0)
    codes = F.array_union("issues", "reasons").alias("codes")
    ends = F.array_compact(F.array("next", F.when(~((F.col("operation") == "ADD") & F.col("next").isNull()), F.col("previous"))))
    broken = faulty.select("request", F.explode(ends).alias("node"), codes, id_)
    edges = kept.where("previous is not null and next is not null")
    competing = edges.groupBy("request", F.col("previous").alias("node")).agg(F.min("next").alias("_a"), F.max("next").alias("_b"), F.collect_set("relation").alias("ids")).where("_a <> _b")
    competing = competing.select("request", "node", F.array(F.lit("COMPETING_TERMS_REPLACEMENTS")).alias("codes"), "ids")
    through = kept.join(cyclic.withColumnRenamed("node", "previous"), ["request", "previous"], "left_semi").groupBy("request").agg(F.collect_set("relation").alias("ids"))
    cyclic = cyclic.join(through, "request").select("request", "node", F.array(F.lit("CHANGE_CYCLE")).alias("codes"), "ids")
    sound = edges.where(F.size("issues") == 0)
    later = sound.select("request", F.col("previous").alias("node"), F.col("relation").alias("_relation"), F.col("effective_from").alias("_from"))
    disorder = kept.where((F.size("issues") == 0) & F.col("next").isNotNull()).withColumn("node", F.col("next")).join(later, ["request", "node"]).where("_from < effective_from")
    disorder = disorder.select("request", "node", F.array(F.lit("CHANGE_SEQUENCE_INVALID")).alias("codes"), F.array("relation", "_relation").alias("ids"))
    return broken.unionByName(competing).unionByName(cyclic).unionByName(disorder)


def select_terms(requests: DataFrame, editions: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state of every edition for each request, and what became of each relation.

    requests: request, space, contract, member, rider, clause, event_date. editions: request, edition, status (MATCH, NO_MATCH,
    UNKNOWN), reasons. relations: relation, the scope's columns, operation (ADD, REPLACE), previous, next, effective_from,
    effective_through (inclusive), status, reasons, is_current.

    Editions: request, edition, status, relations, reasons. Relations: request, relation, state (APPLIED, UNCERTAIN), scope_reasons
    (of a change without a new edition). Changes with issues, competing successors, cycles and starts out of order make an edition
    unknown together with all that follows it; so does a predecessor that is not in force. Otherwise the state flows down the layers
    of the graph: what replaces takes the place of what it replaces, with the relations on the way.
    """
    kept, targets = changes(requests, relations)
    edges = kept.where("previous is not null and next is not null").select(F.col("request").alias("graph"), F.col("previous").alias("a"), F.col("next").alias("b")).distinct()
    ways = led_to(edges).withColumnRenamed("graph", "request")
    cyclic = checkpoint(ways.join(ways.where("root = node").select("request", "root"), ["request", "root"], "left_semi").select("request", "node").distinct())
    seeds = checkpoint(_seeds(kept, cyclic))
    base, key = _start(editions), ["request", "node"]
    sound = kept.where(F.size("issues") == 0)
    added = sound.where("operation = 'ADD' and next is not null").groupBy("request", F.col("next").alias("node")).agg(F.collect_set("relation").alias("ids"), _together("reasons").alias("codes"))
    steps = sound.where("operation = 'REPLACE'").groupBy("request", F.col("previous").alias("node")).agg(F.collect_set("relation").alias("ids"), _together("reasons").alias("codes"), F.min("next").alias("target"))
    steps = checkpoint(steps.join(cyclic, key, "left_anti"))
    entered = sound.where("operation = 'REPLACE'").select("request", F.col("next").alias("node")).unionByName(added.select(*key)).distinct()
    unmet = steps.select(*key).join(entered, key, "left_anti").join(base.where("base = 'MATCH'"), key, "left_anti")

    itself = edges.select(F.col("graph").alias("request"), F.col("a").alias("node")).unionByName(seeds.select(*key)).unionByName(steps.select(*key)).distinct()
    reach = checkpoint(ways.where("root <> node").unionByName(itself.select("request", F.col("node").alias("root"), "node")))
    marks = checkpoint(reach.join(seeds.withColumnRenamed("node", "root"), ["request", "root"]).groupBy(*key).agg(_together("codes").alias("codes"), _together("ids").alias("ids")))
    unsound = marks.select(*key).unionByName(reach.join(unmet.withColumnRenamed("node", "root"), ["request", "root"], "left_semi").select(*key)).distinct()
    bad, clean = checkpoint(steps.join(unsound, key, "left_semi")), checkpoint(steps.join(unsound, key, "left_anti"))

    # From steps that hold: the relations on the way go to all that follows by such steps (whatever lies between two of them is one), the
    # reasons to the next edition.
    passed = clean.join(added.select(*key, F.col("ids").alias("_added")), key, "left").select("request", F.col("node").alias("root"), F.array_union("ids", F.coalesce("_added", F.array().cast(added.schema["ids"].dataType))).alias("ids"))
    onward = reach.join(clean.select(*key, "target"), key).join(passed, ["request", "root"]).groupBy("request", F.col("target").alias("node")).agg(_together("ids").alias("ids"))

    # From steps that don't: all the edition has by then goes to all that follows it.
    reached_by_bad = checkpoint(reach.join(bad.select("request", F.col("node").alias("root")), ["request", "root"], "left_semi"))
    onto = checkpoint(clean.select("request", F.col("node").alias("_from"), F.col("target").alias("node"), "ids", "codes").join(marks.select(*key, F.lit(True).alias("_marked")), key, "left"))
    # Only where both kinds of step lead to an edition does their order count, so only these requests' layers are peeled.
    met = reached_by_bad.join(onto.where("_marked is null").select(*key).distinct(), key, "left_semi")
    disputed = checkpoint(met.select("request").distinct())
    placed = layers(edges.join(disputed.withColumnRenamed("request", "graph"), "graph", "left_semi")).where("layer is not null")
    placed = checkpoint(placed.select(F.col("graph").alias("request"), F.col("node").alias("_from"), F.struct("layer", "rank").alias("place")))
    first_bad = met.join(placed.withColumnsRenamed({"_from": "root", "place": "_place"}), ["request", "root"]).groupBy(*key).agg(F.min("_place").alias("_bad"))
    onto = onto.join(placed, ["request", "_from"], "left").join(first_bad, key, "left").drop("_from")
    in_time = F.col("_marked").isNull() & (F.col("_bad").isNull() | (F.col("_bad") > F.col("place")))
    onto = checkpoint(onto.withColumn("held", in_time))
    ids_kind = added.schema["ids"].dataType
    rows = [
        base.select(*key, F.col("reasons").alias("codes"), F.array().cast(ids_kind).alias("ids")),
        marks,
        added.join(marks.select(*key, F.lit(True).alias("_marked")), key, "left").select(*key, F.when(F.col("_marked").isNull(), F.array_append("codes", F.lit("TERMS_CHANGE_ADDED"))).otherwise(F.col("codes")).alias("codes"), "ids"),
        onto.select(*key, F.when(F.col("held"), F.array_append("codes", F.lit("TERMS_CHANGE_REPLACEMENT_APPLIES"))).otherwise(F.col("codes")).alias("codes"), F.array().cast(ids_kind).alias("ids")),
        onward.select(*key, _none().alias("codes"), "ids"),
    ]
    own = checkpoint(reduce(DataFrame.unionByName, rows).groupBy(*key).agg(_together("codes").alias("codes"), _together("ids").alias("ids")))
    lost = bad.select(*key, "ids", F.array_append("codes", F.lit("PREVIOUS_EDITION_UNRESOLVED")).alias("codes")).unionByName(own.join(bad.select(*key), key, "left_semi"))
    lost = checkpoint(lost.groupBy(*key).agg(_together("codes").alias("codes"), _together("ids").alias("ids")))
    fallen = reached_by_bad.join(lost.withColumnRenamed("node", "root"), ["request", "root"]).select(*key, "codes", "ids")
    replaced = clean.select(*key, F.array_append("codes", F.lit("TERMS_CHANGE_REPLACED")).alias("codes"), "ids")

    flag = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    unknown = marks.select(*key).unionByName(fallen.select(*key))
    in_force = added.select(*key).unionByName(onto.select(*key))
    whole = own.unionByName(fallen).unionByName(replaced).unionByName(targets.select(*key, _none().alias("codes"), F.array().cast(ids_kind).alias("ids"))).groupBy(*key).agg(_together("codes").alias("codes"), _together("ids").alias("ids"))
    whole = whole.join(base.select(*key, "base"), key, "left")
    for df, name in ((unknown, "_unknown"), (clean, "_replaced"), (in_force, "_in_force")):
        whole = whole.join(flag(df, name), key, "left")
    status = F.when(F.col("_unknown"), "UNKNOWN").when(F.col("_replaced"), "NO_MATCH").when(F.col("_in_force"), "MATCH").otherwise(F.coalesce("base", F.lit("NO_MATCH")))
    states = whole.select("request", F.col("node").alias("edition"), status.alias("status"), F.array_sort("ids").alias("relations"), F.array_sort("codes").alias("reasons"))

    doubtful = [
        kept.where(F.size("issues") > 0).select("request", "relation"),
        seeds.select("request", F.explode("ids").alias("relation")),
        added.join(marks, key, "left_semi").select("request", F.explode("ids").alias("relation")),
        lost.select("request", F.explode("ids").alias("relation")),
        onto.where("not held").select("request", F.explode("ids").alias("relation")),
    ]
    uncertain = reduce(DataFrame.unionByName, doubtful).distinct()
    applied = added.join(marks, key, "left_anti").select("request", F.explode("ids").alias("relation")).unionByName(onto.where("held").select("request", F.explode("ids").alias("relation"))).distinct()
    targetless = kept.where((F.size("issues") > 0) & F.col("next").isNull()).select("request", "relation", F.array_union("issues", "reasons").alias("codes"))
    targetless = targetless.groupBy("request", "relation").agg(F.array_sort(_together("codes")).alias("scope_reasons"))
    fate = uncertain.withColumn("state", F.lit("UNCERTAIN")).unionByName(applied.join(uncertain, ["request", "relation"], "left_anti").withColumn("state", F.lit("APPLIED")))
    return states, fate.join(targetless, ["request", "relation"], "left").select("request", "relation", "state", "scope_reasons")
