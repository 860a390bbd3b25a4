"""Decisions set at a time: preconditions, folds over required rules, evidence checks, question lists, summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdict.functions.tristate import fold, label, precede

#: Statuses that end a contract, and the order in which kinds of rules are listed.
INACTIVE = ("inactive", "expired", "cancelled")


def contract_precondition(evidence: Column, status: Column, own_status: Column, renewable: Column, checked: Column, day: Column, start: Column, end: Column, own_start: Column, own_end: Column) -> tuple[Column, Column]:
    """The nullable verdict and the reason of a contract at a day. The order of the tests is part of the meaning.

    own_*: of the part of the contract that is asked for; its period is the contract's where it has none.
    """
    inside = day.between(start, end)
    own_inside = day.between(F.coalesce(own_start, start), F.coalesce(own_end, end))
    inactive = F.coalesce(status.isin(*INACTIVE), F.lit(False)) | F.coalesce(own_status.isin(*INACTIVE), F.lit(False))
    active = F.coalesce((status == "active") & (own_status == "active"), F.lit(False))
    reason = (
        F.when(~F.coalesce(evidence, F.lit(False)), "EVIDENCE_MISSING")
        .when(inactive, "PART_INACTIVE")
        .when(~active, "STATUS_UNCONFIRMED")
        .when(F.coalesce(renewable, F.lit(False)) & checked.isNull(), "RENEWAL_UNCONFIRMED")
        .when(day.isNull(), "DATE_REQUIRED")
        .when(start.isNull() | end.isNull(), "PERIOD_UNCONFIRMED")
        .when(~inside, "OUTSIDE_CONTRACT_PERIOD")
        .when(~own_inside, "OUTSIDE_PART_PERIOD")
        .otherwise("PRECONDITIONS_MATCH")
    )
    verdict = F.when(reason.isin("PART_INACTIVE", "OUTSIDE_CONTRACT_PERIOD", "OUTSIDE_PART_PERIOD"), F.lit(False)).when(reason == "PRECONDITIONS_MATCH", F.lit(True))
    return verdict, reason


def decide(results: DataFrame, keys: list[str], result: Column, required: Column, when_none: bool | None, precondition: Column | None = None) -> DataFrame:
    """One row for each key: the verdict over its required rules and how many of them have each result.

    precondition: a nullable boolean that is the same in all rows of a key.
    """
    count = lambda c: F.count_if(required & F.coalesce(c, F.lit(False)))
    out = results.groupBy(*keys).agg(
        fold(result, required, when_none).alias("verdict"),
        count(result).alias("n_match"),
        count(~result).alias("n_no_match"),
        count(result.isNull()).alias("n_unknown"),
        F.bool_and(precondition if precondition is not None else F.lit(True)).alias("precondition"),
        F.count_if((precondition if precondition is not None else F.lit(True)).isNull()).alias("_open"),
    )
    before = F.when(F.col("_open") == 0, F.col("precondition"))
    return out.withColumn("verdict", label(precede(before, F.col("verdict")))).drop("precondition", "_open")


def evidence_complete(requested: DataFrame, approved: DataFrame, key: str, evidence: str) -> DataFrame:
    """Whether each key's requested evidence is all approved, without repeats: (key, complete, n_requested, n_found)."""
    found = approved.select(evidence, F.lit(1).alias("_found")).distinct()
    joined = requested.join(found, evidence, "left")
    out = joined.groupBy(key).agg(F.count(F.lit(1)).alias("n_requested"), F.countDistinct(evidence).alias("_distinct"), F.count("_found").alias("n_found"))
    ok = (F.col("n_requested") == F.col("_distinct")) & (F.col("n_requested") == F.col("n_found"))
    return out.select(key, ok.alias("complete"), "n_requested", "n_found")


def questions(outcomes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The fields to ask for, each once, in first-seen order of rules: (keys, position, field).

    outcomes: with columns missing and conflicting (arrays), in the order of the columns `order`.
    """
    asked = outcomes.select(*keys, *order, F.posexplode(F.concat("missing", "conflicting")).alias("_at", "field"))
    place = F.struct(*order, F.col("_at"))
    first = asked.groupBy(*keys, "field").agg(F.min(place).alias("_place"))
    numbered = F.row_number().over(Window.partitionBy(*keys).orderBy("_place"))
    return first.select(*keys, numbered.alias("position"), "field")


def rule_set_version(rules: DataFrame, keys: list[str], rule_id: str) -> DataFrame:
    """A digest of each key's distinct rules: 24 hex digits of SHA-256 of the sorted ids."""
    ids = F.array_join(F.sort_array(F.collect_set(F.col(rule_id).cast("string"))), ",")
    return rules.groupBy(*keys).agg(F.substring(F.sha2(ids, 256), 1, 24).alias("version"))


def completeness(parts: DataFrame, keys: list[str], incomplete: Column) -> DataFrame:
    """COMPLETE, PARTIAL, or UNAVAILABLE where the one column that marks a part (`part`) is null throughout."""
    n = F.count("part")
    state = F.when(n == 0, "UNAVAILABLE").when(F.max(F.when(F.col("part").isNotNull(), incomplete.cast("int"))) == 1, "PARTIAL").otherwise("COMPLETE")
    return parts.groupBy(*keys).agg(state.alias("completeness"), n.alias("n_parts"))


def unique_or_conflict(rows: DataFrame, keys: list[str], priority: str, value: str) -> DataFrame:
    """For each key the value of the highest priority; several distinct ones conflict and give null."""
    top = F.max(priority).over(Window.partitionBy(*keys))
    kept = rows.withColumn("_top", top).where(F.col(priority) == F.col("_top"))
    out = kept.groupBy(*keys).agg(F.countDistinct(value).alias("n_values"), F.min(value).alias("_value"))
    return out.select(*keys, F.when(F.col("n_values") == 1, F.col("_value")).alias("value"), F.when(F.col("n_values") > 1, "CONFLICTING").otherwise("RESOLVED").alias("state"))


#: Case endings that a Korean word of a phrase may carry.
ENDINGS = (
    "으로부터", "에게서", "에서", "으로", "까지", "부터", "에게", "께서", "처럼", "보다", "이나",
    "은", "는", "이", "가", "을", "를", "에", "의", "와", "과", "도", "만", "로", "나",
)


def phrase_facts(texts: DataFrame, key: str, folded: str, entries: list[tuple[str, str, str, int]]) -> DataFrame:
    """(key, path, value, state): what a dictionary's phrases say of each text, resolved by `unique_or_conflict`.

    folded: texts after compatibility composition and case folding. entries: phrase, path, value, priority; phrases are folded too.
    A phrase counts where its words (letters, digits, underscores) stand side by side in the text; a Korean word may carry a
    case ending. The dictionary is bounded rules, one pattern each; all are tested in one pass over the texts.
    """
    words = F.concat(F.lit(" "), F.regexp_replace(F.col(folded), r"(?U)[^\p{L}\p{N}_]+", " "), F.lit(" "))
    ending = "(?:" + "|".join(ENDINGS) + ")?"
    found = []
    for phrase, path, value, priority in entries:
        parts = [re.escape(w) + (ending if re.search("[가-힣]", w) else "") for w in re.findall(r"\w+", phrase)]
        if not parts:
            raise ValueError("EMPTY_PHRASE")
        said = F.struct(F.lit(path).alias("path"), F.lit(value).alias("value"), F.lit(priority).alias("priority"))
        found.append(F.when(F.col("_words").rlike(" " + " ".join(parts) + " "), said))
    marked = texts.select(key, F.regexp_replace(words, " +", " ").alias("_words"))
    rows = marked.select(key, F.explode(F.array_compact(F.array(*found))).alias("f")).select(key, "f.*")
    return unique_or_conflict(rows, [key, "path"], "priority", "value")
