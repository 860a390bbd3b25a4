"""Facts: a value with its confirmation, evidence and staleness, and the gate that says whether it may be used."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confirmations a fact can have; the first two make it usable.
CONFIRMATIONS = ("user", "ai_structured", "unconfirmed", "conflicting")
MISSING, STALE, UNCONFIRMED = "MISSING_OR_CONFLICTING_FACT", "STALE_EVIDENCE", "UNCONFIRMED_FACT"


def fact(value: Column, confirmation: Column, stale: Column | None = None, evidence_ids: Column | None = None) -> Column:
    """A fact as one struct column. `state` says whether it may be used: null if so, else why not.

    The order of the tests matters: no value, then stale evidence, then conflicting, then not confirmed.
    """
    stale = F.coalesce(stale if stale is not None else F.lit(False), F.lit(False))
    state = F.when(value.isNull(), "missing").when(stale, "stale").when(confirmation == "conflicting", "conflicting").when(F.coalesce(confirmation.isin("user", "ai_structured"), F.lit(False)), F.lit(None)).otherwise("unconfirmed")
    evidence = evidence_ids if evidence_ids is not None else F.array().cast("array<string>")
    return F.struct(value.alias("value"), confirmation.alias("confirmation"), stale.alias("stale"), evidence.alias("evidence_ids"), state.alias("state"))


@dataclass(frozen=True)
class Gate:
    """open: the fact may be used. Otherwise why not, and whether it counts as missing or as conflicting."""

    open: Column
    reason: Column
    missing: Column
    conflicting: Column


def gate(of: Column) -> Gate:
    """The gate of a fact column."""
    state = of["state"]
    reason = F.when(state == "stale", STALE).when(state == "unconfirmed", UNCONFIRMED).when(state.isNotNull(), MISSING)
    return Gate(state.isNull(), reason, F.coalesce(state.isin("missing", "unconfirmed"), F.lit(False)), F.coalesce(state.isin("stale", "conflicting"), F.lit(False)))


def normalized(text: Column, kind: str) -> tuple[Column, Column]:
    """The typed value of a text and an error code: null is no error, text that does not fit the kind is one.

    kind: date (ISO), decimal (>= 0), integer (>= 0), boolean (true / false) or string. Nothing is filled in.
    """
    code = F.lit(f"INVALID_{kind.upper()}")
    if kind == "date":
        value = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    elif kind == "decimal":
        value = F.when(text.rlike(r"^\d+(\.\d{1,6})?$"), text.try_cast("decimal(18,6)"))
    elif kind == "integer":
        value = F.when(text.rlike(r"^\d+$"), text.try_cast("bigint"))
    elif kind == "boolean":
        value = F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))
    elif kind == "string":
        value = text
    else:
        raise ValueError(f"unknown kind {kind}")
    return value, F.when(text.isNotNull() & value.isNull(), code)


def provenance(source: Column, state: Column, stale: Column) -> Column:
    """The confirmation that a catalogue's source and state give a fact."""
    return (
        F.when(state == "CONFLICTING", "conflicting")
        .when(source == "TRUSTED", "user")
        .when((source == "AI_SUGGESTED") & ~F.coalesce(stale, F.lit(False)), "ai_structured")
        .otherwise("unconfirmed")
    )
