"""Three-valued results: a nullable boolean inside expressions, MATCH / NO_MATCH / UNKNOWN at the boundary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH, NO_MATCH, UNKNOWN = "MATCH", "NO_MATCH", "UNKNOWN"


def label(result: Column) -> Column:
    """The name of a nullable boolean."""
    return F.when(result, MATCH).when(~result, NO_MATCH).otherwise(UNKNOWN)


def truth(name: Column) -> Column:
    """The nullable boolean of a name; any other name is unknown."""
    return F.when(name == MATCH, F.lit(True)).when(name == NO_MATCH, F.lit(False))


def severity(result: Column) -> Column:
    """2 for false, 1 for unknown, 0 for true: the maximum over a group is the group's verdict."""
    return F.when(~result, 2).when(result, 0).otherwise(1)


def from_severity(level: Column) -> Column:
    return F.when(level == 0, F.lit(True)).when(level == 2, F.lit(False))


def fold(result: Column, required: Column, when_none: bool | None) -> Column:
    """Aggregate: false if any required result is false, else unknown if any is, else true.

    Only required rows count; a group without any has the verdict `when_none`. Not bool_and, which skips nulls.
    """
    level = F.max(F.when(required, severity(result)))
    return F.when(level.isNull(), F.lit(when_none).cast("boolean")).otherwise(from_severity(level))


def exclude(result: Column, is_exclusion: Column) -> Column:
    """Exclusion rules turn round: meeting one is a failure. Unknown stays unknown."""
    return F.when(is_exclusion, ~result).otherwise(result)


def precede(precondition: Column, verdict: Column) -> Column:
    """A false precondition wins; an unknown one only keeps a true verdict from being true."""
    return F.when(~precondition, F.lit(False)).when(precondition.isNull() & verdict, F.lit(None)).otherwise(verdict)


def collapse(good: Column, bad: Column) -> Column:
    """Aggregate over several mappings of one thing: none is unknown, any bad is false, all good is true, else unknown.

    bad and good skip nulls as SQL's bool_or and bool_and do.
    """
    none = F.count(F.lit(1)) == 0
    return F.when(none, F.lit(None)).when(F.bool_or(bad), F.lit(False)).when(F.bool_and(good), F.lit(True))
