"""Binding a value to a name inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it: expressions nest without growing exponentially.

    Spark evaluates such a binding outside generated code, so shallow trees are better off without.
    """
    return F.transform(F.array(value), body)[0]
