"""Calculations compiled to columns, under the rules of one of three runtimes.

operational: no amount on the way may be negative, exceed the scale or the limit; no `if`; up is away from zero.
knowledge: amounts on the way may be negative, the final one not; `if` on a confirmed flag; up is ceiling.
guidance: as knowledge, with up away from zero.
Values are decimal(38,12): exact for all inputs within the bounds, and a product that is not is an error, never rounded.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdict.functions.binding import let
from verdict.functions.facts import gate
from verdict.functions.money import AMOUNT, fits, rounded
from verdict.plans.rules import Field, RuleError

RUNTIMES = ("operational", "knowledge", "guidance")


@dataclass(frozen=True)
class Amount:
    """The value (null on error) and the first error's code (null without one)."""

    value: Column
    error: Column


def compile_calculation(node: Mapping | str, fields: Mapping[str, Field], runtime: str, column=F.col) -> Amount:
    """The amount of a validated calculation over fact columns."""
    if runtime not in RUNTIMES:
        raise ValueError(runtime)
    x = _compile(node, fields, runtime, column)
    if runtime != "operational":
        negative = lambda r: _amount(F.when(r["value"] >= 0, r["value"]), F.coalesce(r["error"], F.when(r["value"] < 0, "INVALID_AMOUNT")))
        x = let(x, negative)
    return Amount(x["value"], x["error"])


def _amount(value: Column, error: Column) -> Column:
    return F.struct(value.cast(AMOUNT).alias("value"), error.cast("string").alias("error"))


def _compile(node: Mapping | str, fields: Mapping[str, Field], runtime: str, column) -> Column:
    """A struct of value and error; each child's stands in it once, so its size grows with the calculation's."""
    if isinstance(node, str):
        if node not in fields:
            return _amount(F.lit(Decimal(node)), F.lit(None))
        fact = column(node)
        g = gate(fact)
        return _amount(F.when(g.open, fact["value"]), F.when(fact["value"].isNull(), "MISSING_CALCULATION_FACT").when(~g.open, "UNCONFIRMED_CALCULATION_FACT"))
    op, args = node["op"], node["args"]
    if op == "if":
        if runtime == "operational":
            raise RuleError("UNSUPPORTED_CALCULATION_RULE")
        flag = column(args[0])
        usable = gate(flag).open & (flag["confirmation"] == "user")
        yes, no = (_compile(a, fields, runtime, column) for a in args[1:])
        return F.when(~usable, _amount(F.lit(None), F.lit("UNCONFIRMED_CALCULATION_FACT"))).when(flag["value"], yes).otherwise(no)

    def combined(parts: Column) -> Column:
        own = [parts[i]["value"] for i in range(len(args))]
        # A null operand makes the whole null: least and greatest would skip it.
        whole = reduce(lambda a, b: a & b, (v.isNotNull() for v in own))
        error = F.coalesce(*(parts[i]["error"] for i in range(len(args))))

        def checked(value: Column) -> Column:
            bounded = F.coalesce(fits(value, runtime != "operational"), F.lit(False))
            return _amount(F.when(whole & bounded, value), F.coalesce(error, F.when(whole & ~bounded, "INVALID_AMOUNT")))

        return let(_combine(op, own, node.get("rounding"), runtime).cast("decimal(24,6)"), checked)

    return let(F.array(*(_compile(a, fields, runtime, column) for a in args)), combined)


def _combine(op: str, values: list[Column], rounding: str | None, runtime: str) -> Column:
    if op == "round":
        return rounded(values[0], rounding, 0, "ceiling" if runtime == "knowledge" else "away")
    if op == "min":
        return F.least(*values)
    if op == "max":
        return F.greatest(*values)
    if op == "add":
        return reduce(lambda a, b: (a + b).cast("decimal(24,6)"), values)
    if op == "subtract":
        return reduce(lambda a, b: (a - b).cast("decimal(24,6)"), values)
    return reduce(_times, values)


def _times(a: Column, b: Column) -> Column:
    """An exact product of two amounts: decimal(18,6) times decimal(18,6) is decimal(37,12); one that needs more decimals is null."""
    exact = lambda p: F.when(p == F.round(p, 6), F.round(p, 6).try_cast("decimal(24,6)"))
    return let(a.try_cast(AMOUNT) * b.try_cast(AMOUNT), exact)


def infix(node: Mapping | str) -> str:
    """A calculation as text."""
    if isinstance(node, str):
        return node
    sign, args = {"add": " + ", "subtract": " - ", "multiply": " * "}.get(node["op"]), [infix(a) for a in node["args"]]
    if sign:
        return "(" + sign.join(args) + ")"
    return f"{node['op']}({', '.join(args)}" + (f"; {node['rounding']})" if "rounding" in node else ")")


def dimension(node: Mapping | str, units: Mapping[str, str]) -> str | None:
    """MONEY, DAYS, COUNT, RATIO or NUMBER of a calculation, None where it is not known.

    units: of fields; plain numbers are NUMBER. Sums, minima and maxima take one dimension (numbers go with any);
    a product has the one dimension that is not a number or ratio, and money times days or a count stays unknown.
    """
    if isinstance(node, str):
        return units.get(node, "NUMBER")
    own = [dimension(a, units) for a in (node["args"][1:] if node["op"] == "if" else node["args"])]
    if None in own:
        return None
    real = [d for d in own if d not in ("NUMBER", "RATIO")]
    if not real:
        return own[0]
    if node["op"] == "multiply":
        return real[0] if len(real) == 1 else None
    return real[0] if len(set(real)) == 1 else None
