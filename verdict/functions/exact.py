"""Exact sums of decimals written as text, far beyond 38 digits: by limbs of 16 digits, each summed natively, carried once."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Digits before and behind the point that a sum can hold, and digits of a limb.
WHOLE, BEHIND, LIMB = 96, 80, 16
_N = (WHOLE + BEHIND) // LIMB
_BASE = "10000000000000000"


def is_amount(text: Column) -> Column:
    """Whether a text is a decimal without sign or exponent that fits the limbs (ten digits of room for the sum)."""
    return F.coalesce(text.rlike(rf"^\d{{1,{WHOLE - 10}}}(\.\d{{1,{BEHIND}}})?$"), F.lit(False))


def limb_sums(text: Column, over: WindowSpec | None = None) -> Column:
    """An aggregate, or one over a window: the sums of the limbs of all texts, least first. Texts that are no amount make it null."""
    of = (lambda x: x) if over is None else (lambda x: x.over(over))
    own = F.when(is_amount(text), text)
    digits = F.concat(F.lpad(F.substring_index(own, ".", 1), WHOLE, "0"), F.rpad(F.when(F.instr(own, ".") > 0, F.substring_index(own, ".", -1)).otherwise(""), BEHIND, "0"))
    limb = lambda i: of(F.sum(F.substring(digits, i * LIMB + 1, LIMB).cast("decimal(16,0)")))
    return F.when(of(F.bool_and(is_amount(text))), F.array(*(limb(i) for i in reversed(range(_N)))))


def carried(limbs: Column) -> Column:
    """The sum of limb sums as text, without zeros that say nothing; null if it needs more digits than there are limbs."""
    base = F.lit(_BASE).cast("decimal(17,0)")
    start = F.struct(F.lit(0).cast("decimal(26,0)").alias("carry"), F.lit("").alias("out"))

    def step(state: Column, limb: Column) -> Column:
        whole = (limb + state["carry"]).cast("decimal(28,0)")
        carry = F.floor(whole / base).cast("decimal(26,0)")
        rest = (whole - carry * base).cast("decimal(17,0)")
        return F.struct(carry.alias("carry"), F.concat(F.lpad(rest.cast("string"), LIMB, "0"), state["out"]).alias("out"))

    text = F.aggregate(limbs, start, step, lambda s: F.when(s["carry"] == 0, s["out"]))
    whole = F.regexp_replace(F.substring(text, 1, WHOLE), "^0+(?=.)", "")
    behind = F.regexp_replace(F.substring(text, WHOLE + 1, BEHIND), "0+$", "")
    return F.concat(whole, F.when(behind == "", "").otherwise(F.concat(F.lit("."), behind)))
