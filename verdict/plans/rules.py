"""Rule documents: JSON expressions and calculations, validated on the driver and compiled to columns.

A rule is data. Validation is closed (known operators, typed fields, bounded size); compilation gives ordinary
columns over a row that holds one fact struct for each field, so Catalyst plans all rules of a query together.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdict.functions.facts import MISSING, STALE, UNCONFIRMED
from verdict.functions.tristate import label

#: Fixed values of the language.
KINDS = (
    "eligibility", "classification", "temporal", "exclusion", "frequency", "fixed_amount", "rate_amount",
    "indemnity_eligibility", "deductible", "limit", "required_document",
)
PREDICATES = ("all", "any", "not", "present", "equals", "in", "range", "date_between", "days_since", "count_before")
CALCULATIONS = ("add", "subtract", "multiply", "min", "max", "round", "if")
UNITS = ("date", "days", "occurrences", "amount", "currency")
ROUNDINGS = ("half_up", "half_even", "up", "down")
DEPTH, NODES, ITEMS = 16, 256, 16
_CODE = re.compile(r"[A-Z][A-Z0-9_]{0,63}")
# Fixed value: what makes a text look like code.
CODE = re.compile(
    r"(?:__|\b(?:eval|exec|import|lambda|compile|open|globals|locals|builtins|subprocess)\b"
    r"|javascript\s*:|\bos\s*\.\s*system\b|=>|[;{}])",
    re.IGNORECASE,
)


class RuleError(ValueError):
    """A rule that may not run; the code says why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Field:
    """A field that rules may name: its type, the units its literals may carry, its closed values if it has such."""

    kind: str
    units: tuple[str, ...] = ()
    values: tuple[str, ...] = ()


@dataclass
class Budget:
    nodes: int = 0

    def spend(self, depth: int) -> None:
        self.nodes += 1
        if depth > DEPTH or self.nodes > NODES:
            raise RuleError("RULE_TOO_LARGE")


def _harmless(x: object) -> None:
    """Refuses a document with code in any of its texts; names may only not begin with two low lines."""
    pending = [x]
    while pending:
        part = pending.pop()
        if isinstance(part, Mapping):
            if any(str(name).startswith("__") for name in part):
                raise RuleError("ARBITRARY_EXECUTABLE")
            pending += part.values()
        elif isinstance(part, list | tuple):
            pending += part
        elif callable(part) or isinstance(part, str) and CODE.search(part):
            raise RuleError("ARBITRARY_EXECUTABLE")


def _literal(kind: str, x: object, spec: Field):
    """The typed value of a literal of a field."""
    try:
        if kind == "date" and isinstance(x, str):
            return datetime.date.fromisoformat(x)
        if kind == "decimal" and isinstance(x, str | int) and not isinstance(x, bool):
            value = Decimal(x)
            if value >= 0 and value < 10**12 and -value.as_tuple().exponent <= 6:
                return value
        if kind == "integer" and isinstance(x, int) and not isinstance(x, bool) and x >= 0:
            return x
        if kind == "boolean" and isinstance(x, bool):
            return x
        if kind == "string" and isinstance(x, str) and 0 < len(x) <= 160 and (not spec.values or x in spec.values):
            return x
    except (ValueError, InvalidOperation):
        pass
    raise RuleError("INVALID_LITERAL")


def _spec(node: Mapping, fields: Mapping[str, Field]) -> Field:
    name = node.get("field")
    if not isinstance(name, str) or name not in fields:
        raise RuleError("UNKNOWN_FIELD")
    if isinstance(node.get("value"), Mapping):
        raise RuleError("UNSUPPORTED_CROSS_REFERENCE")
    return fields[name]


def validate_expression(node: object, fields: Mapping[str, Field], budget: Budget | None = None, depth: int = 1) -> set[str]:
    """Checks a predicate tree; gives the fields it names."""
    budget = budget or Budget()
    budget.spend(depth)
    if not isinstance(node, Mapping) or not set(node) <= {"op", "args", "field", "value", "unit"} or node.get("op") not in PREDICATES:
        raise RuleError("UNKNOWN_OPERATOR")
    op = node["op"]
    if op in ("all", "any", "not"):
        args = node.get("args")
        if not isinstance(args, list) or not 1 <= len(args) <= (1 if op == "not" else ITEMS):
            raise RuleError("INVALID_ARGUMENTS")
        named = set().union(*(validate_expression(a, fields, budget, depth + 1) for a in args))
        if op == "all":
            _no_contradiction(node, {})
        return named
    spec, value, unit = _spec(node, fields), node.get("value"), node.get("unit")
    if unit is not None and unit not in UNITS:
        raise RuleError("INVALID_UNIT")
    if op == "equals":
        _literal(spec.kind, value, spec)
    elif op == "in":
        if not isinstance(value, list) or not 1 <= len(value) <= ITEMS:
            raise RuleError("INVALID_ARGUMENTS")
        [_literal(spec.kind, v, spec) for v in value]
    elif op in ("range", "date_between"):
        kinds = ("date",) if op == "date_between" else ("integer", "decimal")
        if spec.kind not in kinds or not isinstance(value, list) or len(value) != 2:
            raise RuleError("INVALID_ARGUMENTS")
        if op == "range" and unit not in spec.units:
            raise RuleError("INVALID_UNIT")
        low, high = (_literal(spec.kind, v, spec) for v in value)
        if low > high:
            raise RuleError("CONFLICTING_DEFINITION")
    elif op in ("days_since", "count_before"):
        need = ("date", "days") if op == "days_since" else ("integer", "occurrences")
        if spec.kind != need[0] or unit != need[1]:
            raise RuleError("INVALID_UNIT")
        if isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise RuleError("INVALID_ARGUMENTS")
    return {node["field"]}


def _no_contradiction(node: Mapping, seen: dict[str, object]) -> None:
    """Under `all`, also nested ones, a field can't equal two values; under `any` it can."""
    for a in node["args"]:
        if a.get("op") == "all":
            _no_contradiction(a, seen)
        elif a.get("op") == "equals" and seen.setdefault(a["field"], a.get("value")) != a.get("value"):
            raise RuleError("CONFLICTING_DEFINITION")


def validate_calculation(node: object, fields: Mapping[str, Field], flag: str | None = None, budget: Budget | None = None, depth: int = 1) -> set[str]:
    """Checks a calculation tree; gives the fields it names. flag: the one field that `if` may test."""
    budget = budget or Budget()
    budget.spend(depth)
    if isinstance(node, str) and node in fields:
        if fields[node].kind not in ("decimal", "integer"):
            raise RuleError("INVALID_ARGUMENTS")
        return {node}
    if isinstance(node, str):
        _literal("decimal", node, Field("decimal"))
        return set()
    if not isinstance(node, Mapping) or node.get("op") not in CALCULATIONS or not set(node) <= {"op", "args", "rounding"}:
        raise RuleError("UNKNOWN_OPERATOR")
    op, args = node["op"], node.get("args")
    if (op == "round") != ("rounding" in node) or (op == "round" and node["rounding"] not in ROUNDINGS):
        raise RuleError("INVALID_ROUNDING")
    bounds = {"round": (1, 1), "if": (3, 3)}.get(op, (2, ITEMS))
    if not isinstance(args, list) or not bounds[0] <= len(args) <= bounds[1]:
        raise RuleError("INVALID_ARGUMENTS")
    named: set[str] = set()
    if op == "if":
        if flag is None or args[0] != flag:
            raise RuleError("INVALID_ARGUMENTS")
        named, args = {flag}, args[1:]
    return named.union(*(validate_calculation(a, fields, flag, budget, depth + 1) for a in args))


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    required: bool
    expression: Mapping | None
    calculation: Mapping | None
    reason: str
    fields: tuple[str, ...] = field(default=())


def compile_rule(name: str, document: str | Mapping, fields: Mapping[str, Field], flag: str | None = None) -> Rule:
    """A validated rule from its JSON document."""
    doc = json.loads(document) if isinstance(document, str) else document
    if not isinstance(doc, Mapping):
        raise RuleError("INVALID_RULE_TYPE")
    _harmless(doc)
    if doc.get("rule_kind") not in KINDS or not isinstance(doc.get("required"), bool) or doc.get("schema_version") != "1":
        raise RuleError("INVALID_RULE_TYPE")
    if not isinstance(doc.get("result_reason_code"), str) or not _CODE.fullmatch(doc["result_reason_code"]):
        raise RuleError("INVALID_REASON_CODE")
    evidence = doc.get("evidence_ids", [])
    if not isinstance(evidence, list) or not evidence or len(set(evidence)) < len(evidence):
        raise RuleError("INVALID_EVIDENCE")
    expression, calculation = doc.get("expression"), doc.get("calculation")
    if (expression is None) == (calculation is None):
        raise RuleError("EXPRESSION_OR_CALCULATION")
    named = validate_expression(expression, fields) if expression is not None else validate_calculation(calculation, fields, flag)
    if not named <= set(doc.get("input_field_paths", ())):
        raise RuleError("UNDECLARED_INPUT")
    return Rule(name, doc["rule_kind"], doc["required"], expression, calculation, doc["result_reason_code"], tuple(sorted(named)))


@dataclass(frozen=True)
class Outcome:
    """Columns of a predicate: nullable result, reason and the fields that are missing or conflicting, in first-seen order."""

    result: Column
    reason: Column
    missing: Column
    conflicting: Column
    evidence: Column

    def struct(self) -> Column:
        return F.struct(label(self.result).alias("result"), self.reason.alias("reason"), self.missing.alias("missing"), self.conflicting.alias("conflicting"), self.evidence.alias("evidence"))


_PARTS = ("result", "reason", "missing", "conflicting", "evidence")


def column_name(field: str) -> str:
    """The column that holds a field's fact, unless a query names another."""
    return field.replace(".", "_").lower()


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def compile_expression(node: Mapping, fields: Mapping[str, Field], name=column_name, reference: str | None = None) -> Outcome:
    """The outcome of a validated predicate over fact columns. name: the column of a field's fact; reference: the
    field of the date that `days_since` counts to.

    Every child's diagnostics are kept: nothing is cut short when the result is already known. Each part becomes one
    SQL expression.
    """
    x = _compile(node, fields, name, reference)
    return Outcome(*(F.expr(x[p]) for p in _PARTS))


def _label(result: str) -> str:
    return f"CASE WHEN {result} THEN 'MATCH' WHEN NOT ({result}) THEN 'NO_MATCH' ELSE 'UNKNOWN' END"


def _compile(node: Mapping, fields: Mapping[str, Field], name, reference: str | None) -> dict[str, str]:
    """The SQL of each part. A parent takes each child's result and diagnostics once, so the text grows with the rule."""
    op = node["op"]
    if op not in ("all", "any", "not"):
        return _leaf(node, fields, name, reference)
    children = [_compile(a, fields, name, reference) for a in node["args"]]
    results = [c["result"] for c in children]
    together = [f"array_distinct(concat({', '.join(c[p] for c in children)}))" for p in _PARTS[2:]]
    if op == "not":
        result = f"(NOT {results[0]})"
        reason = f"CASE WHEN {results[0]} THEN 'NOT_MATCH' WHEN NOT {results[0]} THEN 'NOT_NO_MATCH' ELSE 'NOT_UNKNOWN' END"
    else:
        result = "(" + (" AND " if op == "all" else " OR ").join(results) + ")"
        reason = f"concat('{op.upper()}_', {_label(result)})"
    return dict(zip(_PARTS, (result, reason, *together), strict=True))


def _sql_literal(kind: str, x: object, spec: Field) -> str:
    value = _literal(kind, x, spec)
    if kind == "date":
        return f"DATE'{value.isoformat()}'"
    if kind == "decimal":
        return f"CAST({_text(str(value))} AS DECIMAL(18,6))"
    return _text(value) if kind == "string" else str(value).upper() if kind == "boolean" else f"{value}L"


def _leaf(node: Mapping, fields: Mapping[str, Field], name, reference: str | None) -> dict[str, str]:
    """The outcome of a leaf: closed by the fact's gate, else whether its value meets the test."""
    op, field_name = node["op"], node["field"]
    spec, fact = fields[field_name], name(field_name)
    value, state, given = f"{fact}.value", f"{fact}.state", node.get("value")
    literal = lambda x: _sql_literal(spec.kind, x, spec)
    yes, no, extra = "DETERMINISTIC_VALUE_MATCH", "DETERMINISTIC_VALUE_MISMATCH", ""
    if op == "present":
        met, yes = "TRUE", "FACT_PRESENT"
    elif op == "equals":
        met = f"{value} = {literal(given)}"
    elif op == "in":
        met = f"{value} IN ({', '.join(map(literal, given))})"
    elif op in ("range", "date_between"):
        met, yes = f"{value} BETWEEN {literal(given[0])} AND {literal(given[1])}", "VALUE_IN_RANGE" if op == "range" else "DATE_IN_RANGE"
    elif op == "days_since":
        to = name(reference)
        met, yes, no = f"CASE WHEN {to}.state IS NULL THEN datediff({to}.value, {value}) >= {int(given)} END", "DAYS_THRESHOLD_MET", "DAYS_THRESHOLD_NOT_MET"
        extra = f" WHEN {state} IS NULL AND {to}.state IS NOT NULL THEN array({_text(reference)})"
    else:  # count_before: at least so many
        met, yes, no = f"{value} >= {int(given)}", "HISTORY_COUNT_MET", "HISTORY_COUNT_NOT_MET"
    none = "CAST(array() AS ARRAY<STRING>)"
    why = f"CASE WHEN {state} = 'stale' THEN '{STALE}' WHEN {state} = 'unconfirmed' THEN '{UNCONFIRMED}' WHEN {state} IS NOT NULL THEN '{MISSING}'"
    parts = (
        f"(CASE WHEN {state} IS NULL THEN {met} END)",
        f"{why} WHEN {met} THEN '{yes}' WHEN NOT ({met}) THEN '{no}' ELSE 'MISSING_REFERENCE_DATE' END",
        f"CASE WHEN {state} IN ('missing', 'unconfirmed') THEN array({_text(field_name)}){extra} ELSE {none} END",
        f"CASE WHEN {state} IN ('stale', 'conflicting') THEN array({_text(field_name)}) ELSE {none} END",
        f"CASE WHEN {state} = 'conflicting' OR ({state} IS NULL AND ({met}) IS NOT NULL) THEN {fact}.evidence_ids ELSE {none} END",
    )
    return dict(zip(_PARTS, parts, strict=True))


WITNESSES = "ARRAY<STRUCT<field: STRING, kind: STRING>>"


def compile_witnesses(node: Mapping, fields: Mapping[str, Field], topics: Mapping[str, str] | None = None, planned=None, name=column_name, reference: str | None = None) -> Column:
    """Why a validated predicate bears on an event: an array of (field, kind), distinct, in order of the rule.

    A leaf is a CONFIRMED_EVENT if it holds (of a boolean, true), a LOCAL_TOPIC if it is unknown and the field's topic (topics: a
    column of text) meets it, a PLANNED_EVENT if it holds for the planned facts (planned: the column of a field's planned fact).
    What does not hold has no witness, nor has anything under a `not`.
    """

    def walk(x: Mapping) -> str:
        none = f"CAST(array() AS {WITNESSES})"
        if x["op"] == "not":
            return none
        result = _compile(x, fields, name, reference)["result"]
        if x["op"] in ("all", "any"):
            return f"CASE WHEN NOT {result} THEN {none} ELSE array_distinct(concat({', '.join(map(walk, x['args']))})) END"
        if x["op"] not in ("equals", "in", "range", "present"):
            return none
        own, spec = x["field"], fields[x["field"]]
        why = lambda kind: f"array(named_struct('field', {_text(own)}, 'kind', '{kind}'))"
        positive = f" AND {name(own)}.value" if spec.kind == "boolean" else ""
        cases = [f"WHEN {result}{positive} THEN {why('CONFIRMED_EVENT')}"]
        if topics and own in topics and spec.kind == "string" and x["op"] in ("equals", "in"):
            asked = [x["value"]] if x["op"] == "equals" else x["value"]
            cases.append(f"WHEN {result} IS NULL AND {topics[own]} IN ({', '.join(map(_text, asked))}) THEN {why('LOCAL_TOPIC')}")
        if planned is not None:
            cases.append(f"WHEN {result} IS NULL AND {_compile(x, fields, planned, reference)['result']} THEN {why('PLANNED_EVENT')}")
        return f"CASE {' '.join(cases)} ELSE {none} END"

    return F.expr(walk(node))


def recompiled(document: str | Mapping, stored: Mapping, fields: Mapping[str, Field], flag: str | None = None) -> Rule:
    """The rule of a document if what is stored beside it (kind, required, reason, fields) is what it compiles to, else RULE_METADATA_MISMATCH."""
    rule = compile_rule(stored.get("name", ""), document, fields, flag)
    own = {"kind": rule.kind, "required": rule.required, "reason": rule.reason, "fields": sorted(rule.fields)}
    if any(stored.get(k) != v for k, v in own.items()):
        raise RuleError("RULE_METADATA_MISMATCH")
    return rule
