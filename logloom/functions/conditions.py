"""Relation-rule conditions compiled to one Catalyst predicate."""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.scalars import NULL_WORDS, clean

# Condition grammar. Clauses are joined by AND; "not" forms come first.
FIELD = r"^(?P<field>[A-Za-z_][A-Za-z0-9_]*)"
CLAUSES = (
    ("not_null", FIELD + r"\s+not\s+null$"),
    ("is_null", FIELD + r"\s+is\s+null$"),
    ("not_indicates", FIELD + r"\s+not\s+indicates\s+(?P<value>.+)$"),
    ("indicates", FIELD + r"\s+indicates\s+(?P<value>.+)$"),
    ("!=", FIELD + r"\s*!=\s*(?P<value>.+)$"),
    (">=", FIELD + r"\s*>=\s*(?P<value>.+)$"),
    ("<=", FIELD + r"\s*<=\s*(?P<value>.+)$"),
    (">", FIELD + r"\s*>\s*(?P<value>.+)$"),
    ("<", FIELD + r"\s*<\s*(?P<value>.+)$"),
    ("=", FIELD + r"\s*==?\s*(?P<value>.+)$"),
    ("in", FIELD + r"\s+in\s*\((?P<value>.+)\)$"),
)
ALWAYS = {"", "true", "always"}
NUMBER = r"(?i)^[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity)$"


@dataclass(frozen=True)
class Clause:
    field: str
    op: str
    operand: str = ""

    @property
    def items(self) -> list[str]:
        parts = (unquote(p) for p in self.operand.split(","))
        return [p for p in parts if p]


def unquote(text: str) -> str:
    return text.strip().strip("\"'")


def parse(expression: str | None) -> list[Clause]:
    """Clauses of a conjunction; an empty list is always true."""
    text = (expression or "").strip()
    if text.lower() in ALWAYS:
        return []
    found = []
    for part in filter(None, (p.strip() for p in re.split(r"(?i)\s+AND\s+", text))):
        for op, shape in CLAUSES:
            hit = re.match(shape, part, re.IGNORECASE)
            if hit:
                operand = hit.groupdict().get("value") or ""
                found.append(Clause(hit["field"], op, operand if op == "in" else unquote(operand)))
                break
        else:
            raise ValueError(f"unsupported condition clause: {part!r}")
    return found


def fields(expression: str | None) -> list[str]:
    return list(dict.fromkeys(c.field for c in parse(expression)))


def _ordered(value: Column, operand: str, op: str) -> Column:
    def compare(left: Column, right: Column) -> Column:
        return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]

    by_text = compare(F.lower(value), F.lit(operand.lower()))
    if not re.match(NUMBER.replace("(?i)", ""), operand, re.IGNORECASE):
        return by_text
    by_number = compare(value.try_cast("double"), F.lit(float(operand)))
    return F.when(value.rlike(NUMBER), by_number).otherwise(by_text)


def _predicate(clause: Clause, columns: Collection[str], cleaned: bool) -> Column:
    if clause.field not in columns:
        value = F.lit(None).cast("string")
    else:
        value = F.col(f"`{clause.field}`") if cleaned else clean(F.col(f"`{clause.field}`"))
    operand = None if clause.operand.strip().lower() in NULL_WORDS else clause.operand.strip()
    if clause.op == "not_null":
        return value.isNotNull()
    if clause.op == "is_null":
        return value.isNull()
    if clause.op == "in":
        return F.lower(value).isin([i.lower() for i in clause.items]) if clause.items else F.lit(False)
    if operand is None:
        return value.isNotNull() if clause.op in ("!=", "not_indicates") else F.lit(False)
    if clause.op == "indicates":
        return F.lower(value).contains(operand.lower())
    if clause.op == "not_indicates":
        return ~F.lower(value).contains(operand.lower())
    if clause.op == "=":
        return F.lower(value) == operand.lower()
    if clause.op == "!=":
        return F.lower(value) != operand.lower()
    return _ordered(value, operand, clause.op)


def compile_condition(expression: str | None, columns: Collection[str], cleaned: bool = False) -> Column:
    """Predicate that is true or false, never NULL; a field the table lacks reads as NULL.

    ``cleaned`` says that the columns are trimmed already, with NULL for null words.
    """
    result = F.lit(True)
    for clause in parse(expression):
        result = result & F.coalesce(_predicate(clause, columns, cleaned), F.lit(False))
    return result
