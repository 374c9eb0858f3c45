"""Filters over unit fields, with two truth values, compiled to columns that sources can push down.

A missing value makes EQ, IN, comparisons and CONTAINS false and their
negations true. NOT is moved to the leaves, so what reaches the scan is
comparisons and null tests joined by AND and OR.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = ("gt", "gte", "lt", "lte")
LEAVES = ("eq", "ne", "in", "not_in", *COMPARE, "contains")
OPPOSITE = {"eq": "ne", "ne": "eq", "in": "not_in", "not_in": "in"}
SCOPE_FIELDS = frozenset(("org", "space", "user", "agent", "session", "scope"))
BUILTIN = frozenset(("id", "tier", "lifecycle", "tags", "content", "t_event", "t_ingest", "t_valid", "t_invalid", "t_message", "project", "shard"))
SPACES = ("system_metadata", "user_metadata")


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class Group:
    op: str
    children: tuple


Expr = Leaf | Group


def kind(value: object) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        if isinstance(value, float) and not math.isfinite(value):
            raise FilterError("a number has to be finite")
        return "number"
    if isinstance(value, str):
        return "string"
    raise FilterError(f"{value!r} is no scalar")


def validate(expr: Expr) -> Expr:
    """The expression itself, if it is well formed."""
    if isinstance(expr, Group):
        if expr.op not in ("and", "or", "not") or not expr.children or (expr.op == "not" and len(expr.children) != 1):
            raise FilterError(f"{expr.op} with {len(expr.children)} parts")
        for c in expr.children:
            validate(c)
    elif expr.op not in LEAVES:
        raise FilterError(f"unknown operator {expr.op}")
    elif expr.op in ("in", "not_in"):
        if not isinstance(expr.value, (list, tuple)) or not expr.value or len({kind(v) for v in expr.value}) != 1:
            raise FilterError("IN takes a list of values of one kind")
    elif kind(expr.value) != "number" and expr.op in COMPARE:
        raise FilterError("comparisons take a number")
    return expr


def canonical(name: str) -> str:
    """A field's full name: built-in ones as they are, others in user metadata; scopes are no filters."""
    head = name.split(".", 1)[0]
    if head in SCOPE_FIELDS:
        raise FilterError(f"{name} belongs to the scope")
    if name in BUILTIN or (head in SPACES and "." in name):
        return name
    return f"user_metadata.{name}"


def parse(spec: dict | list, names: Callable[[str], str] = lambda n: n) -> Expr:
    """From nested dicts: {field: value}, {field: {op: value}}, {"AND": [...]}, {"OR": [...]}, {"NOT": {...}}; several keys and lists are joined by AND."""
    if isinstance(spec, list):
        return validate(_all([parse(s, names) for s in spec]))
    if not isinstance(spec, dict) or not spec:
        raise FilterError("a filter is a dict with something in it")
    parts: list[Expr] = []
    for key, value in spec.items():
        if key.upper() in ("AND", "OR"):
            if not isinstance(value, list) or not value:
                raise FilterError(f"{key} takes a list with something in it")
            parts.append(Group(key.lower(), tuple(parse(v, names) for v in value)))
        elif key.upper() == "NOT":
            parts.append(Group("not", (parse(value, names),)))
        elif isinstance(value, dict):
            if not value:
                raise FilterError(f"{key} has no operator")
            parts += [Leaf(names(key), op.lower(), tuple(v) if isinstance(v, list) else v) for op, v in value.items()]
        else:
            parts.append(Leaf(names(key), "in" if isinstance(value, list) else "eq", tuple(value) if isinstance(value, list) else value))
    return validate(_all(parts))


def _all(parts: list[Expr]) -> Expr:
    if not parts:
        raise FilterError("nothing to join")
    return parts[0] if len(parts) == 1 else Group("and", tuple(parts))


def unparse(expr: Expr) -> dict:
    """The dict that parses to the expression."""
    if isinstance(expr, Group):
        parts = [unparse(c) for c in expr.children]
        return {"NOT": parts[0]} if expr.op == "not" else {expr.op.upper(): parts}
    return {expr.field: {expr.op: [*expr.value] if isinstance(expr.value, tuple) else expr.value}}


def and_merge(user: Expr | None, *system: Expr) -> Expr | None:
    """System predicates and the user's as one whole: its OR cannot let in what they keep out."""
    parts = [*system, *([user] if user else [])]
    return _all(parts) if parts else None


def required_equality(expr: Expr, name: str) -> object | None:
    """The one value that the field must have for the expression to hold, if it forces one."""
    if isinstance(expr, Leaf):
        if expr.field == name and expr.op == "eq":
            return expr.value
        return expr.value[0] if expr.field == name and expr.op == "in" and len(set(expr.value)) == 1 else None
    found = [required_equality(c, name) for c in expr.children] if expr.op != "not" else []
    if expr.op == "and":
        return next((v for v in found if v is not None), None)
    return found[0] if expr.op == "or" and found[0] is not None and all(v == found[0] for v in found) else None


Resolve = Callable[[str], tuple[Column, str]]


def resolver(dtypes: list[tuple[str, str]]) -> Resolve:
    """Fields of a flat view by its column types; user and system metadata from maps of strings."""
    types = dict(dtypes)

    def resolve(name: str) -> tuple[Column, str]:
        head, _, rest = name.partition(".")
        if head in SPACES and head in types:
            return F.col(head)[rest], "string"
        if name not in types:
            raise FilterError(f"no field {name}")
        t = types[name]
        return F.col(name), "array" if t.startswith("array") else "bool" if t == "boolean" else "string" if t == "string" else "number"

    return resolve


def predicate(expr: Expr, resolve: Resolve, negated: bool = False) -> Column:
    """A column for filters: rows where it is not true are dropped. Use truth() where its value is kept."""
    if isinstance(expr, Group):
        if expr.op == "not":
            return predicate(expr.children[0], resolve, not negated)
        parts = [predicate(c, resolve, negated) for c in expr.children]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if (expr.op == "and") != negated else out | p
        return out
    op = expr.op
    if op in ("ne", "not_in"):
        op, negated = OPPOSITE[op], not negated
    c, t = resolve(expr.field)
    never = F.lit(negated)
    if op == "contains":
        if t != "array":
            return never
        has = F.array_contains(c, expr.value)
        return c.isNull() | ~F.coalesce(has, F.lit(False)) if negated else has
    if t == "array":
        return never
    if op in COMPARE:
        if t != "number":
            return never
        yes = {"gt": c > expr.value, "gte": c >= expr.value, "lt": c < expr.value, "lte": c <= expr.value}[op]
        no = {"gt": c <= expr.value, "gte": c < expr.value, "lt": c >= expr.value, "lte": c > expr.value}[op]
        return c.isNull() | no if negated else yes
    values = [*expr.value] if op == "in" else [expr.value]
    if kind(values[0]) != t:
        return never
    same = c.isin(values) if len(values) > 1 else c == values[0]
    return c.isNull() | ~same if negated else same


def truth(expr: Expr, resolve: Resolve) -> Column:
    """The same as a value: true or false, never null."""
    return F.coalesce(predicate(expr, resolve), F.lit(False))
