"""A small, safe rule language compiled to column expressions: Python syntax, whitelisted, never evaluated per row."""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class RuleError(ValueError):
    """The rule uses something that the language does not have."""


#: Functions of the language. Each takes columns and gives a column.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": lambda x: F.abs(x),
    "is_empty": lambda x: x.isNull() | (x.cast("string") == ""),
    "lower": lambda x: F.lower(x),
    "upper": lambda x: F.upper(x),
    "day": lambda x: F.coalesce(F.dayofmonth(x), F.lit(99)),
    "starts_with": lambda x, y: F.startswith(x, y),
    "has": lambda x, y: F.contains(x, y),
}

_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b)}
_COMPARE = {
    ast.Eq: lambda a, b: a.eqNullSafe(b),
    ast.NotEq: lambda a, b: ~a.eqNullSafe(b),
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Rule:
    id: str
    when: str
    classify: str


def compile_rule(text: str, columns: set[str]) -> Column:
    """A boolean column for a rule over ``columns``; names may be dotted (record.kind is the column record_kind).

    Missing values never make a rule fail: a comparison with null is false, equality with None is a null test, a
    division by zero is null. ``//`` rounds down and ``%`` takes the divisor's sign, as in the rules' own language.
    """
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise RuleError(f"not a rule: {e.msg}") from None

    def name(node: ast.expr) -> str:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            return f"{name(node.value)}_{node.attr}"
        raise RuleError("only names and dotted names can be read")

    def go(node: ast.expr) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [F.coalesce(go(v), F.lit(False)) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if isinstance(node.op, ast.And) else (out | p)
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~F.coalesce(go(node.operand), F.lit(False))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -go(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = go(node.left), go(node.right)
            if isinstance(node.op, ast.FloorDiv):
                return F.floor(F.try_divide(a, b))
            if isinstance(node.op, ast.Mod):
                return a - b * F.floor(F.try_divide(a, b))
            if type(node.op) in _BINARY:
                return _BINARY[type(node.op)](a, b)
        if isinstance(node, ast.Compare):
            out, left = F.lit(True), node.left
            for op, right in zip(node.ops, node.comparators):
                if isinstance(op, (ast.In, ast.NotIn)):
                    if not isinstance(right, (ast.Tuple, ast.List, ast.Set)):
                        raise RuleError("in needs a list of constants")
                    hit = F.coalesce(go(left).isin([ast.literal_eval(x) for x in right.elts]), F.lit(False))
                    test = ~hit if isinstance(op, ast.NotIn) else hit
                elif type(op) in _COMPARE:
                    test = F.coalesce(_COMPARE[type(op)](go(left), go(right)), F.lit(False))
                else:
                    raise RuleError(f"{type(op).__name__} is not in the language")
                out, left = out & test, right
            return out
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            if node.func.id not in FUNCTIONS:
                raise RuleError(f"no function {node.func.id}")
            return FUNCTIONS[node.func.id](*(go(a) for a in node.args))
        if isinstance(node, ast.Constant) and (node.value is None or isinstance(node.value, (bool, int, float, str))):
            return F.lit(node.value)
        if isinstance(node, (ast.Name, ast.Attribute)):
            n = name(node)
            if n.startswith("_") or "__" in n or n not in columns:
                raise RuleError(f"no column {n}")
            return F.col(n)
        raise RuleError(f"{type(node).__name__} is not in the language")

    return F.coalesce(go(tree), F.lit(False))


def first_match(rules: list[Rule], columns: set[str]) -> tuple[Column, Column]:
    """(classification, rule id) of the first rule that holds; a rule that does not compile is skipped."""
    kind, rule_id = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(rules):
        try:
            test = compile_rule(r.when, columns)
        except RuleError:
            continue
        kind, rule_id = F.when(test, r.classify).otherwise(kind), F.when(test, r.id).otherwise(rule_id)
    return kind, rule_id
