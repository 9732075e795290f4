"""Conditions, numbers with units, and arithmetic formulas, read from text.

Formulas are parsed and turned into Columns, never evaluated.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.units import Unit, UnitError, parse

#: Signs as words; of two signs that fit, the longer one is read.
SIGNS = {"<=": "le", ">=": "ge", "==": "eq", "!=": "ne", "<": "lt", ">": "gt"}
_CONDITION = re.compile(r"\s*(\w+)\s*(?:\.(lt|le|eq|ne|ge|gt)\.|(?<=\s)(lt|le|eq|ne|ge|gt)(?=\s)|(<=|>=|==|!=|<|>))\s*(\S.*?)\s*", re.S)
_QUANTITY = re.compile(r"\s*([^\[\]]*?)\s*\[([^\[\]]*)\]\s*")


class FormulaError(ValueError):
    """Text that is no condition, quantity or formula."""


def condition(text: str) -> tuple[str, str, str]:
    """``v < 3``, ``v lt 3`` or ``v .lt. 3`` as name, operator, right side."""
    found = _CONDITION.fullmatch(text)
    if not found:
        raise FormulaError(f"can't read the condition {text!r}")
    name, dotted, word, sign, right = found.groups()
    return name, dotted or word or SIGNS[sign], right


def quantity(text: str) -> tuple[float, str]:
    """``1 [mm/day]`` as number and unit; both are needed."""
    found = _QUANTITY.fullmatch(text)
    if not found or not found[2].strip():
        raise FormulaError(f"expected a number and a unit in brackets, not {text!r}")
    try:
        return float(found[1]), found[2].strip()
    except ValueError:
        raise FormulaError(f"{found[1]!r} in {text!r} is no number") from None


def formula(text: str, units: Mapping[str, str] | None = None) -> tuple[str, Column, Unit | None, set[str]]:
    """``a = b + c`` as the new name, its Column, its unit and the names read.

    With ``units`` of the columns, terms of a sum are brought to the unit of
    the first one and other units follow; without, numbers are taken as they
    are and the unit is None.  Division by zero is missing.
    """
    name, equals, right = text.partition("=")
    if not equals or not name.strip().isidentifier():
        raise FormulaError(f"expected 'name = formula', not {text!r}")
    try:
        tree = ast.parse(right.strip(), mode="eval").body
    except SyntaxError:
        raise FormulaError(f"can't read the formula {right.strip()!r}") from None
    read = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)}
    column, unit = _built(tree, units)
    return name.strip(), column, unit, read


def _built(node: ast.AST, units: Mapping[str, str] | None) -> tuple[Column, Unit | None]:
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return F.lit(float(node.value)), parse("1") if units is not None else None
    if isinstance(node, ast.Name):
        return F.col(f"`{node.id}`"), parse(units[node.id]) if units is not None else None
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
        value, unit = _built(node.operand, units)
        return (-value if isinstance(node.op, ast.USub) else value), unit
    if isinstance(node, ast.BinOp):
        return _combined(node, units)
    raise FormulaError(f"{ast.unparse(node)!r} is not allowed in a formula")


def _combined(node: ast.BinOp, units: Mapping[str, str] | None) -> tuple[Column, Unit | None]:
    (a, ua), op = _built(node.left, units), node.op
    if isinstance(op, ast.Pow):
        power = node.right.value if isinstance(node.right, ast.Constant) else None
        if not isinstance(power, int) or isinstance(power, bool):
            raise FormulaError("powers have to be whole numbers")
        return F.pow(a, F.lit(power)), ua**power if ua else None
    b, ub = _built(node.right, units)
    if isinstance(op, (ast.Add, ast.Sub)):
        if ua and ub:
            if ua.powers != ub.powers:
                raise UnitError(f"can't add the units of {ast.unparse(node)!r}")
            b = b * F.lit(ub.factor / ua.factor)
        return (a + b if isinstance(op, ast.Add) else a - b), ua
    if isinstance(op, ast.Mult):
        return a * b, ua * ub if ua and ub else None
    if isinstance(op, ast.Div):
        return F.try_divide(a, b), ua * ub**-1 if ua and ub else None
    raise FormulaError(f"{ast.unparse(node)!r} is not allowed in a formula")
