"""Python-style expressions over string columns, translated to Catalyst columns.

Only a white list of syntax is accepted; nothing is evaluated in Python. Columns hold strings, as tables
do: arithmetic reads them as numbers only through ``int``, ``float`` or against a numeric operand.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variable_names(columns: list[str]) -> dict[str, str]:
    """Names usable in expressions: headers that occur once, with spaces and dashes as underscores and none starting with a digit."""
    out = {}
    for c in columns:
        name = re.sub(r"[ -]", "_", c)
        name = f"_{name}" if name[:1].isdigit() else name
        if columns.count(c) == 1:
            out[name] = c
    return out


class _Value:
    """A translated subexpression and its kind: str, num or bool."""

    def __init__(self, col: Column, kind: str):
        self.col, self.kind = col, kind

    def number(self) -> Column:
        return self.col if self.kind == "num" else F.expr("1").cast("double") * self.col.cast("double") if self.kind == "bool" else self.col.try_cast("double")

    def text(self) -> Column:
        if self.kind == "bool":
            return F.when(self.col, "True").otherwise("False")
        return self.col.cast("string")

    def truth(self) -> Column:
        if self.kind == "bool":
            return self.col
        return F.coalesce(self.col != (F.lit("") if self.kind == "str" else F.lit(0)), F.lit(False))


_COMPARE = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
}
_ARITHMETIC = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide, ast.Mod: lambda a, b: F.pmod(a, b), ast.Pow: F.pow,
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)),
}
_METHODS = {"upper": F.upper, "lower": F.lower, "strip": F.trim, "lstrip": F.ltrim, "rstrip": F.rtrim}
_TESTS = {"startswith": F.startswith, "endswith": F.endswith}


class Translator:
    def __init__(self, columns: list[str]):
        self.columns, self.names = columns, variable_names(columns)

    def visit(self, node: ast.AST) -> _Value:
        handler = getattr(self, f"_{type(node).__name__.lower()}", None)
        if handler is None:
            raise ValueError(f"{type(node).__name__} is not allowed in an expression")
        return handler(node)

    def _expression(self, node):
        return self.visit(node.body)

    def _name(self, node):
        if node.id not in self.names:
            raise ValueError(f"unknown name {node.id!r}")
        return _Value(F.col(f"`{self.names[node.id]}`"), "str")

    def _constant(self, node):
        kind = {bool: "bool", int: "num", float: "num", str: "str"}.get(type(node.value))
        if kind is None:
            raise ValueError(f"constant {node.value!r} is not allowed")
        return _Value(F.lit(node.value), kind)

    def _boolop(self, node):
        parts = [self.visit(v).truth() for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if isinstance(node.op, ast.And) else (out | p)
        return _Value(out, "bool")

    def _unaryop(self, node):
        v = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return _Value(~v.truth(), "bool")
        return _Value(-v.number() if isinstance(node.op, ast.USub) else v.number(), "num")

    def _binop(self, node):
        a, b = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.Add) and a.kind == b.kind == "str":
            return _Value(F.concat(a.col, b.col), "str")
        if type(node.op) not in _ARITHMETIC:
            raise ValueError(f"operator {type(node.op).__name__} is not allowed")
        return _Value(_ARITHMETIC[type(node.op)](a.number(), b.number()), "num")

    def _compare(self, node):
        out, left = None, self.visit(node.left)
        for op, right_node in zip(node.ops, node.comparators):
            if isinstance(op, (ast.In, ast.NotIn)):
                if isinstance(right_node, (ast.List, ast.Tuple, ast.Set)):
                    test = left.text().isin([ast.literal_eval(e) for e in right_node.elts])
                else:
                    test = F.contains(self.visit(right_node).text(), left.text())
                test, right = (~test if isinstance(op, ast.NotIn) else test), left
            else:
                right = self.visit(right_node)
                numeric = "num" in (left.kind, right.kind)
                a, b = (left.number(), right.number()) if numeric else (left.text(), right.text())
                test = F.coalesce(_COMPARE[type(op)](a, b), F.lit(isinstance(op, ast.NotEq)))
            out, left = test if out is None else out & test, right
        return _Value(out, "bool")

    def _ifexp(self, node):
        a, b = self.visit(node.body), self.visit(node.orelse)
        kind = a.kind if a.kind == b.kind else "str"
        pick = (lambda v: v.text()) if kind == "str" else (lambda v: v.col)
        return _Value(F.when(self.visit(node.test).truth(), pick(a)).otherwise(pick(b)), kind)

    def _subscript(self, node):
        if isinstance(node.value, ast.Name) and node.value.id == "fields":
            return _Value(F.col(f"`{self.columns[ast.literal_eval(node.slice)]}`"), "str")
        v = self.visit(node.value)
        if isinstance(node.slice, ast.Slice):
            if node.slice.step is not None:
                raise ValueError("a slice with a step is not allowed")
            low = ast.literal_eval(node.slice.lower) if node.slice.lower else 0
            high = ast.literal_eval(node.slice.upper) if node.slice.upper else None
            if low < 0 or (high is not None and high < 0):
                raise ValueError("a negative slice is not allowed")
            return _Value(F.substring(v.text(), low + 1, (high if high is not None else 1 << 30) - low), "str")
        at = ast.literal_eval(node.slice)
        return _Value(F.substring(v.text(), at + 1 if at >= 0 else at, 1), "str")

    def _call(self, node):
        if isinstance(node.func, ast.Attribute):
            v, args = self.visit(node.func.value), [self.visit(a) for a in node.args]
            name = node.func.attr
            if name in _METHODS and not args:
                return _Value(_METHODS[name](v.text()), "str")
            if name in _TESTS and len(args) == 1:
                return _Value(_TESTS[name](v.text(), args[0].text()), "bool")
            if name == "replace" and len(args) == 2:
                return _Value(F.replace(v.text(), args[0].text(), args[1].text()), "str")
            raise ValueError(f"method {name!r} is not allowed")
        name, args = getattr(node.func, "id", ""), [self.visit(a) for a in node.args]
        if name == "int":
            return _Value(args[0].number().try_cast("bigint"), "num")
        if name == "float":
            return _Value(args[0].number(), "num")
        if name == "str":
            return _Value(args[0].text(), "str")
        if name == "bool":
            return _Value(args[0].truth(), "bool")
        if name == "len":
            return _Value(F.length(args[0].text()), "num")
        if name == "abs":
            return _Value(F.abs(args[0].number()), "num")
        if name == "round":
            return _Value(F.round(args[0].number(), ast.literal_eval(node.args[1]) if len(args) > 1 else 0), "num")
        if name in ("min", "max") and len(args) > 1:
            return _Value((F.least if name == "min" else F.greatest)(*[a.number() for a in args]), "num")
        raise ValueError(f"function {name!r} is not allowed")


def _translate(df: DataFrame, expression: str) -> _Value:
    return Translator(df.columns).visit(ast.parse(expression.strip(), mode="eval"))


def column(df: DataFrame, expression: str) -> Column:
    """The expression as a string column; what has no value is empty."""
    return F.coalesce(_translate(df, expression).text(), F.lit(""))


def condition(df: DataFrame, expression: str) -> Column:
    """The expression's truth: empty texts and zero are false."""
    return _translate(df, expression).truth()
