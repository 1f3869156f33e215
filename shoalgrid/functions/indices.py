"""Spectral indices, logarithmic features and band mathematics."""

from __future__ import annotations

import ast
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

def _over(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def _root(x: Column) -> Column:
    return F.sqrt(F.when(x >= 0, x))


def _log(x: Column, base: float | None = None) -> Column:
    x = F.when(x > 0, x)
    return F.log(x) if base is None else F.log(base, x)


#: What a band formula may use: operators, and functions with the number of their arguments.
OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: _over, ast.Pow: F.pow}
COMPARISONS = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
CONSTANTS = {"pi": math.pi, "e": math.e}
FUNCTIONS = {
    "log": (_log, 1), "log10": (lambda x: _log(x, 10.0), 1), "log2": (lambda x: _log(x, 2.0), 1), "exp": (F.exp, 1), "sqrt": (_root, 1), "abs": (F.abs, 1),
    "sin": (F.sin, 1), "cos": (F.cos, 1), "tan": (F.tan, 1), "asin": (F.asin, 1), "acos": (F.acos, 1), "atan": (F.atan, 1),
    "arcsin": (F.asin, 1), "arccos": (F.acos, 1), "arctan": (F.atan, 1), "power": (F.pow, 2), "greatest": (F.greatest, 2), "least": (F.least, 2),
    "maximum": (F.greatest, 2), "minimum": (F.least, 2), "where": (lambda c, a, b: F.when(c, a).otherwise(b), 3), "clip": (lambda x, a, b: F.least(F.greatest(x, a), b), 3),
}


def normalized_difference(a: Column, b: Column, least: float = 1e-6) -> Column:
    """(a - b) / (a + b), NULL where the sum is next to nothing."""
    return F.when(F.abs(a + b) > least, (a - b) / (a + b))


def guarded_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) with a sum of 0 taken as 1e-6."""
    total = a + b
    return (a - b) / F.when(total == 0, 1e-6).otherwise(total)


def ndvi(nir: Column, red: Column) -> Column:
    return guarded_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return guarded_difference(green, nir)


def mndwi(green: Column, swir: Column) -> Column:
    return guarded_difference(green, swir)


def nwi(blue: Column, green: Column, red: Column, nir: Column, swir: Column) -> Column:
    visible, infrared = (blue + green + red) / 3.0, (nir + swir) / 2.0
    total = visible + infrared
    return (visible - infrared) / F.when(total == 0, 1e-6).otherwise(total)


def ndti(red: Column, green: Column) -> Column:
    return (red - green) / (red + green + 1e-6)


def log_band(x: Column) -> Column:
    """ln(max(1000 x, 1e-4)); NULL reflectance gives 0."""
    return F.coalesce(F.log(F.greatest(x * 1000.0, F.lit(1e-4))), F.lit(0.0))


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def log_ratio(a: Column, b: Column) -> Column:
    """Ratio of two logarithmic bands, 0 where it is not finite."""
    a, b = log_band(a), log_band(b)
    return F.when(b != 0, a / b).otherwise(0.0)


def band_math(formula: str, columns: dict[str, str]) -> Column:
    """A user's formula over named bands; what is not finite becomes 0.

    Python's parser reads it, and each node becomes a column: numbers, names in ``columns``, pi and e, + - * / **, unary signs,
    comparisons, ``where(condition, a, b)``, ``clip(x, low, high)`` and the functions in FUNCTIONS. Anything else is an error.
    Dividing by zero gives NULL, so 0 in the end.
    """

    def of(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in columns:
            return F.col(f"`{columns[node.id]}`").cast("double")
        if isinstance(node, ast.Name) and node.id in CONSTANTS:
            return F.lit(CONSTANTS[node.id])
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -of(node.operand) if isinstance(node.op, ast.USub) else of(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
            return OPERATORS[type(node.op)](of(node.left), of(node.right))
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in COMPARISONS:
            return COMPARISONS[type(node.ops[0])](of(node.left), of(node.comparators[0]))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords:
            use, n = FUNCTIONS[node.func.id]
            if len(node.args) == n:
                return use(*map(of, node.args))
        raise ValueError(f"not allowed in a band formula: {ast.unparse(node)}")

    try:
        tree = ast.parse(formula.strip(), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"no band formula: {formula}") from e
    return finite_or_zero(of(tree.body).cast("double"))
