"""Band-math expressions: text to Column, by a white list over Python's own parser. Nothing is evaluated."""

from __future__ import annotations

import ast
import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.expr import INF, NAN, divide


class BandMathError(ValueError):
    """The expression uses something outside the white list or a name that is no band."""


def _log(f):
    return lambda x: F.when(x > 0, f(x)).when(x == 0, F.lit(-INF)).when(x.isNotNull(), F.lit(NAN))


def _shifted_log(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(-INF)).when(x.isNotNull(), F.lit(NAN))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (x != INF) & (x != -INF)


#: numpy's names and arity of what an expression may call
CALLS = {
    "sqrt": (1, F.sqrt), "abs": (1, F.abs), "log": (1, _log(F.ln)), "log10": (1, _log(F.log10)), "log2": (1, _log(F.log2)),
    "log1p": (1, _shifted_log), "exp": (1, F.exp), "expm1": (1, F.expm1), "power": (2, F.pow),
    "sin": (1, F.sin), "cos": (1, F.cos), "tan": (1, F.tan), "arcsin": (1, F.asin), "arccos": (1, F.acos), "arctan": (1, F.atan), "arctan2": (2, F.atan2),
    "floor": (1, lambda x: F.floor(x).cast("double")), "ceil": (1, lambda x: F.ceil(x).cast("double")), "round": (1, lambda x: F.rint(x)),
    "sign": (1, F.signum), "square": (1, lambda x: x * x), "minimum": (2, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))),
    "maximum": (2, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))),
    "clip": (3, lambda x, lo, hi: F.when(x < lo, lo).when(x > hi, hi).otherwise(x)),
    "where": (3, lambda c, a, b: F.when(c, a).when(~c, b)), "isnan": (1, F.isnan), "isfinite": (1, _finite),
}
CONSTANTS = {"nan": NAN, "pi": math.pi, "e": math.e, "inf": INF}
_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


def _binary(op: ast.operator, a: Column, b: Column) -> Column:
    match op:
        case ast.Add():
            return a + b
        case ast.Sub():
            return a - b
        case ast.Mult():
            return a * b
        case ast.Div():
            return divide(a, b)
        case ast.FloorDiv():
            whole = F.floor(divide(a, b)).cast("double")
            return F.when(_finite(divide(a, b)), whole).otherwise(divide(a, b))
        case ast.Mod():
            return F.when(b == 0, F.lit(NAN)).otherwise(a - F.floor(F.try_divide(a, b)) * b)
        case ast.Pow():
            return F.pow(a, b)
        case ast.BitAnd():
            return a & b
        case ast.BitOr():
            return a | b
    raise BandMathError(f"operator {type(op).__name__} is not allowed")


def compile_expression(text: str, bands: Mapping[str, Column]) -> Column:
    """Column of an expression. Names are the bands and, in their order, b0, b1, ...; bands count as doubles."""
    names = {f"b{i}": c for i, c in enumerate(bands.values())} | dict(bands)

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=bool() | int() | float() as v):
                return F.lit(v if isinstance(v, bool) else float(v))
            case ast.Name(id=name) if name in names:
                return names[name].cast("double")
            case ast.Attribute(value=ast.Name(id="np"), attr=name) if name in CONSTANTS:
                return F.lit(CONSTANTS[name])
            case ast.Call(func=ast.Attribute(value=ast.Name(id="np"), attr=name), args=args, keywords=[]) if name in CALLS:
                arity, f = CALLS[name]
                if len(args) != arity:
                    raise BandMathError(f"np.{name} takes {arity} arguments")
                return f(*map(build, args))
            case ast.BinOp(left=a, op=op, right=b):
                return _binary(op, build(a), build(b))
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -build(a)
            case ast.UnaryOp(op=ast.UAdd(), operand=a):
                return build(a)
            case ast.UnaryOp(op=ast.Invert() | ast.Not(), operand=a):
                return ~build(a)
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
                return _COMPARE[type(op)](build(a), build(b))
            case ast.Name(id=name):
                raise BandMathError(f"unknown band {name}; there are {', '.join(bands)}")
        raise BandMathError(f"{ast.unparse(node)} is not allowed in an expression")

    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise BandMathError(f"not an expression: {text}") from e
    return build(tree.body)


def over_arrays(text: str, arrays: Mapping[str, Column]) -> Column:
    """The expression pixel by pixel over band arrays of one tile, without exploding them."""
    zipped = F.arrays_zip(*[c.alias(n) for n, c in arrays.items()])
    return F.transform(zipped, lambda s: compile_expression(text, {n: s[n] for n in arrays}))
