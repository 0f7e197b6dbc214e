"""Conditions of rules, which files give in Python's notation, as columns over the rows of a context.

A condition is read by Python's own parser and turned into a column node by node, so that it means what Python would make of it:
comparisons may be chained, `and` and `or` stop at the first operand that decides, None equals None only, values of different kinds
are unequal and have no order, and truth is asked of numbers and texts, too.  Where Python would raise - an unknown name, an order
with None, a division by zero - or where a condition holds a call or anything else that is no plain expression, such as `and` or `or`
as an operand of a comparison, the column is NULL."""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, StructType


@dataclass
class Value:
    """kind: number, text, truth (a boolean), none, or error.  Where `raised` the column is NULL for an error, else NULL is None."""

    column: Column
    kind: str
    raised: bool = False


ERROR = "error"


def failed() -> Value:
    return Value(F.lit(None).cast("boolean"), ERROR, True)


def condition(text: str, schema: StructType) -> Column:
    """The truth of a condition, or NULL where it fails."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError:
        return failed().column
    kinds = {f.name: "truth" if isinstance(f.dataType, BooleanType) else "number" if isinstance(f.dataType, NumericType) else "text" if isinstance(f.dataType, StringType) else ERROR for f in schema}
    return truth_of(tree, kinds)


def truth_of(node: ast.expr, kinds: dict[str, str]) -> Column:
    """What `if` makes of a condition's part; NULL where that fails."""
    none = F.lit(None).cast("boolean")
    match node:
        case ast.BoolOp(op=op, values=parts):
            out = truth_of(parts[-1], kinds)
            for x in reversed(parts[:-1]):
                first = truth_of(x, kinds)
                stop = first if isinstance(op, ast.Or) else ~first
                # What stands behind is not looked at where the first decides, and a failure ends it.
                out = F.when(first.isNull(), none).when(stop, F.lit(isinstance(op, ast.Or))).otherwise(out)
            return out
        case ast.IfExp(test=t, body=a, orelse=b):
            yes = truth_of(t, kinds)
            return F.when(yes.isNull(), none).when(yes, truth_of(a, kinds)).otherwise(truth_of(b, kinds))
    return truth(made(node, kinds))


def truth(v: Value) -> Column:
    """What `if` makes of a value."""
    if v.kind == ERROR:
        return failed().column
    if v.kind == "none":
        return F.lit(False)
    yes = v.column if v.kind == "truth" else v.column != (F.lit(0) if v.kind == "number" else F.lit(""))
    return yes if v.raised else F.coalesce(yes, F.lit(False))


def made(node: ast.expr, kinds: dict[str, str]) -> Value:
    match node:
        case ast.Constant(value=None):
            return Value(F.lit(None), "none")
        case ast.Constant(value=bool() as x):
            return Value(F.lit(x), "truth")
        case ast.Constant(value=(int() | float()) as x):
            return Value(F.lit(x), "number")
        case ast.Constant(value=str() as x):
            return Value(F.lit(x), "text")
        case ast.Name(id=name) if kinds.get(name, ERROR) != ERROR:
            return Value(F.col(f"`{name}`"), kinds[name])
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return Value(~truth_of(x, kinds), "truth", True)
        case ast.UnaryOp(op=(ast.USub() | ast.UAdd()) as op, operand=x):
            v = number(made(x, kinds))
            return v if v.kind == ERROR or isinstance(op, ast.UAdd) else Value(-v.column, "number", True)
        case ast.BinOp(left=a, op=op, right=b):
            x, y = made(a, kinds), made(b, kinds)
            if x.kind == y.kind == "text" and isinstance(op, ast.Add):
                return Value(F.concat(x.column, y.column), "text", True)
            return computed(number(x), op, number(y))
        case ast.Compare(left=a, ops=ops, comparators=others):
            operands, out = [a, *others], None
            for i in range(len(ops) - 1, -1, -1):
                one = compared(operands[i], ops[i], operands[i + 1], kinds)
                out = one if out is None else F.when(one.isNull(), F.lit(None).cast("boolean")).when(~one, F.lit(False)).otherwise(out)
            return Value(out, "truth", True)
    return failed()


def number(v: Value) -> Value:
    """Truths count 0 and 1; texts and None don't count."""
    if v.kind == "number":
        return v
    return Value(v.column.cast("int"), "number", v.raised) if v.kind == "truth" else failed()


def computed(a: Value, op: ast.operator, b: Value) -> Value:
    if ERROR in (a.kind, b.kind):
        return failed()
    x, y = a.column.cast("double"), b.column.cast("double")
    floor = F.floor(F.try_divide(x, y)).cast("double")
    by = {ast.Add: lambda: x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.Div: lambda: F.try_divide(x, y), ast.FloorDiv: lambda: floor, ast.Mod: lambda: x - y * floor, ast.Pow: lambda: F.pow(x, y)}
    return Value(by[type(op)](), "number", True) if type(op) in by else failed()


def equal(a: Value, b: Value) -> Column:
    """NULL only where an operand has failed."""
    if ERROR in (a.kind, b.kind):
        return failed().column
    if "none" in (a.kind, b.kind):
        other = b if a.kind == "none" else a
        same = F.lit(True) if other.kind == "none" else F.lit(False) if other.raised else other.column.isNull()
    elif "text" in (a.kind, b.kind) and a.kind != b.kind:
        both = [F.lit(False) if v.raised else v.column.isNull() for v in (a, b)]
        same = both[0] & both[1]
    else:
        x, y = (a.column, b.column) if a.kind == b.kind else (number(a).column, number(b).column)
        same = x.eqNullSafe(y)
    for v in (a, b):
        if v.raised:
            same = F.when(v.column.isNotNull(), same)
    return same


def compared(left: ast.expr, op: ast.cmpop, right: ast.expr, kinds: dict[str, str]) -> Column:
    a = made(left, kinds)
    if isinstance(op, (ast.In, ast.NotIn)):
        if isinstance(right, (ast.Tuple, ast.List, ast.Set)):
            found = F.lit(False)
            for x in reversed(right.elts):
                one = equal(a, made(x, kinds))
                found = F.when(one.isNull(), F.lit(None).cast("boolean")).when(one, F.lit(True)).otherwise(found)
            if not right.elts and a.raised:
                found = F.when(a.column.isNotNull(), found)
        else:
            b = made(right, kinds)
            found = b.column.contains(a.column) if a.kind == b.kind == "text" else failed().column
        return found if isinstance(op, ast.In) else ~found
    b = made(right, kinds)
    if isinstance(op, (ast.Is, ast.IsNot)):  # in conditions, asked of None and of truths
        same = equal(a, b) if "none" in (a.kind, b.kind) or a.kind == b.kind == "truth" else failed().column
        return same if isinstance(op, ast.Is) else ~same
    if isinstance(op, (ast.Eq, ast.NotEq)):
        return equal(a, b) if isinstance(op, ast.Eq) else ~equal(a, b)
    if a.kind == b.kind == "text":
        x, y = a.column, b.column
    else:
        a, b = number(a), number(b)
        if ERROR in (a.kind, b.kind):
            return failed().column
        x, y = a.column, b.column
    return {ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}[type(op)]
