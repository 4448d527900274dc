"""Conditions evaluated row by row in Python, to hold the compiled ones against."""

import math

from papyra.plans import tree as t


class Problem(Exception):
    pass


def value(e, row):
    if isinstance(e, t.Lit):
        return e.value
    if isinstance(e, t.Field):
        return row.get(e.path)
    if isinstance(e, t.Unary) and e.op == "-":
        v = value(e.value, row)
        if v is None:
            raise Problem
        return fits(-v)
    if isinstance(e, t.Call):
        if e.name == "COALESCE":
            for a in e.args:
                if (v := value(a, row)) is not None:
                    return v
            return None
        v = value(e.args[0], row)
        if v is None:
            raise Problem
        return {"ABS": abs, "UPPER": lambda s: s.upper(), "LENGTH": lambda s: len(s.encode())}[e.name](v)
    a, b = value(e.left, row), value(e.right, row)
    if a is None or b is None:
        raise Problem
    real = isinstance(a, float) or isinstance(b, float)
    if e.op in "/%" and not real:
        if b == 0:
            raise Problem
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return fits(q) if e.op == "/" else a - q * b
    if e.op == "/" and b == 0:
        return math.nan if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1, b)
    if e.op == "%" and real:
        return math.fmod(a, b) if b else math.nan
    return fits({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[e.op]())


def fits(v):
    if isinstance(v, int) and not -(1 << 63) <= v < 1 << 63:
        raise Problem
    return v


def order(a, b):
    if a is None or b is None:
        return (a is not None) - (b is not None)
    return (a > b) - (a < b)


def holds(e, row):
    if isinstance(e, t.Binary) and e.op == "AND":
        return holds(e.left, row) and holds(e.right, row)
    if isinstance(e, t.Binary) and e.op == "OR":
        return holds(e.left, row) or holds(e.right, row)
    if isinstance(e, t.Unary) and e.op == "NOT":
        return not holds(e.value, row)
    if isinstance(e, t.IsNull):
        return (value(e.value, row) is None) != e.negated
    if isinstance(e, t.Field):
        return row.get(e.path) is not None
    if isinstance(e, t.In):
        v = value(e.value, row)
        return any(order(v, value(i, row)) == 0 for i in e.items)
    if isinstance(e, t.Between):
        v, low, high = value(e.value, row), value(e.low, row), value(e.high, row)
        return order(v, low) >= 0 and order(v, high) <= 0
    a, b = value(e.left, row), value(e.right, row)
    c = order(a, b)
    return {"=": c == 0, "!=": c != 0, "<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0}[e.op]


def kept(e, row):
    try:
        return holds(e, row)
    except Problem:
        return False
