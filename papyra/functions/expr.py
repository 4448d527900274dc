"""Expression trees to columns.

Every value compiles to a pair: the column, and the condition under which it is an error. An error is not a
null: in a filter it drops the row, whatever NOT stands before it. Where no error can occur the condition is
None, and the filter is the plain predicate, which Spark pushes into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from ..plans import tree as t
from . import compare

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_COMPARE = {"<": compare.lt, "<=": compare.le, ">": compare.gt, ">=": compare.ge}


@dataclass(frozen=True)
class Value:
    col: Column
    kind: T.DataType
    err: Column | None = None
    nullable: bool = True
    literal: bool = False


def quoted(*parts: str) -> Column:
    return F.col(".".join(f"`{p.replace('`', '``')}`" for p in parts))


def either(*errors: Column | None) -> Column | None:
    real = [e for e in errors if e is not None]
    return reduce(lambda a, b: a | b, real) if real else None


def family(kind: T.DataType) -> str:
    if isinstance(kind, (*_INTS, *_FLOATS, T.DecimalType)):
        return "number"
    for name, kinds in (("string", (T.StringType, T.VarcharType, T.CharType)), ("boolean", (T.BooleanType,)), ("time", _TIMES), ("null", (T.NullType,)), ("array", (T.ArrayType,)), ("document", (T.StructType,)), ("binary", (T.BinaryType,))):
        if isinstance(kind, kinds):
            return name
    return kind.simpleString()


class Compiler:
    """Compiles expressions over the columns of a DataFrame."""

    def __init__(self, df: DataFrame):
        self.df, self.schema = df, df.schema

    # fields

    def resolve(self, path: str) -> tuple[Column, T.DataType] | None:
        """Column and type of a dotted path; None where the schema has no such field."""
        names = {f.name: f for f in self.schema.fields}
        parts = path.split(".")
        for n in range(len(parts), 0, -1):  # a column whose own name has dots comes first
            if (head := ".".join(parts[:n])) in names:
                break
        else:
            return None
        col, kind = quoted(head), names[head].dataType
        for part in parts[n:]:
            if isinstance(kind, T.StructType) and part in kind.names:
                col, kind = col.getField(part), kind[part].dataType
            elif isinstance(kind, T.ArrayType) and part.isdigit():
                col, kind = F.get(col, F.lit(int(part))), kind.elementType
            elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
                col, kind = F.try_element_at(col, F.lit(part)), kind.valueType
            elif isinstance(kind, T.VariantType):
                rest = parts[parts.index(part, n) :]
                steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in rest)
                return F.try_variant_get(col, f"${steps}", "string"), T.StringType()
            else:
                return None
        return col, kind

    def field(self, path: str) -> Value:
        found = self.resolve(path)
        return Value(F.lit(None), T.NullType()) if found is None else Value(*found)

    # values

    def value(self, e: t.Expr) -> Value:
        method = getattr(self, f"_{type(e).__name__.lower()}", None)
        if method is None:
            raise CompileError(f"{type(e).__name__} is a condition, not a value")
        return method(e)

    def _lit(self, e: t.Lit) -> Value:
        v = e.value
        kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType()}
        if v is None:
            return Value(F.lit(None), T.NullType(), None, True, True)
        if isinstance(v, list):
            return self._arrayof(t.ArrayOf(tuple(map(t.Lit, v))))
        if isinstance(v, dict):
            return self._docof(t.DocOf(tuple((k, t.Lit(x)) for k, x in v.items())))
        if isinstance(v, Decimal):
            return Value(F.lit(v), T.DecimalType(38, 18), None, False, True)
        if type(v) in kinds:
            col = F.lit(v).cast("long") if type(v) is int and abs(v) < 1 << 31 else F.lit(v)
            return Value(F.lit(v) if type(v) is not int else col, kinds[type(v)], None, False, True)
        col = F.lit(v)
        return Value(col, self.df.select(col).schema[0].dataType, None, False, True)

    def _field(self, e: t.Field) -> Value:
        return self.field(e.path)

    def _arrayof(self, e: t.ArrayOf) -> Value:
        items = [self.value(x) for x in e.items]
        kind = next((x.kind for x in items if family(x.kind) != "null"), T.NullType())
        if any(family(x.kind) not in ("null", family(kind)) for x in items):
            raise CompileError("an array's items must be of one type")
        if family(kind) == "number" and any(isinstance(x.kind, _FLOATS) for x in items):
            kind = T.DoubleType()
        col = F.array(*(x.col.cast(kind) if family(kind) != "null" else x.col for x in items))
        return Value(col, T.ArrayType(kind), either(*(x.err for x in items)), False)

    def _docof(self, e: t.DocOf) -> Value:
        items = [(k, self.value(x)) for k, x in e.items]
        col = F.struct(*(x.col.alias(k) for k, x in items))
        return Value(col, T.StructType([T.StructField(k, x.kind) for k, x in items]), either(*(x.err for _, x in items)), False)

    def _unary(self, e: t.Unary) -> Value:
        if e.op == "NOT":
            x = self.value(e.value)
            if family(x.kind) != "boolean":
                raise CompileError("NOT needs a boolean")
            return Value(~x.col, x.kind, either(x.err, x.col.isNull()))
        x = self.value(e.value)
        if family(x.kind) == "null":
            return Value(F.lit(None).cast("long"), T.LongType(), F.lit(True))
        if family(x.kind) != "number":
            raise CompileError("unary minus needs a number")
        col = -x.col if isinstance(x.kind, _FLOATS) else F.try_subtract(F.lit(0).cast(x.kind), x.col)
        return Value(col, x.kind, either(x.err, col.isNull()))

    def _binary(self, e: t.Binary) -> Value:
        if e.op not in "+-*/%":
            raise CompileError(f"{e.op} is a condition, not a value")
        a, b = self.value(e.left), self.value(e.right)
        if "null" in (family(a.kind), family(b.kind)):
            return Value(F.lit(None).cast("long"), T.LongType(), F.lit(True))
        if e.op == "+" and family(a.kind) == family(b.kind) == "string":
            col = F.concat(a.col, b.col)
            return Value(col, T.StringType(), either(a.err, b.err, col.isNull()))
        if {family(a.kind), family(b.kind)} != {"number"}:
            raise CompileError(f"{e.op} needs numbers")
        null = either(a.err, b.err, a.col.isNull() if a.nullable else None, b.col.isNull() if b.nullable else None)
        if isinstance(a.kind, _FLOATS) or isinstance(b.kind, _FLOATS):
            x, y = a.col.cast("double"), b.col.cast("double")
            col = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: _float_divide(x, y), "%": lambda: F.when(y != 0, F.try_mod(x, y)).otherwise(F.lit(float("nan")))}[e.op]()
            return Value(col, T.DoubleType(), null)
        if isinstance(a.kind, T.DecimalType) or isinstance(b.kind, T.DecimalType):
            wide = [v.col if isinstance(v.kind, T.DecimalType) else v.col.cast("decimal(20,0)") for v in (a, b)]
            col = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide, "%": F.try_mod}[e.op](*wide)
            return Value(col, self.df.select(col).schema[0].dataType, either(a.err, b.err, col.isNull()))
        x, y = a.col.cast("long"), b.col.cast("long")
        if e.op in "/%":
            safe = F.when(y != 0, y)
            # the one quotient that does not fit is an error like any overflow
            fits = ~((x == F.lit(-(1 << 63))) & (y == -1))
            col = F.when(fits, F.call_function("div", x, safe)) if e.op == "/" else F.when(y == -1, F.when(x.isNotNull(), F.lit(0).cast("long"))).otherwise(F.try_mod(x, safe))
        else:
            col = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[e.op](x, y)
        return Value(col, T.LongType(), either(a.err, b.err, col.isNull()))

    def _call(self, e: t.Call) -> Value:
        name = {"TOUPPER": "UPPER", "TOLOWER": "LOWER", "LEN": "LENGTH"}.get(e.name.upper(), e.name.upper())
        args = [self.value(x) for x in e.args]
        if name == "COALESCE":
            if not args:
                raise CompileError("COALESCE needs values")
            return _coalesce(args)
        if name not in ("UPPER", "LOWER", "LENGTH", "ABS", "FLOOR", "CEIL", "ROUND"):
            raise CompileError(f"unknown function {e.name}")
        if len(args) != 1:
            raise CompileError(f"{name} takes one value")
        x = args[0]
        if family(x.kind) == "null":
            return Value(F.lit(None).cast("long"), T.LongType(), F.lit(True))
        null = either(x.err, x.col.isNull() if x.nullable else None)
        if name in ("UPPER", "LOWER"):
            if family(x.kind) != "string":
                raise CompileError(f"{name} needs a string")
            return Value((F.upper if name == "UPPER" else F.lower)(x.col), T.StringType(), null)
        if name == "LENGTH":
            if family(x.kind) not in ("string", "array"):
                raise CompileError("LENGTH needs a string or an array")
            return Value((F.octet_length(x.col) if family(x.kind) == "string" else F.size(x.col)).cast("long"), T.LongType(), null)
        if family(x.kind) != "number":
            raise CompileError(f"{name} needs a number")
        if isinstance(x.kind, _INTS):
            if name != "ABS":
                return Value(x.col, x.kind, null)
            least = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(x.kind)]
            col = F.when(x.col != F.lit(-(1 << least)), F.abs(x.col))
            return Value(col, x.kind, either(x.err, col.isNull()))
        if name == "ABS":
            return Value(F.abs(x.col), x.kind, null)
        if isinstance(x.kind, T.DecimalType):
            col = {"FLOOR": F.floor, "CEIL": F.ceil, "ROUND": lambda c: F.round(c, 0)}[name](x.col)
            return Value(col, self.df.select(col).schema[0].dataType, null)
        # beyond 2 ** 53 a double has no fraction, and floor's long would overflow
        own = x.col.cast("double")
        col = {"FLOOR": F.floor, "CEIL": F.ceil, "ROUND": lambda c: F.round(c, 0)}[name](own).cast("double")
        return Value(F.when(F.abs(own) < float(1 << 53), col).otherwise(own), T.DoubleType(), null)

    # conditions

    def condition(self, e: t.Expr) -> tuple[Column, Column | None]:
        """A column that is true or false, and when it is an error."""
        if isinstance(e, t.Binary) and e.op in ("AND", "OR"):
            a, a_err = self.condition(e.left)
            b, b_err = self.condition(e.right)
            col = a & b if e.op == "AND" else a | b
            if b_err is not None:
                b_err = (a if e.op == "AND" else ~a) & b_err
            return col, either(a_err, b_err)
        if isinstance(e, t.Unary) and e.op == "NOT":
            col, err = self.condition(e.value)
            return ~col, err
        if isinstance(e, t.Binary) and e.op in ("=", "!=", "~", *_COMPARE):
            a, b = self.value(e.left), self.value(e.right)
            return self._compare(e.op, a, b), either(a.err, b.err)
        if isinstance(e, t.In):
            x, items = self.value(e.value), [self.value(i) for i in e.items]
            err = x.err
            for k, i in enumerate(items):  # items behind a hit are not looked at
                if i.err is not None:
                    err = either(err, i.err if k == 0 else ~self._in(x, items[:k]) & i.err)
            return self._in(x, items), err
        if isinstance(e, t.Between):
            x, low, high = self.value(e.value), self.value(e.low), self.value(e.high)
            return self._compare(">=", x, low) & self._compare("<=", x, high), either(x.err, low.err, high.err)
        if isinstance(e, t.Like):
            x = self.value(e.value)
            if family(x.kind) != "string":
                return F.lit(False), x.err
            return x.col.isNotNull() & x.col.like(e.pattern.replace("\\", "\\\\")), x.err
        if isinstance(e, t.IsNull):
            x = self.value(e.value)
            return (x.col.isNotNull() if e.negated else x.col.isNull()), x.err
        if isinstance(e, t.Exists):
            return self.field(e.path).col.isNotNull(), None
        if isinstance(e, t.Field):
            return self.field(e.path).col.isNotNull(), None
        if isinstance(e, t.Lit):
            return F.lit(e.value if isinstance(e.value, bool) else True), None
        if isinstance(e, t.ArrayOf | t.DocOf):
            return F.lit(True), None
        if isinstance(e, t.Call | t.Unary):
            self.value(e)  # still has to make sense
            return F.lit(False), F.lit(True)
        raise CompileError(f"{getattr(e, 'op', type(e).__name__)} is not a condition")

    def _compare(self, op: str, a: Value, b: Value) -> Column:
        fa, fb = family(a.kind), family(b.kind)
        if op == "~":
            if fb != "string":
                raise CompileError("~ needs a pattern")
            return a.col.isNotNull() & b.col.isNotNull() & F.rlike(a.col, b.col) if fa == "string" else F.lit(False)
        both = fa == fb or "null" in (fa, fb)
        if op in ("=", "!="):
            same = compare.eq(a.col, b.col) if both else a.col.isNull() & b.col.isNull()
            return same if op == "=" else ~same
        x, y = a.col, b.col
        if fa == "null" and fb == "null":
            return F.lit(op in ("<=", ">="))
        if not both or fa == "document":  # only the nulls of incomparable types have an order
            less, more = x.isNull() & y.isNotNull(), x.isNotNull() & y.isNull()
            equal = x.isNull() & y.isNull()
            return {"<": less, "<=": less | equal, ">": more, ">=": more | equal}[op]
        if fa == "null":
            x = x.cast(b.kind)
        if fb == "null":
            y = y.cast(a.kind)
        return _COMPARE[op](x, y, a.nullable, b.nullable)

    def _in(self, x: Value, items: list[Value]) -> Column:
        null = any(family(i.kind) == "null" for i in items)
        plain = [i for i in items if i.literal and family(i.kind) == family(x.kind) != "null"]
        tests = [self._compare("=", x, i) for i in items if not i.literal]
        if plain:
            tests.append(x.col.isNotNull() & x.col.isin(*(i.col for i in plain)) if x.nullable else x.col.isin(*(i.col for i in plain)))
        if null:
            tests.append(x.col.isNull())
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)

    def where(self, e: t.Expr) -> Column:
        """A filter: true, or not; NULL where the condition is an error."""
        col, err = self.condition(e)
        return col if err is None else F.when(~err, col)

    def computed(self, e: t.Expr) -> Column:
        """A value for a projection: NULL where it is an error. Conditions give booleans."""
        if isinstance(e, t.In | t.Between | t.Like | t.IsNull | t.Exists) or isinstance(e, t.Binary) and e.op not in "+-*/%":
            return self.where(e)
        x = self.value(e)
        return x.col if x.err is None else F.when(~x.err, x.col)


def _float_divide(x: Column, y: Column) -> Column:
    inf = float("inf")
    # a negative zero divides to the other infinity; 1 / y tells the zeros apart only by their text
    sign = F.when(y.cast("string") == "-0.0", -1.0).otherwise(1.0)
    by_zero = F.when(F.isnan(x) | (x == 0), float("nan")).when(x > 0, sign * F.lit(inf)).otherwise(sign * F.lit(-inf))
    return F.when(y != 0, F.try_divide(x, y)).when(y.isNotNull(), by_zero)


def _coalesce(args: list[Value]) -> Value:
    kind = next((a.kind for a in args if family(a.kind) != "null"), T.NullType())
    if any(family(a.kind) not in ("null", family(kind)) for a in args):
        raise CompileError("COALESCE needs values of one type")
    if family(kind) == "number" and len({type(a.kind) for a in args if family(a.kind) != "null"}) > 1:
        kind = T.DoubleType() if any(isinstance(a.kind, _FLOATS) for a in args) else T.LongType() if all(isinstance(a.kind, (*_INTS, T.NullType)) for a in args) else kind
    err, before = None, None  # an argument's error counts if all before it were null
    for a in args:
        if a.err is not None:
            err = either(err, a.err if before is None else before & a.err)
        null = a.col.isNull() if a.err is None else a.col.isNull() & ~a.err
        before = null if before is None else before & null
    cols = [a.col if family(a.kind) == "null" or family(kind) == "null" else a.col.cast(kind) for a in args]
    return Value(F.coalesce(*cols), kind, err, all(a.nullable for a in args))
