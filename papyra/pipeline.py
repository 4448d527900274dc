"""Fluent builders: conditions, groups and pipelines without text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from .plans import compiler
from .plans import tree as t


def value(v: Any) -> t.Expr:
    return v if isinstance(v, t.Expr) else t.Lit(v)


def all_of(parts: list[t.Expr]) -> t.Expr:
    out = parts[0] if parts else t.Lit(True)
    for p in parts[1:]:
        out = t.Binary("AND", out, p)
    return out


class FieldTest:
    """One condition on a field; returns to its Where."""

    def __init__(self, where: Where, path: str):
        self._where, self._field, self._path = where, t.Field(path), path

    def _add(self, e: t.Expr) -> Where:
        return self._where.expr(e)

    def eq(self, v: Any) -> Where:
        return self._add(t.Binary("=", self._field, value(v)))

    def ne(self, v: Any) -> Where:
        return self._add(t.Binary("!=", self._field, value(v)))

    def gt(self, v: Any) -> Where:
        return self._add(t.Binary(">", self._field, value(v)))

    def gte(self, v: Any) -> Where:
        return self._add(t.Binary(">=", self._field, value(v)))

    def lt(self, v: Any) -> Where:
        return self._add(t.Binary("<", self._field, value(v)))

    def lte(self, v: Any) -> Where:
        return self._add(t.Binary("<=", self._field, value(v)))

    def in_values(self, *vs: Any) -> Where:
        return self._add(t.In(self._field, tuple(map(value, vs))))

    def between(self, low: Any, high: Any) -> Where:
        return self._add(t.Between(self._field, value(low), value(high)))

    def like(self, pattern: str) -> Where:
        return self._add(t.Like(self._field, pattern))

    def matches(self, pattern: str) -> Where:
        return self._add(t.Binary("~", self._field, t.Lit(pattern)))

    def exists(self, yes: bool = True) -> Where:
        return self._add(t.Exists(self._path) if yes else t.Unary("NOT", t.Exists(self._path)))

    def is_null(self) -> Where:
        return self._add(t.IsNull(self._field))

    def is_not_null(self) -> Where:
        return self._add(t.IsNull(self._field, True))


class Where:
    """Conditions that must all hold; none holds always."""

    def __init__(self) -> None:
        self._parts: list[t.Expr] = []

    def field(self, path: str) -> FieldTest:
        return FieldTest(self, path)

    def expr(self, e: t.Expr) -> Where:
        self._parts.append(e)
        return self

    def and_(self, other: Where) -> Where:
        return self.expr(other.build())

    def or_(self, other: Where) -> Where:
        self._parts = [t.Binary("OR", self.build(), other.build())]
        return self

    def not_(self, other: Where) -> Where:
        return self.expr(t.Unary("NOT", other.build()))

    def build(self) -> t.Expr:
        return all_of(self._parts)


class Pipeline:
    """Stages in order. Each method adds one and returns the pipeline."""

    def __init__(self) -> None:
        self.stages: list[t.Stage] = []

    def stage(self, s: t.Stage) -> Pipeline:
        self.stages.append(s)
        return self

    def match(self, where: Where | t.Expr) -> Pipeline:
        return self.stage(t.Match(where.build() if isinstance(where, Where) else where))

    def group(self, *keys: str, **accs: tuple[str, Any] | str) -> Pipeline:
        """group("a", total=("SUM", "x"), n="COUNT"); a value is a field's path or an expression."""
        out = []
        for name, a in accs.items():
            function, of = (a, None) if isinstance(a, str) else a
            out.append(t.Acc(name, function.upper(), t.Field(of) if isinstance(of, str) else of))
        return self.stage(t.Group(keys, tuple(out)))

    def sort(self, *keys: str) -> Pipeline:
        """Paths; a leading minus sorts descending."""
        return self.stage(t.Sort(tuple((k[1:], True) if k.startswith("-") else (k, False) for k in keys)))

    def limit(self, n: int) -> Pipeline:
        return self.stage(t.Limit(n))

    def skip(self, n: int) -> Pipeline:
        return self.stage(t.Skip(n))

    def count(self, name: str = "count") -> Pipeline:
        return self.stage(t.Count(name))

    def unwind(self, path: str, preserve: bool = False) -> Pipeline:
        return self.stage(t.Unwind(path, preserve))

    def lookup(self, source: str, local: str, foreign: str, name: str) -> Pipeline:
        return self.stage(t.Lookup(source, local, foreign, name))

    def project(self, *fields: str, **computed: t.Expr | str) -> Pipeline:
        """Fields to keep, with a leading minus to leave out, and name=expression or name="old name"."""
        items = [t.Item(f[1:], keep=False) if f.startswith("-") else t.Item(f) for f in fields]
        items += [t.Item(k, t.Field(v) if isinstance(v, str) else v) for k, v in computed.items()]
        return self.stage(t.Project(tuple(items)))

    def apply(self, df: DataFrame, source: compiler.Source | None = None, order: tuple[str, ...] = ()) -> DataFrame:
        return compiler.aggregate(df, self.stages, source, order)
