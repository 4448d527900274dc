"""Pipeline stages. Each takes and returns a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from ..functions.expr import Compiler, quoted
from ..plans import tree as t
from .accumulators import accumulate


def match(df: DataFrame, where: t.Expr) -> DataFrame:
    """Rows whose condition is true; an error drops the row."""
    return df.where(Compiler(df).where(where))


def project(df: DataFrame, items: tuple[t.Item, ...]) -> DataFrame:
    """Fields to keep (with _id, where there is one), to compute, or to leave out. Fields that do not exist are left out."""
    if not items:
        raise CompileError("PROJECT needs fields")
    gone = {i.name for i in items if not i.keep}
    if all(not i.keep for i in items):
        return df.select(*(_without(df, c, gone) for c in df.columns if c not in gone))
    c = Compiler(df)
    out: list[Column] = []
    if "_id" in df.columns and "_id" not in gone and all(i.name != "_id" for i in items):
        out.append(quoted("_id"))
    for i in items:
        if not i.keep:
            continue
        if i.value is not None:
            out.append(c.computed(i.value).alias(i.name))
        elif (found := c.resolve(i.name)) is not None:
            out.append(found[0].alias(i.name))
    if not out:
        raise CompileError("none of the projected fields exists")
    return df.select(*out)


def _without(df: DataFrame, name: str, gone: set[str]) -> Column:
    inner = [g[len(name) + 1 :] for g in gone if g.startswith(f"{name}.")]
    kind = df.schema[name].dataType
    inner = [p for p in inner if isinstance(kind, T.StructType) and p.split(".")[0] in kind.names]
    return quoted(name).dropFields(*(".".join(f"`{x}`" for x in p.split(".")) for p in inner)).alias(name) if inner else quoted(name)


def select(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return project(df, tuple(t.Item(f) for f in fields))


def sort(df: DataFrame, keys: tuple[tuple[str, bool], ...], ties: tuple[str, ...] = ()) -> DataFrame:
    """Null first when ascending, last when descending. ties: further ascending columns for a full order."""
    c = Compiler(df)
    by = [x.col.desc() if down else x.col.asc() for path, down in keys for x in [c.field(path)] if not isinstance(x.kind, T.NullType)]
    by += [quoted(x).asc() for x in ties if x in df.columns]
    return df.orderBy(*by) if by else df


def limit(df: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise CompileError("LIMIT must not be negative")
    return df.limit(n)


def skip(df: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise CompileError("SKIP must not be negative")
    return df.offset(n) if n else df


def group(df: DataFrame, keys: tuple[str, ...], accs: tuple[t.Acc, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """Keys keep their names; nulls are one group. Without keys: one row, or none for an empty input.

    order: the columns that give FIRST, LAST and PUSH their meaning.
    """
    c = Compiler(df)
    by = [c.field(k).col.alias(k) for k in keys]
    columns = [accumulate(c, a, order).alias(a.name) for a in accs]
    names = [*keys, *(a.name for a in accs)]
    if len(set(names)) < len(names):
        raise CompileError("GROUP names must differ")
    if by and not columns:
        return df.select(*by).distinct()
    if by:
        return df.groupBy(*by).agg(*columns)
    n = F.count(F.lit(1)).alias("rows of group")
    return df.agg(n, *columns).where(F.col("rows of group") > 0).drop("rows of group")


def count(df: DataFrame, name: str = "count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def unwind(df: DataFrame, path: str, preserve: bool = False) -> DataFrame:
    """A row for each element; a row without elements goes, or stays with null. Scalars pass through."""
    found = Compiler(df).resolve(path)
    if found is None:
        if not preserve:
            return df.where(F.lit(False))
        return df
    col, kind = found
    if not isinstance(kind, T.ArrayType):
        return df if preserve else df.where(col.isNotNull())
    parts = path.split(".")
    if path in df.columns or len(parts) == 1:
        name = path
        others = [quoted(c) for c in df.columns if c != name]
        exploded = df.select(*others, (F.explode_outer if preserve else F.explode)(col).alias(name))
        return exploded.select(*(quoted(c) for c in df.columns))
    element = "element of unwind"
    exploded = df.select("*", (F.explode_outer if preserve else F.explode)(col).alias(element))
    top = parts[0]
    inside = ".".join(f"`{p}`" for p in parts[1:])
    return exploded.select(*(quoted(c).withField(inside, F.col(element)).alias(c) if c == top else quoted(c) for c in df.columns))


def lookup(df: DataFrame, other: DataFrame, local: str, foreign: str, name: str, order: tuple[str, ...] = ()) -> DataFrame:
    """All rows of other whose foreign equals local, as an array; empty where there is none, or local is null."""
    key, docs = "key of lookup", "docs of lookup"
    whole = F.struct(*(quoted(c) for c in other.columns))
    by = F.struct(*(quoted(c) for c in order if c in other.columns), *(quoted(c) for c in other.columns if c not in order and _sortable(other.schema[c].dataType)))
    nested = other.select(Compiler(other).field(foreign).col.alias(key), by.alias("by"), whole.alias("doc")).where(F.col(key).isNotNull())
    nested = nested.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("by", "doc"))), lambda x: x["doc"]).alias(docs))
    kept = [quoted(c) for c in df.columns if c != name]
    joined = df.join(nested, Compiler(df).field(local).col == F.col(key), "left")
    return joined.select(*kept, F.coalesce(F.col(docs), F.array().cast(T.ArrayType(other.schema))).alias(name))


def lookup_unwind(df: DataFrame, other: DataFrame, local: str, foreign: str, name: str, preserve: bool = False) -> DataFrame:
    """LOOKUP and UNWIND of its result at once: a plain join, without arrays."""
    key = "key of lookup"
    right = other.select(Compiler(other).field(foreign).col.alias(key), F.struct(*(quoted(c) for c in other.columns)).alias("doc of lookup"))
    joined = df.join(right, Compiler(df).field(local).col == F.col(key), "left" if preserve else "inner")
    return joined.select(*(quoted(c) for c in df.columns if c != name), F.col("doc of lookup").alias(name))


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType | T.VariantType):
        return False
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    return all(_sortable(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else True
