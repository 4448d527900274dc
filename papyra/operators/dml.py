"""Changes of documents as functions from one snapshot to the next."""

from __future__ import annotations

import os
import time
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError, DuplicateKey
from ..functions.expr import Compiler, Value, family, quoted
from ..plans import tree as t


def new_id(at: float | None = None) -> str:
    """24 hex digits: seconds, then random."""
    return f"{int(time.time() if at is None else at):08x}{os.urandom(8).hex()}"


def valid_id(value: Any) -> bool:
    return isinstance(value, str) and len(value) == 24 and all(c in "0123456789abcdef" for c in value.lower())


def id_time(_id: Column) -> Column:
    """The instant that an id was made at."""
    return F.timestamp_seconds(F.conv(F.substring(_id, 1, 8), 16, 10).cast("long"))


def infer(values: Iterable[Any]) -> T.DataType:
    """The type that holds all of some literal values."""
    out: T.DataType = T.NullType()
    for v in values:
        out = _merge(out, _kind(v))
    return out


def _kind(v: Any) -> T.DataType:
    if v is None:
        return T.NullType()
    if isinstance(v, dict):
        return T.StructType([T.StructField(k, _kind(x)) for k, x in v.items()])
    if isinstance(v, list):
        return T.ArrayType(infer(v))
    for py, kind in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), (bytes, T.BinaryType())):
        if isinstance(v, py):
            return kind
    raise CompileError(f"no type for {type(v).__name__}")


def _merge(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, T.NullType) or a == b:
        return b
    if isinstance(b, T.NullType):
        return a
    if family(a) == family(b) == "number":
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_merge(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = [*a.names, *(n for n in b.names if n not in a.names)]
        return T.StructType([T.StructField(n, _merge(a[n].dataType if n in a.names else T.NullType(), b[n].dataType if n in b.names else T.NullType())) for n in names])
    raise CompileError(f"values of {a.simpleString()} and {b.simpleString()} in one field")


def _fit(v: Any, kind: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_fit(v.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_fit(x, kind.elementType) for x in v]
    return float(v) if isinstance(kind, T.DoubleType | T.FloatType) else v


def documents(spark: SparkSession, docs: Iterable[dict], schema: T.StructType | None = None, with_id: bool = True) -> tuple[DataFrame, list[str]]:
    """Literal documents as a DataFrame, and their ids. An _id that is no id is replaced."""
    rows = [dict(d) for d in docs]
    ids = []
    if with_id and (schema is None or "_id" in schema.names):
        for d in rows:
            own = d.get("_id")
            ids.append(own.lower() if valid_id(own) else new_id())
        rows = [{"_id": i, **{k: v for k, v in d.items() if k != "_id"}} for i, d in zip(ids, rows, strict=True)]
    if schema is None:
        schema = infer(rows) if rows else T.StructType([T.StructField("_id", T.StringType())])
    return spark.createDataFrame([_fit(d, schema) for d in rows], schema), ids


def insert(df: DataFrame, new: DataFrame) -> DataFrame:
    """Both; fields that one side lacks are null. Numbers widen to the wider type."""
    left, right = df, new
    for f in new.schema.fields:
        if f.name in df.columns and df.schema[f.name].dataType != f.dataType:
            a, b = df.schema[f.name].dataType, f.dataType
            if family(a) == family(b) == "number":
                wide = T.DoubleType() if not all(isinstance(x, T.ByteType | T.ShortType | T.IntegerType | T.LongType) for x in (a, b)) else T.LongType()
                left, right = left.withColumn(f.name, quoted(f.name).cast(wide)), right.withColumn(f.name, quoted(f.name).cast(wide))
            elif family(b) == "null":
                right = right.withColumn(f.name, quoted(f.name).cast(a))
            elif family(a) == "null":
                left = left.withColumn(f.name, quoted(f.name).cast(b))
    return left.unionByName(right, allowMissingColumns=True)


def merge(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Documents of both, by key: a field of other that has a value replaces the field of df. Null keys match nothing."""
    right = other.select(*(quoted(c).alias(f"other {c}") for c in other.columns))
    joined = df.join(right, quoted(key) == quoted(f"other {key}"), "full")
    names = [*df.columns, *(c for c in other.columns if c not in df.columns)]
    return joined.select(*(F.coalesce(quoted(f"other {c}"), quoted(c)).alias(c) if c in df.columns and c in other.columns else quoted(c if c in df.columns else f"other {c}").alias(c) for c in names))


def repeated(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Values of keys that more than one row has; rows with a null key do not count."""
    c = Compiler(df)
    own = df.select(*(c.field(k).col.alias(k) for k in keys))
    for k in keys:
        own = own.where(quoted(k).isNotNull())
    return own.groupBy(*(quoted(k) for k in keys)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_unique(df: DataFrame, keys: tuple[str, ...], what: str) -> None:
    found = repeated(df, keys).head(1)
    if found:
        raise DuplicateKey(f"{what}: {dict(zip(keys, found[0], strict=False))} is there twice")


def _literal(df: DataFrame, value: Any) -> Value:
    return Compiler(df).value(t.Lit(value))


def update(df: DataFrame, changes: Iterable[t.Change], where: t.Expr | None = None, rows: Column | None = None) -> DataFrame:
    """The snapshot after the changes, in their order, of the rows that match. rows: the matching rows, instead of where."""
    hit = rows if rows is not None else F.coalesce(Compiler(df).where(where), F.lit(False)) if where is not None else F.lit(True)
    mark = "hit by update"
    out = df.withColumn(mark, hit)
    order = list(df.columns)
    for change in changes:
        out = _apply(out, change, F.col(mark))
        order += [c for c in out.columns if c not in order and c != mark]
    return out.select(*(quoted(c) for c in order if c in out.columns))


def _put(df: DataFrame, path: str, col: Column) -> DataFrame:
    """Set a field; a dotted path sets a field of a nested document."""
    top, _, rest = path.partition(".")
    if path in df.columns or not rest or top not in df.columns:
        return df.withColumn(path, col)
    return df.withColumn(top, quoted(top).withField(".".join(f"`{p}`" for p in rest.split(".")), col))


def _apply(df: DataFrame, change: t.Change, hit: Column) -> DataFrame:
    now = Compiler(df).field(change.field)
    missing = family(now.kind) == "null"
    if change.verb == "SET":
        new = _literal(df, change.value)
        kind = now.kind if missing is False and family(new.kind) == "null" else new.kind if missing else None
        if kind is None:
            both = family(now.kind) == family(new.kind)
            if not both:
                raise CompileError(f"{change.field} holds {now.kind.simpleString()}, not {new.kind.simpleString()}")
            kind = T.DoubleType() if family(now.kind) == "number" and isinstance(new.kind, T.DoubleType) else now.kind
        return _put(df, change.field, F.when(hit, new.col.cast(kind)).otherwise(now.col.cast(kind)))
    if change.verb == "INC":
        new = _literal(df, change.value)
        if family(new.kind) != "number" or family(now.kind) not in ("number", "null"):
            raise CompileError("+= needs numbers")
        real = isinstance(new.kind, T.DoubleType) or isinstance(now.kind, T.DoubleType | T.FloatType)
        kind = "double" if real else "long" if missing or not isinstance(now.kind, T.DecimalType) else now.kind.simpleString()
        base = now.col.cast(kind)
        return _put(df, change.field, F.when(hit, F.coalesce(base, F.lit(0).cast(kind)) + new.col.cast(kind)).otherwise(base))
    if missing and change.verb in ("UNSET", "PULL", "RENAME"):
        return df
    if change.verb == "UNSET":
        return _put(df, change.field, F.when(~hit, now.col))
    if change.verb == "PUSH":
        new = _literal(df, change.value)
        if not missing and not isinstance(now.kind, T.ArrayType):
            raise CompileError(f"{change.field} is no array")
        kind = T.ArrayType(new.kind) if missing else now.kind
        base = now.col.cast(kind)
        return _put(df, change.field, F.when(hit, F.array_append(F.coalesce(base, F.array().cast(kind)), new.col.cast(kind.elementType))).otherwise(base))
    if change.verb == "PULL":
        if not isinstance(now.kind, T.ArrayType):
            return df
        new = _literal(df, change.value)
        gone = F.filter(now.col, lambda x: ~x.eqNullSafe(new.col.cast(now.kind.elementType)))
        return _put(df, change.field, F.when(hit, gone).otherwise(now.col))
    if change.verb == "RENAME":
        if change.value in df.columns and df.schema[change.value].dataType != now.kind:
            raise CompileError(f"{change.value} holds another type")
        target = Compiler(df).field(change.value).col
        moved = df.withColumn(change.value, F.when(hit & now.col.isNotNull(), now.col).otherwise(target.cast(now.kind)))
        return _put(moved, change.field, F.when(~hit, now.col))
    raise CompileError(f"unknown change {change.verb}")


def delete(df: DataFrame, where: t.Expr | None = None, rows: Column | None = None) -> DataFrame:
    """The rows that do not match; rows whose condition is an error stay."""
    if where is None and rows is None:
        return df.where(F.lit(False))
    hit = rows if rows is not None else Compiler(df).where(where)
    return df.where(~F.coalesce(hit, F.lit(False)))
