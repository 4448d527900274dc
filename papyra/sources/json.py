"""Documents as extended JSON, out and in, and result formats for reading."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import quoted


def extended(col: Column, kind: T.DataType) -> Column:
    """A column whose plain JSON keeps types that JSON lacks: {"$date": ms}, {"$numberDecimal": ""}, {"$numberLong": ""}, {"$binary": base64}."""
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*(extended(col.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: extended(x, kind.elementType))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.when(col.isNotNull(), F.struct(F.unix_millis(col.cast("timestamp")).alias("$date")))
    if isinstance(kind, T.DecimalType):
        return F.when(col.isNotNull(), F.struct(col.cast("string").alias("$numberLong" if kind.scale == 0 else "$numberDecimal")))
    if isinstance(kind, T.BinaryType):
        return F.when(col.isNotNull(), F.struct(F.base64(col).alias("$binary")))
    return col


def to_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One column: each row as a document, fields without value left out."""
    whole = F.struct(*(extended(quoted(f.name), f.dataType).alias(f.name) for f in df.schema.fields))
    return df.select(F.to_json(whole).alias(name))


def _plain(kind: T.DataType) -> T.DataType:
    """The type that extended JSON of a type parses to."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain(kind.elementType))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return T.StructType([T.StructField("$date", T.LongType())])
    if isinstance(kind, T.DecimalType):
        return T.StructType([T.StructField("$numberLong" if kind.scale == 0 else "$numberDecimal", T.StringType())])
    if isinstance(kind, T.BinaryType):
        return T.StructType([T.StructField("$binary", T.StringType())])
    return kind


def _back(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*(_back(col.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _back(x, kind.elementType))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.timestamp_millis(col.getField("$date")).cast(kind)
    if isinstance(kind, T.DecimalType):
        return col.getField("$numberLong" if kind.scale == 0 else "$numberDecimal").cast(kind)
    if isinstance(kind, T.BinaryType):
        return F.unbase64(col.getField("$binary"))
    return col


def from_json(df: DataFrame, schema: T.StructType, column: str = "json") -> DataFrame:
    """The documents of a column of extended JSON, as typed columns."""
    parsed = F.from_json(quoted(column), _plain(schema))
    return df.select(parsed.alias("doc")).select(*(_back(F.col("doc").getField(f.name), f.dataType).alias(f.name) for f in schema.fields))


# open documents


def open_documents(df: DataFrame, column: str = "json", key: str | None = None) -> DataFrame:
    """_id and doc, a VARIANT, of a column of JSON: fields may differ from document to document."""
    doc = F.parse_json(quoted(column))
    _id = F.try_variant_get(doc, "$._id", "string") if key is None else quoted(key).cast("string")
    return df.select(_id.alias("_id"), doc.alias("doc"))


def has(path: str, doc: str = "doc") -> Column:
    """Whether a document has a field, if only an explicit null."""
    found = F.variant_get(F.col(doc), f"$.{path}", "variant")
    return found.isNotNull() | F.coalesce(F.is_variant_null(found), F.lit(False))


def promote(df: DataFrame, fields: dict[str, str], doc: str = "doc") -> DataFrame:
    """Typed columns of an open collection; a value of another type is null."""
    return df.select(*(c for c in df.columns if c != doc), *(F.try_variant_get(F.col(doc), f"$.{path}", kind).alias(path) for path, kind in fields.items()))


# formats for reading


def _rows(df: DataFrame) -> Iterator[dict]:
    whole = to_json(df)
    for r in whole.toLocalIterator():
        yield json.loads(r.json)


def _columns(df: DataFrame) -> list[str]:
    return sorted(df.columns, key=lambda c: (c != "_id", c))


def _cell(v) -> str:
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def lines(df: DataFrame, style: str = "table") -> Iterator[str]:
    """The documents as lines of text: table, json, jsonpretty, csv or line (one field each). All but table are lazy."""
    names = _columns(df)
    if style == "json":
        yield from (json.dumps(r, ensure_ascii=False) for r in _rows(df))
    elif style == "jsonpretty":
        yield from (json.dumps(r, ensure_ascii=False, indent=2) for r in _rows(df))
    elif style == "csv":
        for row in [names, *[]]:
            yield _csv(row)
        yield from (_csv([_cell(r.get(c)) for c in names]) for r in _rows(df))
    elif style == "line":
        for r in _rows(df):
            yield from (f"{c}: {_cell(r.get(c))}" for c in names if c in r)
            yield ""
    elif style == "table":  # a report: all its rows are read to find the widths
        rows = [names, *([_cell(r.get(c)) for c in names] for r in _rows(df))]
        width = [max(len(r[k]) for r in rows) for k in range(len(names))]
        rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
        for k, r in enumerate(rows):
            if k < 2:
                yield rule
            yield "| " + " | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)) + " |"
        yield rule
    else:
        raise ValueError(f"unknown style {style}")


def _csv(row: list[str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(row)
    return out.getvalue()
