"""Indexes as constraints and layouts: Spark finds rows by pushed filters over sorted files, not by entry."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compare
from ..functions.expr import Compiler
from .dml import check_unique


@dataclass(frozen=True)
class Index:
    name: str
    keys: tuple[tuple[str, bool], ...]
    unique: bool = False
    sparse: bool = False
    text: bool = False
    ttl_seconds: int | None = None

    @property
    def paths(self) -> tuple[str, ...]:
        return tuple(k for k, _ in self.keys)

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(d: dict) -> Index:
        return Index(**{**d, "keys": tuple((k, bool(x)) for k, x in d["keys"])})

    def check(self, df: DataFrame) -> None:
        """Raise if the snapshot breaks a unique index. Rows with a null key never do."""
        if self.unique:
            check_unique(df, self.paths, self.name)

    def layout(self, df: DataFrame) -> DataFrame:
        """The snapshot sorted by the index's keys, so that files hold narrow ranges and readers skip most of them."""
        c = Compiler(df)
        by = [c.field(k).col.desc() if down else c.field(k).col.asc() for k, down in self.keys]
        return df.repartitionByRange(*by).sortWithinPartitions(*by)


def entries(df: DataFrame, index: Index) -> DataFrame:
    """Keys and _id (or all columns) of the documents that an index holds: all, or those with a key if it is sparse."""
    c = Compiler(df)
    out = df.select(*(c.field(k).col.alias(k) for k in index.paths), *(["_id"] if "_id" in df.columns else []))
    return out.where(_any_null(df, index, out)) if index.sparse else out


def _any_null(df: DataFrame, index: Index, out: DataFrame) -> Column:
    test = F.lit(True)
    for k in index.paths:
        test = test & out[f"`{k}`"].isNotNull()
    return test


def equal(df: DataFrame, index: Index, *values) -> DataFrame:
    """All documents whose keys equal the values."""
    c, test = Compiler(df), F.lit(True)
    for k, v in zip(index.paths, values, strict=False):
        test = test & compare.eq(c.field(k).col, F.lit(v))
    return df.where(test)


def between(df: DataFrame, index: Index, low=None, high=None, inclusive: tuple[bool, bool] = (True, True)) -> DataFrame:
    """Documents whose first key lies in a range; an end that is None is open."""
    col, test = Compiler(df).field(index.paths[0]).col, F.lit(True)
    if low is not None:
        test = test & (compare.ge if inclusive[0] else compare.gt)(col, F.lit(low), True, False)
    if high is not None:
        test = test & col.isNotNull() & (compare.le if inclusive[1] else compare.lt)(col, F.lit(high), True, False)
    return df.where(test)


def live(df: DataFrame, path: str, ttl_seconds: int, now: Column | None = None) -> DataFrame:
    """Documents that have not expired; those without a time never do."""
    col = Compiler(df).field(path).col
    now = F.current_timestamp() if now is None else now
    return df.where(col.isNull() | (col.cast("timestamp") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > now))
