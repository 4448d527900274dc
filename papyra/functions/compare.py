"""Two-valued comparison: null equals null, null is smaller than everything, and no comparison gives NULL.

The forms are chosen so that Parquet readers take them as pushed filters; tests of a literal side for null are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eq(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def lt(a: Column, b: Column, a_null: bool = True, b_null: bool = True) -> Column:
    """a < b. a_null, b_null: whether the side may be null."""
    less = a < b
    if a_null:
        less = a.isNull() | less
    return b.isNotNull() & less if b_null else less


def le(a: Column, b: Column, a_null: bool = True, b_null: bool = True) -> Column:
    less = b.isNotNull() & (a <= b) if b_null else a <= b
    return a.isNull() | less if a_null else less


def gt(a: Column, b: Column, a_null: bool = True, b_null: bool = True) -> Column:
    more = a > b
    if b_null:
        more = b.isNull() | more
    return a.isNotNull() & more if a_null else more


def ge(a: Column, b: Column, a_null: bool = True, b_null: bool = True) -> Column:
    more = a.isNotNull() & (a >= b) if a_null else a >= b
    return b.isNull() | more if b_null else more
