"""Accumulators of GROUP.

All but PUSH and ADD_TO_SET keep a fixed state for each group and combine before the shuffle; those two hold a
group's values in an array, as asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CompileError
from ..functions.expr import Compiler, family, quoted
from ..plans import tree as t


def accumulate(c: Compiler, acc: t.Acc, order: tuple[str, ...]) -> Column:
    if acc.function == "COUNT":
        return F.count(F.lit(1))
    if acc.value is None:
        raise CompileError(f"{acc.function} needs a value")
    value = c.value(acc.value)
    col = value.col if value.err is None else F.when(~value.err, value.col)
    number = family(value.kind) == "number"
    if acc.function == "SUM":
        return F.coalesce(F.sum(col.cast("double")), F.lit(0.0)) if number else F.sum(F.lit(0.0))
    if acc.function == "AVG":
        return F.coalesce(F.avg(col.cast("double")), F.lit(0.0)) if number else F.max(F.lit(0.0))
    if acc.function == "MIN":
        return F.min(col)
    if acc.function == "MAX":
        return F.max(col)
    if acc.function == "ADD_TO_SET":
        return F.sort_array(F.collect_set(col))
    own = [quoted(x) for x in order if x in c.df.columns]
    if not own:
        raise CompileError(f"{acc.function} needs an order: name the columns that order the collection")
    by = F.struct(*own)
    if acc.function == "FIRST":
        return F.min_by(col, by)
    if acc.function == "LAST":
        return F.max_by(col, by)
    if acc.function == "PUSH":
        kept = F.collect_list(F.struct(by.alias("by"), col.alias("value")))
        return F.filter(F.transform(F.array_sort(kept), lambda x: x["value"]), lambda x: x.isNotNull())
    raise CompileError(f"unknown accumulator {acc.function}")
