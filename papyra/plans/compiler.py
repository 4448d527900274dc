"""Statements that read: to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..errors import CompileError
from ..operators import stages as s
from . import tree as t

Source = Callable[[str], DataFrame]
Order = Callable[[str], tuple[str, ...]]


def find(df: DataFrame, q: t.Find, ties: tuple[str, ...] = ()) -> DataFrame:
    """Filter, sort, skip, limit, project: in this order, whatever the order of the clauses."""
    if q.where is not None:
        df = s.match(df, q.where)
    if q.order:
        df = s.sort(df, q.order, ties)
    if q.limit is not None and q.skip:
        df = s.skip(s.limit(df, q.limit + q.skip), q.skip)  # one top-k of both
    elif q.skip:
        df = s.skip(df, q.skip)
    elif q.limit is not None:
        df = s.limit(df, q.limit)
    return s.select(df, q.select) if q.select else df


def aggregate(df: DataFrame, stages: Sequence[t.Stage], source: Source | None = None, order: tuple[str, ...] = (), orders: Order | None = None) -> DataFrame:
    """Stages in turn. order: the columns that order the collection; a SORT takes their place for what follows."""
    own = order
    k = 0
    while k < len(stages):
        stage = stages[k]
        if isinstance(stage, t.Lookup):
            if source is None:
                raise CompileError("LOOKUP needs a database")
            other = source(stage.source)
            following = stages[k + 1] if k + 1 < len(stages) else None
            if isinstance(following, t.Unwind) and following.path == stage.name:
                df = s.lookup_unwind(df, other, stage.local, stage.foreign, stage.name, following.preserve)
                k += 2
                continue
            df = s.lookup(df, other, stage.local, stage.foreign, stage.name, orders(stage.source) if orders else ())
        elif isinstance(stage, t.Match):
            df = s.match(df, stage.where)
        elif isinstance(stage, t.Project):
            df = s.project(df, stage.items)
        elif isinstance(stage, t.Group):
            df = s.group(df, stage.keys, stage.accs, own)
            own = stage.keys
        elif isinstance(stage, t.Sort):
            df = s.sort(df, stage.keys, tuple(c for c in own if c in df.columns))
            following = stages[k + 1 : k + 3]
            if len(following) == 2 and isinstance(following[0], t.Skip) and isinstance(following[1], t.Limit):
                df = s.skip(s.limit(df, following[0].n + following[1].n), following[0].n)
                k += 3
                continue
        elif isinstance(stage, t.Limit):
            df = s.limit(df, stage.n)
        elif isinstance(stage, t.Skip):
            df = s.skip(df, stage.n)
        elif isinstance(stage, t.Unwind):
            df = s.unwind(df, stage.path, stage.preserve)
        elif isinstance(stage, t.Count):
            df = s.count(df, stage.name)
        else:
            raise CompileError(f"unknown stage {type(stage).__name__}")
        k += 1
    return df
