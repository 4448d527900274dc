"""Pipelines over streaming DataFrames.

MATCH, PROJECT and UNWIND run on every row; GROUP keeps state; SORT needs a GROUP before it and the complete
output mode. SKIP has no meaning on a stream. Windows with a watermark bound the state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import CompileError
from ..functions.expr import Compiler
from ..operators.accumulators import accumulate
from ..plans import compiler
from ..plans import tree as t


def apply(df: DataFrame, stages: Sequence[t.Stage], source: compiler.Source | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    grouped = False
    for s in stages:
        if isinstance(s, t.Skip | t.Limit):
            raise CompileError("SKIP and LIMIT need a bounded input")
        if isinstance(s, t.Lookup):
            raise CompileError("LOOKUP nests whole groups and needs a bounded input")
        if isinstance(s, t.Sort) and not grouped:
            raise CompileError("SORT on a stream needs a GROUP before it")
        grouped |= isinstance(s, t.Group | t.Count)
    return compiler.aggregate(df, stages, source, order)


def windowed(df: DataFrame, time: str, size: str, keys: Sequence[str], accs: Sequence[t.Acc], late: str = "10 minutes", slide: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """GROUP in windows of event time; events later than `late` behind the latest are left out."""
    timed = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    c = Compiler(timed)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = timed.groupBy(window, *(c.field(k).col.alias(k) for k in keys)).agg(*(accumulate(c, a, order).alias(a.name) for a in accs))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str], accs: Sequence[t.Acc], late: str = "10 minutes") -> DataFrame:
    """GROUP in sessions: runs of events that lie less than gap apart."""
    timed = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    c = Compiler(timed)
    out = timed.groupBy(F.session_window(time, gap).alias("window"), *(c.field(k).col.alias(k) for k in keys)).agg(*(accumulate(c, a, ()).alias(a.name) for a in accs))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all that is there, into Parquet."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
