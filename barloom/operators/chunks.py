"""Ordered windows that stay parallel inside one symbol.

A plain ``partitionBy("symbol")`` window puts a whole symbol into one task, so a symbol holding
a third of the rows becomes one straggler. Here every series is cut into time chunks:

* bounded frames (rolling features, forward labels) get a *halo*: the rows a frame can reach
  from the neighbouring chunks are copied in, and dropped again by :func:`owned`;
* unbounded frames (running sums, forward fill, running maxima) use a two-level scan: chunk
  totals are folded once per series and added back inside the chunk (:func:`prefix`).

Both are exact. The only tables that follow one series as a whole have one row per counting
bucket or per chunk, never one row per bar.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ("symbol",)
START, HERE = Window.unboundedPreceding, Window.currentRow


@dataclass(frozen=True)
class Span:
    """Chunk length: ``width`` counting buckets of ``bucket_seconds`` each."""

    bucket_seconds: int
    width: int


HOURLY = Span(bucket_seconds=64 * 3600, width=8)
DAILY = Span(bucket_seconds=128 * 86400, width=8)


def seconds(ts: str = "ts") -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def bucket_of(ts: str, length: int) -> Column:
    return F.floor(seconds(ts) / F.lit(length)).cast("bigint")


def ordered(order=("ts",), key=KEY, chunk: str = "_chunk") -> WindowSpec:
    """The one partitioning and ordering that all windows of a chunked frame share."""
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*key, chunk).orderBy(*order)


class SharedWindow:
    """The default window of chunked frames, looked up when a session exists."""

    def __call__(self) -> WindowSpec:
        return ordered()

    def rowsBetween(self, first: int, last: int) -> WindowSpec:
        return ordered().rowsBetween(first, last)


def _placement(base: DataFrame, before: int, after: int, span: Span, key) -> DataFrame:
    """Per counting bucket: first row number, own chunk, and every chunk that needs its rows."""
    series = Window.partitionBy(*key)
    seq = series.orderBy("_fine")
    table = (
        base.groupBy(*key, "_fine")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({
            "_home": F.floor(F.col("_fine") / F.lit(span.width)).cast("bigint"),
            "_end": F.sum("_n").over(seq.rowsBetween(START, 0)),
        })
        .withColumns({
            "_start": F.col("_end") - F.col("_n"),
            "_next": F.lead("_home").over(seq),
            "_prev": F.lag("_home").over(seq),
        })
    )
    wanted = F.array(F.col("_home"))
    if before > 0:
        reach = series.orderBy("_end").rangeBetween(0, before - 1)
        table = table.withColumn("_later", F.collect_set("_next").over(reach))
        wanted = F.array_union(wanted, F.col("_later"))
    if after > 0:
        reach = series.orderBy("_start").rangeBetween(-(after - 1), 0)
        table = table.withColumn("_sooner", F.collect_set("_prev").over(reach))
        wanted = F.array_union(wanted, F.col("_sooner"))
    return table.select(*key, "_fine", "_start", "_home", wanted.alias("_wanted"))


def chunked(df: DataFrame, before: int = 0, after: int = 0, span: Span = HOURLY,
            key=KEY, ts: str = "ts") -> DataFrame:
    """Add ``_chunk``, ``_rn`` (row number in the series, from 0) and ``_own``.

    ``before`` / ``after`` are the rows a frame may reach back or ahead, summed over chained
    windows. ``ts`` must be unique per key. Rows are shuffled once to ``(key, _chunk)``.
    """
    base = df.withColumn("_fine", bucket_of(ts, span.bucket_seconds))
    placed = (
        base.join(_placement(base, before, after, span, key), [*key, "_fine"])
        .withColumn("_chunk", F.explode("_wanted"))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_fine", "_wanted", "_home")
    )
    w = ordered(ts, key)
    first_row = F.first("_start").over(w.rowsBetween(START, 0))
    return placed.withColumn("_rn", first_row + F.row_number().over(w) - 1).drop("_start")


def owned(df: DataFrame) -> DataFrame:
    """Drop halo rows; ``_chunk`` and ``_rn`` stay for a following scan."""
    return df.where("_own").drop("_own")


def clean(df: DataFrame) -> DataFrame:
    """Drop halo rows and all helper columns."""
    df = df.where("_own") if "_own" in df.columns else df
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def with_time_chunk(df: DataFrame, span: Span = HOURLY, ts: str = "ts") -> DataFrame:
    """``_chunk`` only: enough for scans, which need neither halo nor row number."""
    return df.withColumn("_chunk", bucket_of(ts, span.bucket_seconds * span.width))


def _running(op: str, value: Column, w) -> Column:
    if op == "sum":
        return F.sum(value).over(w)
    if op == "max":
        return F.max(value).over(w)
    if op == "last":
        return F.last(value, ignorenulls=True).over(w)
    raise ValueError(f"unknown scan {op}")


def _total(op: str, value: Column, position: Column) -> Column:
    if op == "sum":
        return F.sum(value)
    if op == "max":
        return F.max(value)
    return F.max_by(value, F.when(value.isNotNull(), position))


def _joined(op: str, carry: Column, local: Column) -> Column:
    if op == "sum":
        return F.coalesce(carry + local, carry, local)
    if op == "max":
        return F.greatest(carry, local)
    return F.coalesce(local, carry)


def prefix(df: DataFrame, scans: dict, key=KEY, order=("ts",), inclusive: bool = True) -> DataFrame:
    """Running ``sum`` / ``max`` / ``last`` non-null value from the start of each series.

    ``scans`` maps output name to ``(op, column)``. ``df`` has ``_chunk`` and no halo rows.
    """
    order = [order] if isinstance(order, str) else list(order)
    position = F.struct(*order)
    w = ordered(order, key).rowsBetween(START, HERE if inclusive else -1)
    values = {name: (op, F.col(c) if isinstance(c, str) else c) for name, (op, c) in scans.items()}
    totals = df.groupBy(*key, "_chunk").agg(
        *[_total(op, c, position).alias(f"_t_{name}") for name, (op, c) in values.items()]
    )
    earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(START, -1)
    carries = totals.select(
        *key, "_chunk",
        *[_running(op, F.col(f"_t_{name}"), earlier).alias(f"_c_{name}") for name, (op, _) in values.items()],
    )
    local = df.withColumns({f"_l_{name}": _running(op, c, w) for name, (op, c) in values.items()})
    out = local.join(carries, [*key, "_chunk"])
    return out.withColumns(
        {name: _joined(op, F.col(f"_c_{name}"), F.col(f"_l_{name}")) for name, (op, _) in values.items()}
    ).drop(*[f"_{p}_{name}" for name in values for p in "cl"])
