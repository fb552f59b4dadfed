"""Joins between series: as-of, equi-join with fill, calendar semi/anti joins, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.chunks import HOURLY, KEY, Span, chunked, clean, prefix, with_time_chunk


def asof(left: DataFrame, right: DataFrame, values: list, key=KEY, ts: str = "ts",
         span: Span = HOURLY) -> DataFrame:
    """Attach the newest ``right`` values at or before each ``left`` row.

    Both sides go through one union, shuffled once by (key, time chunk); the state crossing a chunk
    boundary is one row per chunk. With ``key=()`` the right side is a market-wide series.
    """
    kept = [x for x in left.columns]
    tape = (
        left.withColumn("_side", F.lit(1))
        .unionByName(right.select(*key, ts, *values).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    )
    order = [ts, "_side", *[k for k in KEY if k in kept and k not in key]]
    scans = {f"_v_{v}": ("last", v) for v in values}
    out = prefix(with_time_chunk(tape, span, ts), scans, key=key, order=order)
    return out.where("_side = 1").select(*kept, *[F.col(f"_v_{v}").alias(v) for v in values])


def join_then_fill(left: DataFrame, right: DataFrame, values: list, key=KEY, ts: str = "ts",
                   span: Span = HOURLY) -> DataFrame:
    """Exact-stamp left join, then forward fill: stamps without a partner do not contribute."""
    joined = left.join(right.select(*key, ts, *values), [*key, ts], "left")
    out = prefix(with_time_chunk(joined, span, ts), {f"_v_{v}": ("last", v) for v in values}, key=key, order=ts)
    return out.select(*left.columns, *[F.col(f"_v_{v}").alias(v) for v in values])


def merge_sources(sources: list, key=("symbol", "ts")) -> DataFrame:
    """Union in priority order; the first source that has a stamp wins (combines before the shuffle)."""
    tagged = [s.withColumn("_priority", F.lit(i)) for i, s in enumerate(sources)]
    tape = tagged[0]
    for s in tagged[1:]:
        tape = tape.unionByName(s)
    return pick(tape, key, "_priority", newest=False).drop("_priority")


def pick(df: DataFrame, key, order, newest: bool) -> DataFrame:
    """One whole row per key, the oldest or the newest by a total order."""
    rest = [x for x in df.columns if x not in key]
    choose = F.max_by if newest else F.min_by
    position = F.struct(*order) if isinstance(order, (list, tuple)) else F.col(order)
    return df.groupBy(*key).agg(choose(F.struct(*rest), position).alias("_row")).select(*key, "_row.*")


def newest_rows(df: DataFrame, n: int, key=KEY, ts: str = "ts") -> DataFrame:
    """Last ``n`` rows per key; Spark trims every map task to n rows per key before the shuffle."""
    w = Window.partitionBy(*key).orderBy(F.desc(ts))
    return df.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= n).drop("_pos")


def repair_stamps(broken: DataFrame, trusted: DataFrame, price: str = "close", span: Span = HOURLY) -> DataFrame:
    """Give ``broken`` rows the stamps of ``trusted``.

    The row offset of a series is the first trusted row whose price equals the first broken price.
    """
    a = clean_numbered(trusted, span).select("symbol", F.col("ts").alias("true_ts"), F.col("rn"), F.col(price).alias("_p"))
    b = clean_numbered(broken, span)
    first = b.where("rn = 0").select("symbol", F.col(price).alias("_p"))
    offsets = a.join(first, ["symbol", "_p"]).groupBy("symbol").agg(F.min("rn").alias("offset"))
    shifted = b.join(offsets, "symbol").withColumn("_at", F.col("rn") + F.col("offset"))
    return shifted.join(
        a.select("symbol", F.col("rn").alias("_at"), "true_ts"), ["symbol", "_at"]
    ).drop("_at", "offset")


def clean_numbered(df: DataFrame, span: Span = HOURLY) -> DataFrame:
    return clean(chunked(df, span=span).withColumn("rn", F.col("_rn")))


def weekly_returns(daily: DataFrame) -> DataFrame:
    """Open-to-close return of every calendar week (keyed by its Monday)."""
    week = F.date_trunc("week", "ts")
    return daily.groupBy("symbol", week.alias("week")).agg(
        (F.try_divide(F.max_by("close", "ts"), F.min_by("open", "ts")) - 1).alias("week_ret"))


def previous_week(daily: DataFrame) -> DataFrame:
    """Each day with the return of the calendar week before it (NULL without one)."""
    past = weekly_returns(daily).select(
        "symbol", (F.col("week") + F.expr("INTERVAL 7 DAYS")).alias("_week"), F.col("week_ret").alias("prev_week_ret"))
    return daily.withColumn("_week", F.date_trunc("week", "ts")).join(past, ["symbol", "_week"], "left").drop("_week")


def blackout_days(daily: DataFrame, first_day: int = 10, last_day: int = 27, months=(1, 4, 7, 10)) -> DataFrame:
    """Generated calendar of the earnings weeks covering the years present in the data."""
    edges = daily.agg(F.min(F.year("ts")).alias("a"), F.max(F.year("ts")).alias("b"))
    return (
        edges.select(F.explode(F.sequence("a", "b")).alias("y"))
        .select("y", F.explode(F.array(*[F.lit(m) for m in months])).alias("m"))
        .select(F.explode(F.sequence(F.lit(first_day), F.lit(last_day))).alias("d"), "y", "m")
        .select(F.make_date("y", "m", "d").alias("day"))
    )


def regime_levels(rows: DataFrame, levels: DataFrame, fallback: str = "sideways") -> DataFrame:
    """Stop and target levels by regime; an unknown regime uses the fallback row."""
    known = levels.select(F.col("regime").alias("_regime"), "sl_pct", "tp_pct")
    names = [r["_regime"] for r in known.select("_regime").collect()]  # a handful of regime names
    routed = F.when(F.col("regime").isin(names), F.col("regime")).otherwise(F.lit(fallback))
    return rows.withColumn("_regime", routed).join(known, "_regime").drop("_regime")
