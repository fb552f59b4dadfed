"""Event studies on daily and intraday bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import c, div, flag, full, lag, lead, percent_rank_last
from barloom.operators import features as X
from barloom.operators.align import asof, previous_week
from barloom.operators.chunks import DAILY, SharedWindow, chunked, clean, owned, prefix
from barloom.session import cut_lineage

W = SharedWindow()


def daily_frame(daily: DataFrame) -> DataFrame:
    """20-day momentum regime per day; the warm-up is 'unknown'."""
    df = clean(chunked(daily, before=20, span=DAILY).withColumn("_m", div("close", lag("close", 20, W)) - 1).withColumn("momentum", c("_m")))
    return df.withColumn(
        "regime", F.when(c("momentum") > 0.5, "bull").when(c("momentum") < -0.3, "bear").when(c("momentum").isNull(), "unknown").otherwise("sideways"))


def streaks(daily: DataFrame, zero_policy: str = "reset") -> DataFrame:
    """Signed run of consecutive up or down closes, and the summed move of the run.

    A zero move ends the run ('reset') or counts as up ('up'). Runs are found from the last row where
    the direction changed, so a long run is never one group.
    """
    df = chunked(daily, before=2, span=DAILY).withColumn("ret", div("close", lag("close", 1, W)) - 1)
    sign = F.signum("ret") if zero_policy == "reset" else F.when(c("ret") >= 0, 1.0).otherwise(F.when(c("ret").isNotNull(), -1.0))
    df = df.withColumn("_s", F.coalesce(sign, F.lit(0.0)))
    df = owned(df.withColumn("_turn", F.coalesce(c("_s") != lag("_s", 1, W), F.lit(True))))
    df = cut_lineage(prefix(df, {"_sum": ("sum", F.coalesce(c("ret"), F.lit(0.0)))}))
    start = F.struct(c("_rn").alias("rn"), (c("_sum") - F.coalesce(c("ret"), F.lit(0.0))).alias("base"))
    df = prefix(df, {"_start": ("last", F.when(c("_turn"), start))})
    length = c("_rn") - c("_start.rn") + 1
    return df.withColumns({
        "streak": F.when(c("_s") == 0, 0).otherwise((c("_s") * length).cast("int")),
        "streak_move": F.when(c("_s") == 0, 0.0).otherwise((c("_sum") - c("_start.base")) * 100),
    }).drop("_s", "_turn", "_sum", "_start")


def daily_features(daily: DataFrame, vix: DataFrame, zero_policy: str = "up") -> DataFrame:
    """Everything the daily rule catalog reads, one row per symbol and day.

    Yesterday's streak, gap, volatility index level and change, averages, RSI, ATR, next days' prices,
    trading-day calendar and last week's return.
    """
    values = [x for x in ("vix", "term_prev") if x in vix.columns]
    base = cut_lineage(asof(streaks(daily, zero_policy).drop("_chunk", "_rn"), vix, values, key=(), span=DAILY))
    df = chunked(base, before=205, after=5, span=DAILY)
    df = X.rsi(X.atr(df))
    nexts = {f"{x}_{k}": lead(x, k, W) for x, ks in (("close", (1, 2, 3, 4, 5)), ("open", (1,)), ("ts", (1, 2, 3))) for k in ks}
    df = df.withColumns({
        **nexts,
        "prev_streak": F.coalesce(lag("streak", 1, W), F.lit(0)), "prev_drop": F.coalesce(lag("streak_move", 1, W), F.lit(0.0)),
        "prev_close": lag("close", 1, W), "vix_change": c("vix") - lag("vix", 1, W),
        "sma50": full(F.avg, "close", 50, W), "sma200": full(F.avg, "close", 200, W),
        "volume_ratio": div("volume", full(F.avg, "volume", 20, W)),
        "atr_rank": percent_rank_last("atr_14", 100, W),
        "dow": F.weekday("ts"), "month": F.month("ts"), "dom": F.dayofmonth("ts"),
    })
    df = df.withColumns({
        "prev_vix": lag("vix", 1, W), "prev_vix_change": lag("vix_change", 1, W), "lag_streak": lag("prev_streak", 1, W),
        "lag_vix": lag("vix", 2, W), "prev_rsi": lag("rsi_14", 1, W), "prev_sma50": lag("sma50", 1, W),
        "prev_sma200": lag("sma200", 1, W), "prev_atr": lag("atr_14", 1, W), "prev_atr_rank": lag("atr_rank", 1, W),
        "prev_volume_ratio": lag("volume_ratio", 1, W),
        "gap": (div("open", "prev_close") - 1) * 100, "day_ret": (div("close", "open") - 1) * 100,
        "sma_distance": (div("prev_close", lag("sma200", 1, W)) - 1) * 100,
    })
    df = cut_lineage(clean(df))
    month = Window.partitionBy("symbol", F.date_trunc("month", "ts"))
    df = df.withColumns({
        "trading_day": F.row_number().over(month.orderBy("ts")),
        "trading_days_left": F.row_number().over(month.orderBy(F.desc("ts"))) - 1,
    })
    return previous_week(cut_lineage(df))


def gap_study(daily: DataFrame, thresholds=(0.1, 0.25, 0.5, 1.0, 1.5, 2.0)) -> DataFrame:
    """Fill rate, intraday move and fade statistics of overnight gaps beyond each threshold."""
    df = clean(chunked(daily, before=1, span=DAILY).withColumn("_p", lag("close", 1, W)).withColumns({
        "prev": c("_p"), "gap": (div("open", "_p") - 1) * 100, "intraday": (div("close", "open") - 1) * 100}))
    df = df.where("prev is not null").withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    df = df.where(F.abs("gap") > c("threshold"))
    up = c("gap") > 0
    df = df.withColumns({
        "side": F.when(up, "up").otherwise("down"),
        "filled": flag(F.when(up, c("low") <= c("prev")).otherwise(c("high") >= c("prev"))),
        "fade": F.when(up, -c("intraday")).otherwise(c("intraday")),
    })
    return df.groupBy("symbol", "threshold", "side").agg(
        F.count(F.lit(1)).alias("n"), F.avg("filled").alias("fill_rate"), F.avg("intraday").alias("avg_intraday"),
        F.avg("fade").alias("avg_fade"), F.try_divide(F.avg("fade"), F.stddev_samp("fade") / F.sqrt(F.count("fade"))).alias("t_stat"))


def opening_range(bars: DataFrame, first_hours=(9, 10), until: int = 16) -> DataFrame:
    """Per day: range of the opening bars, whether the rest of the day broke it, and the outcome."""
    hour = F.hour("ts")
    in_open, rest = hour.between(*first_hours), (hour > first_hours[1]) & (hour < until)
    day = bars.where(hour.between(first_hours[0], until - 1)).groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(
        F.max(F.when(in_open, c("high"))).alias("or_high"), F.min(F.when(in_open, c("low"))).alias("or_low"),
        F.count_if(in_open).alias("_open"), F.count_if(rest).alias("_rest"),
        F.max(F.when(rest, c("high"))).alias("_top"), F.min(F.when(rest, c("low"))).alias("_low"),
        F.max_by("close", F.when(rest, c("ts"))).alias("_close"))
    day = day.where("_open > 0 and _rest > 1")
    up, down = flag(c("_top") > c("or_high")), flag(c("_low") < c("or_low"))
    return day.select(
        "symbol", c("day").alias("ts"), (div(c("or_high") - c("or_low"), "or_low") * 100).alias("or_range"),
        up.alias("broke_up"), down.alias("broke_down"),
        F.when(up == 1, (div("_close", "or_high") - 1) * 100).alias("long_ret"),
        F.when(down == 1, (1 - div("_close", "or_low")) * 100).alias("short_ret"))


SESSIONS = (("open_rush", 9, 10), ("morning", 11, 12), ("lunch", 13, 14), ("power_hour", 15, 16))


def session_name():
    out = F.lit(None).cast("string")
    for name, first, last in SESSIONS:
        out = F.when(F.hour("ts").between(first, last), name).otherwise(out)
    return out


def session_returns(bars: DataFrame) -> DataFrame:
    """First open to last close of every session of every day."""
    df = bars.withColumn("session", session_name()).where("session is not null")
    return df.groupBy("symbol", F.date_trunc("day", "ts").alias("day"), "session").agg(
        (F.try_divide(F.max_by("close", "ts"), F.min_by("open", "ts")) - 1).alias("ret"))


def entry_exit_horizons(bars: DataFrame, entry_hour: int = 9, horizons=(1, 2, 3, 4, 6)) -> DataFrame:
    """Enter at one hour of the day, leave after each horizon, both sides."""
    df = chunked(bars, after=max(horizons))
    exits = F.array(*[F.struct(F.lit(k).alias("horizon"), lead("close", k, W).alias("later")) for k in horizons])
    df = clean(df.withColumn("exits", exits)).where(F.hour("ts") == entry_hour).select("symbol", "ts", "close", F.explode("exits").alias("_x"))
    move = div("_x.later", "close") - 1
    both = F.explode(F.array(F.struct(F.lit("long").alias("side"), move.alias("ret")), F.struct(F.lit("short").alias("side"), (-move).alias("ret"))))
    return df.select("symbol", "ts", "_x.horizon", both.alias("_y")).select("symbol", "ts", "horizon", "_y.*").where("ret is not null")


def first_bar_study(bars: DataFrame, hour: int = 9, until: int = 16) -> DataFrame:
    """Direction of the first bar against the rest of the day."""
    h = F.hour("ts")
    day = bars.where(h.between(hour, until - 1)).groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(
        F.max(F.when(h == hour, c("open"))).alias("_o"), F.max(F.when(h == hour, c("close"))).alias("_c"),
        F.max_by("close", F.when(h > hour, c("ts"))).alias("_last"), F.count_if(h > hour).alias("_n"))
    day = day.where("_c is not null and _n > 1")
    rest = div("_last", "_c") - 1
    first_up = c("_c") > c("_o")
    return day.select("symbol", c("day").alias("ts"), F.when(first_up, "up").otherwise("down").alias("first_dir"),
                      rest.alias("rest_ret"), F.when(first_up, rest).otherwise(-rest).alias("continuation"))
