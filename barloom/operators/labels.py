"""Forward-looking targets. Frames look ahead, so chunks get a halo after them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import ahead, c, div, flag, full, lag, lead, log_ratio
from barloom.operators.chunks import HOURLY, SharedWindow, Span, chunked, clean
from barloom.operators.features import atr

W = SharedWindow()


def horizon_label(bars: DataFrame, horizon: int = 4, threshold: float = 0.0, span: Span = HOURLY) -> DataFrame:
    """1 when the log return over the horizon beats the threshold; the tail has no label and is cut."""
    df = chunked(bars, after=horizon, span=span)
    df = df.withColumn("fwd_ret", log_ratio(lead("close", horizon, W), "close"))
    return clean(df.where("fwd_ret is not null").withColumn("label", flag(c("fwd_ret") > threshold)))


def forward_returns(bars: DataFrame, horizons=(1, 2, 4, 6, 8, 12, 24, 48), span: Span = HOURLY) -> DataFrame:
    df = chunked(bars, after=max(horizons), span=span)
    return clean(df.withColumns({f"fwd_{k}": log_ratio(lead("close", k, W), "close") for k in horizons}))


def triple_barrier(bars: DataFrame, side: str = "long", tp: float = 2.0, sl: float = 1.0,
                   hold: int = 24, span: Span = HOURLY) -> DataFrame:
    """First of target, stop and timeout within the next ``hold - 1`` bars.

    The stop wins a tie, a timeout counts ``hold`` bars, and rows with fewer than ``hold - 1`` bars
    after them stay unlabelled.
    """
    sign = 1 if side == "long" else -1
    df = atr(chunked(bars, before=16, after=hold, span=span))
    df = df.withColumn("_next", F.collect_list(F.struct("high", "low")).over(ahead(W, hold - 1)))
    df = df.withColumns({
        "tb_barrier_tp": c("close") + sign * tp * c("atr_14"),
        "tb_barrier_sl": c("close") - sign * sl * c("atr_14"),
    })
    good, bad = ("high", "low") if sign > 0 else ("low", "high")
    reached = lambda x: (x[good] - c("tb_barrier_tp")) * sign >= 0
    stopped = lambda x: (x[bad] - c("tb_barrier_sl")) * sign <= 0
    df = df.withColumns({
        "_tp": F.array_position(F.transform("_next", reached), True),
        "_sl": F.array_position(F.transform("_next", stopped), True),
    })
    sl_first = (c("_sl") > 0) & ((c("_tp") == 0) | (c("_sl") <= c("_tp")))
    known = (c("atr_14") > 0) & (F.size("_next") == hold - 1)
    df = df.withColumns({
        "tb_label": F.when(known, F.when(sl_first, -1).when(c("_tp") > 0, 1).otherwise(0)),
        "tb_holding": F.when(known, F.when(sl_first, c("_sl")).when(c("_tp") > 0, c("_tp")).otherwise(hold)),
    })
    df = df.withColumn("tb_binary", F.when(c("tb_label").isNotNull(), flag(c("tb_label") == 1)))
    levels = {k: F.when(c("atr_14") > 0, c(k)) for k in ("tb_barrier_tp", "tb_barrier_sl")}
    return clean(df.withColumns(levels))


def volatility_target(bars: DataFrame, horizon: int = 8, sigmas: float = 3.0, span: Span = HOURLY) -> DataFrame:
    """Forward return in units of 24-bar volatility, winsorized at the series mean +- sigmas."""
    df = chunked(bars, before=26, after=horizon, span=span)
    df = df.withColumns({
        "_r": log_ratio("close", lag("close", 1, W)),
        "fwd_ret": log_ratio(lead("close", horizon, W), "close"),
    })
    df = df.withColumn("raw", div("fwd_ret", full(F.stddev_samp, "_r", 24, W, need=12) + 1e-10))
    df = clean(df)
    bounds = df.groupBy("symbol").agg(F.avg("raw").alias("_mu"), F.stddev_samp("raw").alias("_sd"))
    low, high = c("_mu") - sigmas * c("_sd"), c("_mu") + sigmas * c("_sd")
    capped = F.when(c("raw").isNotNull(), F.greatest(low, F.least(high, c("raw"))))
    return df.join(bounds, "symbol").withColumn("target", capped).drop("_mu", "_sd")


def excursions(bars: DataFrame, horizon: int = 24, span: Span = HOURLY) -> DataFrame:
    """Worst and best move (percent of close) over exactly the next ``horizon`` bars."""
    df = chunked(bars, after=horizon, span=span)
    frame = ahead(W, horizon)
    whole = F.count("close").over(frame) == horizon
    return clean(df.withColumns({
        "mae": F.when(whole, div(F.min("low").over(frame) - c("close"), "close") * 100),
        "mfe": F.when(whole, div(F.max("high").over(frame) - c("close"), "close") * 100),
    }))


def move_targets(bars: DataFrame, horizon: int = 8, big: float = 0.02, span: Span = HOURLY) -> DataFrame:
    """Forward return per unit of ATR, and whether the move is large in either direction."""
    df = atr(chunked(bars, before=16, after=horizon, span=span))
    df = df.withColumn("fwd_ret", div(lead("close", horizon, W), "close") - 1)
    return clean(df.withColumns({
        "vol_adjusted": div("fwd_ret", c("atr_pct") / 100 + 1e-10),
        "big_move": F.when(c("fwd_ret").isNotNull(), flag(F.abs("fwd_ret") > big)),
    }))


def sequences(df: DataFrame, columns: list, length: int = 24, span: Span = HOURLY) -> DataFrame:
    """The last ``length`` feature rows as one array per bar, only where all of them exist."""
    frame = W.rowsBetween(-(length - 1), 0)
    df = chunked(df, before=length, span=span)
    df = df.withColumn("sequence", F.collect_list(F.array(*columns)).over(frame))
    return clean(df.where(F.size("sequence") == length))

