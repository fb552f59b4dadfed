"""Feature packs: each adds columns to a chunked bar frame and names the rows it looks back.

All packs use the one window of the frame, so a plan with many packs still has one shuffle and
one sort. ``reach(pack)`` is the halo the caller has to ask :func:`chunked` for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import (
    EPS, adjusted_kurtosis, adjusted_skew, c, clamp, div, flag, full, lag, log_ratio, past,
    percent_rank_last, roll, zscore,
)
from barloom.operators.chunks import HOURLY, SharedWindow, Span, chunked, clean, owned, prefix

LOOKBACK: dict = {}


def pack(rows: int):
    def mark(fn):
        LOOKBACK[fn.__name__] = rows
        return fn

    return mark


def build(bars: DataFrame, *packs, span: Span = HOURLY) -> DataFrame:
    """Chunk once with the largest halo, apply the packs, drop the halo."""
    df = chunked(bars, before=max([LOOKBACK[p.__name__] for p in packs] + [1]), span=span)
    for p in packs:
        df = p(df)
    return owned(df)


def features(bars: DataFrame, *packs, span: Span = HOURLY) -> DataFrame:
    return clean(build(bars, *packs, span=span))


W = SharedWindow()


def true_range() -> Column:
    before = lag("close", 1, W)
    return F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before))


# --- returns, calendar, candles -------------------------------------------------------------

@pack(25)
def returns(df):
    df = df.withColumns({f"ret_{k}": log_ratio("close", lag("close", k, W)) for k in (1, 4, 24)})
    df = df.withColumns({f"mom_{k}": div("close", lag("close", k, W)) - 1 for k in (3, 12)})
    df = df.withColumns({f"ret_lag_{k}": lag("ret_1", k, W) for k in (2, 3, 6, 12)})
    return df.withColumns({
        "momentum_10": c("close") - lag("close", 10, W),
        "roc_10": (div("close", lag("close", 10, W)) - 1) * 100,
        "volume_diff_24": c("volume") - lag("volume", 24, W),
    })


@pack(1)
def calendar(df):
    hour, day = F.hour("ts"), F.weekday("ts")
    turn = 2 * math.pi
    return df.withColumns({
        "hour": hour, "dow": day,
        "hour_sin": F.sin(hour * turn / 24), "hour_cos": F.cos(hour * turn / 24),
        "dow_sin": F.sin(day * turn / 7), "dow_cos": F.cos(day * turn / 7),
        "is_weekend": (day >= 5).cast("int"),
    })


ROUND_LEVELS = (100, 500, 1000, 5000, 10000)


def round_level_distance(price: Column) -> Column:
    """Distance to the nearest round level, percent of the price."""
    return div(F.least(*[F.least(price % n, n - price % n) for n in ROUND_LEVELS]), price) * 100


@pack(2)
def candles(df):
    span = c("high") - c("low")
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return df.withColumns({
        "hl_spread": div(span, "close"),
        "close_position": F.coalesce(div(c("close") - c("low"), span), F.lit(0.5)),
        "body_size": div(F.abs(c("close") - c("open")), "open"),
        "upper_shadow": div(c("high") - top, "open"),
        "lower_shadow": div(bottom - c("low"), "open"),
        "body_share": div(F.abs(c("close") - c("open")), span + EPS),
        "true_range": true_range(),
        "direction": F.signum(c("close") - c("open")).cast("int"),
        "up_volume": F.when(c("close") > c("open"), c("volume")).otherwise(0.0),
        "price_bucket": (F.floor(c("close") / 10) * 10).cast("bigint"),
        "round_distance": round_level_distance(c("close")),
    }).withColumns({
        "is_doji": flag(c("body_size") < 0.001),
        "near_round": flag(c("round_distance") < 0.5),
    })


# --- rolling --------------------------------------------------------------------------------

@pack(200)
def averages(df):
    df = df.withColumns({f"ma_{n}": full(F.avg, "close", n, W) for n in (10, 20, 50, 100, 200)})
    df = df.withColumns({f"price_vs_ma_{n}": div("close", f"ma_{n}") - 1 for n in (20, 50)})
    return df.withColumns({
        "above_ma_20": flag(c("close") > c("ma_20")),
        "above_ma_50": flag(c("close") > c("ma_50")),
        "ma_20_vs_50": div("ma_20", "ma_50") - 1,
    })


@pack(71)
def strategy_inputs(df):
    """What the rule signals read: averages, RSI, ATR, deviation and funding z-scores."""
    df = df.withColumns({f"ma_{n}": full(F.avg, "close", n, W) for n in (20, 50)})
    df = df.withColumn("_dev", c("close") - c("ma_20"))
    df = df.withColumn("dev_z", div("_dev", full(F.stddev_samp, "_dev", 20, W)))
    if "funding_rate" in df.columns:
        mean, spread = full(F.avg, "funding_rate", 30, W), full(F.stddev_samp, "funding_rate", 30, W)
        df = df.withColumn("funding_z_score", div(c("funding_rate") - mean, spread))
    else:
        df = df.withColumn("funding_z_score", F.lit(None).cast("double"))
    return atr(rsi(df)).drop("_dev")


@pack(80)
def scores(df):
    """Deterministic long and short scores from the z-score of 12-bar momentum."""
    df = df.withColumn("_m", log_ratio("close", lag("close", 12, W)))
    df = df.withColumn("_z", zscore("_m", 48, W))
    return df.withColumns({
        "long_prob": 1 / (1 + F.exp(-c("_z"))), "short_prob": 1 / (1 + F.exp(c("_z"))),
    }).drop("_m", "_z")


@pack(16)
def rsi(df, n: int = 14, x: str = "close", out: str = "rsi_14"):
    df = df.withColumn("_d", c(x) - lag(x, 1, W)).withColumns({
        "_gain": F.when(c("_d") > 0, c("_d")).when(c("_d").isNotNull(), 0.0),
        "_loss": F.when(c("_d") < 0, -c("_d")).when(c("_d").isNotNull(), 0.0),
    })
    gain, loss = full(F.avg, "_gain", n, W), full(F.avg, "_loss", n, W)
    df = df.withColumns({"_g": gain, "_s": loss})
    return df.withColumn(
        out,
        F.when(c("_s") > 0, 100 - 100 / (1 + c("_g") / c("_s"))).when(c("_g") > 0, 100.0),
    ).drop("_d", "_gain", "_loss", "_g", "_s")


@pack(16)
def atr(df, n: int = 14):
    df = df.withColumn("_tr", true_range())
    df = df.withColumn(f"atr_{n}", full(F.avg, "_tr", n, W)).drop("_tr")
    return df.withColumn("atr_pct", div(f"atr_{n}", "close") * 100)


@pack(169)
def volatility(df):
    df = df.withColumn("_r", log_ratio("close", lag("close", 1, W)))
    df = df.withColumn("_p", div("close", lag("close", 1, W)) - 1)
    return df.withColumns({
        "vol_24": full(F.stddev_samp, "_r", 24, W),
        "vol_168": full(F.stddev_samp, "_r", 168, W),
        "hist_vol": full(F.stddev_samp, "_p", 24, W) * math.sqrt(24),
    }).drop("_r", "_p")


@pack(720)
def zscores(df):
    return df.withColumns({
        "close_z_30": zscore("close", 30, W),
        "close_z_168_min24": zscore("close", 168, W, need=24),
        "volume_z_30_min1": zscore("volume", 30, W, need=1),
        "close_z_720_min24": zscore("close", 720, W, need=24),
    })


@pack(20)
def bollinger(df):
    df = df.withColumns({"bb_middle": full(F.avg, "close", 20, W), "bb_std": full(F.stddev_samp, "close", 20, W)})
    df = df.withColumns({
        "bb_upper": c("bb_middle") + 2 * c("bb_std"), "bb_lower": c("bb_middle") - 2 * c("bb_std"),
    })
    width = c("bb_upper") - c("bb_lower")
    return df.withColumns({
        "bb_width": div(width, "bb_middle"),
        "bb_position": div(c("close") - c("bb_lower"), width + EPS),
    })


@pack(72)
def volumes(df):
    df = df.withColumns({f"vol_ratio_{n}": div("volume", roll(F.avg, "volume", n, W) + EPS) for n in (4, 12, 24, 72)})
    df = df.withColumns({f"volume_ma_{n}": full(F.avg, "volume", n, W) for n in (20, 50)})
    df = df.withColumns({
        "volume_ratio": div("volume", "volume_ma_20"),
        "volume_sum_24": full(F.sum, "volume", 24, W),
    })
    return df.withColumn("volume_spike", flag(c("volume_ratio") > 2))


@pack(24)
def vwap(df):
    typical = (c("high") + c("low") + c("close")) / 3
    total = full(F.sum, "volume", 24, W)
    df = df.withColumns({
        "vwap": div(full(F.sum, c("close") * c("volume"), 24, W), total),
        "vwap_typical": div(full(F.sum, typical * c("volume"), 24, W), total),
    })
    return df.withColumn("price_vs_vwap", div(c("close") - c("vwap"), "vwap"))


def on_balance(bars: DataFrame, span: Span = HOURLY) -> DataFrame:
    """OBV and VPT from the start of each series, and OBV against its own 20-bar mean."""
    change = c("close") - lag("close", 1, W)
    df = owned(
        chunked(bars, before=1, span=span).withColumns({
            "_flow": F.coalesce(F.signum(change) * c("volume"), F.lit(0.0)),
            "_push": c("volume") * div(change, lag("close", 1, W)),
        })
    )
    df = prefix(df, {"obv": ("sum", "_flow"), "vpt": ("sum", "_push")}).drop("_chunk", "_rn")
    df = chunked(df, before=20, span=span).withColumn("obv_ma", full(F.avg, "obv", 20, W))
    return clean(df.withColumn("obv_trend", flag(c("obv") > c("obv_ma"))))


@pack(49)
def channels(df):
    df = df.withColumns({
        "high_4": full(F.max, "high", 4, W), "low_4": full(F.min, "low", 4, W),
        "high_24": full(F.max, "high", 24, W), "low_24": full(F.min, "low", 24, W),
        "_h50": full(F.max, "high", 50, W), "_l50": full(F.min, "low", 50, W),
        "swing_high": flag(full(F.max, "high", 5, W) == c("high")),
        "swing_low": flag(full(F.min, "low", 5, W) == c("low")),
    })
    return df.withColumns({
        "distance_from_high": div(c("close") - c("_h50"), "_h50"),
        "distance_from_low": div(c("close") - c("_l50"), "_l50"),
    }).drop("_h50", "_l50")


@pack(60)
def autocorrelation(df, n: int = 48):
    df = df.withColumn("_r", log_ratio("close", lag("close", 1, W)))
    df = df.withColumns({f"_r{k}": lag("_r", k, W) for k in (1, 5)})
    frame = past(W, n)
    var = full(F.var_samp, "_r", n, W)
    for k in (1, 5):
        pair = F.when(F.count(c("_r") + c(f"_r{k}")).over(frame) == n, F.covar_samp("_r", f"_r{k}").over(frame))
        df = df.withColumn(f"autocorr_{k}", div(pair, var + EPS))
    return df.drop("_r", "_r1", "_r5")


@pack(26)
def moments(df):
    df = df.withColumn("_r", log_ratio("close", lag("close", 1, W)))
    return df.withColumns({
        "realized_skew_24": adjusted_skew("_r", 24, W),
        "realized_kurt_24": adjusted_kurtosis("_r", 24, W),
    }).drop("_r")


@pack(24)
def garman_klass(df):
    hl, co = log_ratio("high", "low"), log_ratio("close", "open")
    day = F.lit(0.5) * hl * hl - F.lit(2 * math.log(2) - 1) * co * co
    mean = full(F.avg, day, 24, W)
    return df.withColumn("gk_volatility", F.when(mean >= 0, F.sqrt(mean)))


def every_fourth(x: Column, first: int) -> Column:
    """Keep rows first, first+4, ... of the series, as the sampled indicators do."""
    return F.when((c("_rn") >= first) & ((c("_rn") - first) % 4 == 0), x)


def _is(value: int):
    return lambda v: v == value


@pack(50)
def entropy_sampled(df, n: int = 48, bins: int = 10):
    df = df.withColumn("_r", log_ratio("close", lag("close", 1, W)))
    df = df.withColumn("_seen", F.collect_list("_r").over(W.rowsBetween(-n, -1)))
    low, high = F.array_min("_seen"), F.array_max("_seen")
    slot = lambda v: F.when(c("_hi") > c("_lo"),
                            F.least(F.lit(bins - 1), F.floor((v - c("_lo")) / (c("_hi") - c("_lo")) * bins)).cast("int")
                            ).otherwise(F.lit(0))
    df = df.withColumns({"_lo": low, "_hi": high, "_size": F.size("_seen")})
    df = df.withColumn("_slots", every_fourth(F.transform("_seen", slot), n))
    shares = [F.size(F.filter("_slots", _is(b))) / c("_size") for b in range(bins)]
    total = sum([F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in shares], F.lit(0.0))
    df = df.withColumn("_entropy", F.when((c("_size") >= 5) & c("_slots").isNotNull(), total))
    return df.drop("_r", "_seen", "_lo", "_hi", "_size", "_slots")


def return_entropy(bars: DataFrame, span: Span = HOURLY) -> DataFrame:
    df = build(bars, entropy_sampled, span=span)
    return clean(prefix(df, {"return_entropy_48": ("last", "_entropy")}))


@pack(101)
def hurst_sampled(df, n: int = 100, max_lag: int = 20):
    """Slope of ln(dispersion of lagged differences) on ln(lag), by OLS with constant weights."""
    lags = list(range(2, max_lag + 1))
    xs = [math.log(k) for k in lags]
    mean = sum(xs) / len(xs)
    spread = sum((x - mean) ** 2 for x in xs)
    df = df.withColumns({f"_d{k}": c("close") - lag("close", k, W) for k in lags})
    df = df.withColumns({f"_t{k}": F.stddev_pop(f"_d{k}").over(W.rowsBetween(-(n - k), -1)) for k in lags})
    slope = sum([F.ln(f"_t{k}") * F.lit((x - mean) / spread) for k, x in zip(lags, xs)], F.lit(0.0))
    df = df.withColumn("_hurst", every_fourth(slope, n))
    return df.drop(*[f"_{p}{k}" for k in lags for p in "dt"])


def hurst_exponent(bars: DataFrame, span: Span = HOURLY) -> DataFrame:
    df = build(bars, hurst_sampled, span=span)
    return clean(prefix(df, {"hurst_exp": ("last", "_hurst")}))


@pack(50)
def volume_clock(df, n: int = 24):
    df = df.withColumn("_r", log_ratio("close", lag("close", 1, W)))
    df = df.withColumn("_x", c("_r") * div("volume", roll(F.sum, "volume", n, W)))
    return df.withColumn("vol_clock_ret", full(F.sum, "_x", n, W)).drop("_r", "_x")


@pack(240)
def funding_features(df):
    fr = "funding_rate"
    df = df.withColumns({f"funding_cum_{n}": roll(F.sum, fr, n, W) for n in (8, 24, 72)})
    df = df.withColumn("_dfr", c(fr) - lag(fr, 1, W))
    return df.withColumns({
        "funding_mr": -zscore(fr, 168, W),
        "funding_oi_div": zscore(fr, 24, W) * zscore("open_interest", 24, W),
        "funding_accel": full(F.avg, "_dfr", 8, W),
        "funding_change_24": c(fr) - lag(fr, 24, W),
        "oi_change_24": c("open_interest") - lag("open_interest", 24, W),
        "funding_z_168_min24": zscore(fr, 168, W, need=24),
        "funding_positive_ratio": F.when(
            F.count(F.lit(1)).over(past(W, 24)) == 24,
            F.avg(flag(c(fr) > 0)).over(past(W, 24))),
        "funding_extreme": flag(F.abs(c(fr)) > full(lambda x: F.percentile(x, F.lit(0.95)), fr, 168, W)),
    }).drop("_dfr")


HORIZONS = (1, 4, 12, 24, 72, 168)


@pack(169)
def momentum(df):
    df = df.withColumns({f"mom_{k}h": log_ratio("close", lag("close", k, W)) for k in HORIZONS})
    agree = sum([flag(F.signum(f"mom_{k}h") == F.signum("mom_1h")) for k in HORIZONS], F.lit(0))
    return df.withColumn(
        "momentum_alignment", F.when(c("mom_1h").isNotNull(), agree / F.lit(float(len(HORIZONS)))))


@pack(15)
def acceleration(df, n: int = 12):
    df = df.withColumn("_r", log_ratio("close", lag("close", 1, W)))
    df = df.withColumn("_a", c("_r") - lag("_r", 1, W))
    return df.withColumn("price_accel", full(F.avg, "_a", n, W)).drop("_r", "_a")


@pack(48)
def breakout(df, n: int = 48):
    top, low = full(F.max, "high", n, W), full(F.min, "low", n, W)
    return df.withColumn("breakout_intensity", div(c("close") - (top + low) / 2, top - low + EPS))


@pack(26)
def imbalance(df, n: int = 24):
    df = df.withColumn("_s", F.signum(c("close") - lag("close", 1, W)))
    buy = roll(F.sum, F.when(c("_s") == 1, c("volume")).otherwise(0.0), n, W)
    sell = roll(F.sum, F.when(c("_s") == -1, c("volume")).otherwise(0.0), n, W)
    return df.withColumn("volume_imbalance_24", div(buy - sell, buy + sell + EPS)).drop("_s")


@pack(74)
def volatility_regime(df):
    df = df.withColumn("_r", log_ratio("close", lag("close", 1, W)))
    short, long = full(F.stddev_samp, "_r", 12, W), full(F.stddev_samp, "_r", 72, W)
    return df.withColumn("vol_regime_ratio", div(short, long + EPS)).drop("_r")


@pack(74)
def consistency(df):
    df = df.withColumn("_d", c("close") - lag("close", 1, W))
    df = df.withColumns({"_up": flag(c("_d") > 0), "_down": flag(c("_d") < 0)})
    for n in (24, 72):
        up, down = full(F.sum, "_up", n, W), full(F.sum, "_down", n, W)
        df = df.withColumn(f"trend_consistency_{n}", div(F.greatest(up, down), up + down + EPS))
    return df.drop("_d", "_up", "_down")


@pack(115)
def percentile_ranks(df):
    df = atr(df)
    return df.withColumn("atr_percentile", percent_rank_last("atr_14", 100, W)).withColumn(
        "high_volatility", flag(c("atr_percentile") > 0.7))


@pack(200)
def quantiles(df):
    df = df.withColumn("_v", F.abs(c("close") - c("open")))
    return df.withColumns({
        "move_q95": full(lambda x: F.percentile(x, F.lit(0.95)), "_v", 168, W),
    }).withColumn("extreme_move", flag(c("_v") > c("move_q95"))).drop("_v")


@pack(200)
def level_touches(df):
    df = df.withColumn("price_level", (F.floor(c("close") / 10) * 10).cast("bigint"))
    seen = F.collect_list("price_level").over(past(W, 200))
    return df.withColumn("level_touches", F.size(F.filter(seen, lambda v: v == c("price_level"))))


@pack(480)
def multi_timeframe(df):
    df = df.withColumns({
        "close_4h": full(F.avg, "close", 4, W), "close_1d": full(F.avg, "close", 24, W),
        "volume_1d": full(F.sum, "volume", 24, W),
        "ma_20_1h": full(F.avg, "close", 20, W), "ma_20_4h": full(F.avg, "close", 80, W),
        "ma_20_1d": full(F.avg, "close", 480, W),
    })
    above = sum([flag(c("close") > c(m)) for m in ("ma_20_1h", "ma_20_4h", "ma_20_1d")], F.lit(0))
    return df.withColumn("trend_alignment", above / F.lit(3.0))


@pack(20)
def cci_williams(df):
    df = df.withColumn("_tp", (c("high") + c("low") + c("close")) / 3)
    df = df.withColumns({"_list": F.collect_list("_tp").over(past(W, 20)), "_mean": full(F.avg, "_tp", 20, W)})
    spread = F.aggregate("_list", F.lit(0.0), lambda a, v: a + F.abs(v - c("_mean"))) / 20
    top, low = full(F.max, "high", 14, W), full(F.min, "low", 14, W)
    return df.withColumns({
        "cci": F.when(c("_mean").isNotNull(), F.coalesce(div(c("_tp") - c("_mean"), 0.015 * spread), F.lit(0.0))),
        "williams_r": div(top - c("close"), top - low) * -100,
    }).drop("_tp", "_list", "_mean")


@pack(121)
def book_proxies(df):
    """Order-book stand-ins from bars alone: spread, pressure, absorption, depth, liquidity."""
    before = lag("close", 1, W)
    df = df.withColumns({
        "ob_spread_pct": div(c("high") - c("low"), "close") * 100,
        "_vr": div("volume", full(F.avg, "volume", 20, W)),
        "_sign": F.signum(div("close", before) - 1),
        "ob_buy_volume_pct": clamp(div(c("close") - c("open"), c("high") - c("low") + EPS), 0.0, 1.0) * 100,
        "_top": full(F.max, "high", 20, W), "_low": full(F.min, "low", 20, W),
        "_near": flag(round_level_distance(c("close")) < 0.5),
    })
    df = df.withColumns({
        "ob_spread_ma5": full(F.avg, "ob_spread_pct", 5, W),
        "ob_spread_volatility": full(F.stddev_samp, "ob_spread_pct", 20, W),
        "ob_spread_regime": flag(percent_rank_last("ob_spread_pct", 100, W) > 0.7),
        "ob_imbalance_proxy": c("_sign") * c("_vr"),
        "ob_sell_volume_pct": 100 - c("ob_buy_volume_pct"),
        "ob_large_order_signal": flag((c("_vr") > 2) & (c("ob_spread_pct") < full(F.avg, "ob_spread_pct", 20, W))),
        "ob_distance_to_resistance": div(c("_top") - c("close"), "close") * 100,
        "ob_distance_to_support": div(c("close") - c("_low"), "close") * 100,
        "ob_liquidity_score": div("_vr", c("ob_spread_pct") + EPS),
        "ob_price_impact": div(F.abs(c("close") - c("open")), c("volume") + EPS),
        "_hi50": F.collect_list("high").over(W.rowsBetween(-50, -1)),
        "_lo50": F.collect_list("low").over(W.rowsBetween(-50, -1)),
        "_move": F.abs(c("close") - before),
    })
    near = lambda xs, level: F.size(F.filter(c(xs), lambda v: v.between(c(level) * 0.995, c(level) * 1.005)))
    return df.withColumns({
        "ob_volume_imbalance_ratio": div("ob_buy_volume_pct", c("ob_sell_volume_pct") + EPS),
        "ob_imbalance_ma5": full(F.avg, "ob_imbalance_proxy", 5, W),
        "ob_imbalance_ma10": full(F.avg, "ob_imbalance_proxy", 10, W),
        "ob_imbalance_ma20": full(F.avg, "ob_imbalance_proxy", 20, W),
        "ob_large_order_count": full(F.sum, "ob_large_order_signal", 10, W),
        "ob_resistance_touches": F.when(c("_rn") >= 20, near("_hi50", "_top")).otherwise(0),
        "ob_support_touches": F.when(c("_rn") >= 20, near("_lo50", "_low")).otherwise(0),
        "ob_round_level_volume_ma10": full(F.avg, c("volume") * c("_near"), 10, W),
        "ob_liquidity_ma20": full(F.avg, "ob_liquidity_score", 20, W),
        "ob_price_impact_ma20": full(F.avg, "ob_price_impact", 20, W),
        "ob_tick_intensity": full(F.sum, "_move", 10, W),
    }).withColumns({
        "ob_depth_strength": c("ob_resistance_touches") + c("ob_support_touches"),
        "ob_flow_strength": F.abs(c("ob_imbalance_ma5")) * c("_vr"),
        "ob_liquidity_regime": flag(percent_rank_last("ob_liquidity_score", 100, W) > 0.7),
    }).drop("_vr", "_sign", "_top", "_low", "_near", "_hi50", "_lo50", "_move")


@pack(170)
def regime_pack(df):
    """Inputs of the market-regime models."""
    df = df.withColumns({f"ret_{k}h": div("close", lag("close", k, W)) - 1 for k in (1, 4, 24, 168)})
    ma20, ma50 = full(F.avg, "close", 20, W), full(F.avg, "close", 50, W)
    df = df.withColumns({
        "vol_24h": full(F.stddev_samp, "ret_1h", 24, W), "vol_168h": full(F.stddev_samp, "ret_1h", 168, W),
        "ma_diff": div(ma20 - ma50, ma50), "price_vs_ma50": div(c("close") - ma50, ma50),
        "vol_change": div("volume", lag("volume", 24, W)) - 1,
        "vol_ma_ratio": div("volume", full(F.avg, "volume", 20, W)),
        "hl_range": div(c("high") - c("low"), "close"),
    })
    return rsi(df, out="rsi")


@pack(50)
def trend_regime(df):
    """Bull or bear if both the change over 24 bars and their least-squares slope (by the mean close) point that way."""
    frame = past(W, 24)
    whole = F.count("close").over(frame) == 24
    df = df.withColumns({
        "change_24": F.when(whole, div("close", F.first("close").over(frame)) - 1),
        "slope_24": F.when(whole, div(F.regr_slope(c("close"), c("_rn")).over(frame), F.avg("close").over(frame)))})
    return df.withColumn("trend", F.when((c("change_24") < -0.02) & (c("slope_24") < -0.0001), "bear").when(
        (c("change_24") > 0.02) & (c("slope_24") > 0.0001), "bull").otherwise("sideways"))


@pack(170)
def interactions(df):
    df = volatility_regime(garman_klass(imbalance(df)))
    df = df.withColumn("_r", log_ratio("close", lag("close", 1, W)))
    return df.withColumns({
        "vol_x_momentum": c("volume_imbalance_24") * full(F.sum, "_r", 12, W),
        "gk_x_vol_regime": c("gk_volatility") * c("vol_regime_ratio"),
        "gk_per_ratio": div("gk_volatility", F.abs(c("vol_regime_ratio")) + EPS),
    }).drop("_r")


ALPHA = (returns, averages, atr, volatility, bollinger, volumes, vwap, channels, autocorrelation, moments,
         garman_klass, volume_clock, momentum, acceleration, breakout, imbalance, volatility_regime, consistency)
