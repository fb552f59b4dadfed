"""Rolling feature queries on hourly bars."""

from __future__ import annotations

import math

from barloom.operators import features as X
from barloom.plans.registry import query, report
from barloom.plans.sqltext import P, cols, div, full, lag, lead, roll, sql  # noqa: F401
from barloom.sources import bars as B

EPS = "1e-10"
RET = ("r", f"SELECT *, ln(close / {lag('close')}) AS r FROM bars")


def packed(name, pack, base="bars", steps=(), body=None, ints="", nums="", keys="symbol"):
    """Register a feature pack: its columns, and the SELECT list that must give the same."""
    source = "out_"
    text = sql(base, *steps, (source, body), out=cols(source, keys=keys, ints=ints, nums=nums))

    @query(name, text)
    def run(spark, folder):
        bars = B.stored_bars(spark, folder)
        return report(X.features(bars, pack), "symbol", "ts", *[k for k in keys.split() if k != "symbol"],
                      *ints.split(), *nums.split())

    return run


def alias(pairs: dict, source="bars", extra="*") -> str:
    return f"SELECT {extra}, " + ", ".join(f"{e} AS {n}" for n, e in pairs.items()) + f" FROM {source}"


packed("returns_pack", X.returns, steps=[RET], body=alias({
    **{f"ret_{k}": f"ln(close / {lag('close', k)})" for k in (1, 4, 24)},
    **{f"mom_{k}": f"close / {lag('close', k)} - 1" for k in (3, 12)},
    **{f"ret_lag_{k}": lag("r", k) for k in (2, 3, 6, 12)},
    "momentum_10": f"close - {lag('close', 10)}",
    "roc_10": f"(close / {lag('close', 10)} - 1) * 100",
    "volume_diff_24": f"volume - {lag('volume', 24)}",
}, "r"), nums="ret_1 ret_4 ret_24 mom_3 mom_12 ret_lag_2 ret_lag_3 ret_lag_6 ret_lag_12 momentum_10 roc_10 volume_diff_24")

packed("calendar_pack", X.calendar, body=alias({
    "hour": "hour(ts)", "dow": "isodow(ts) - 1",
    "hour_sin": "sin(2 * pi() * hour(ts) / 24)", "hour_cos": "cos(2 * pi() * hour(ts) / 24)",
    "dow_sin": "sin(2 * pi() * (isodow(ts) - 1) / 7)", "dow_cos": "cos(2 * pi() * (isodow(ts) - 1) / 7)",
    "is_weekend": "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END",
}), ints="hour dow is_weekend", nums="hour_sin hour_cos dow_sin dow_cos")

ROUND = "least(" + ", ".join(f"close % {n}, {n} - close % {n}" for n in X.ROUND_LEVELS) + ") / close * 100"
TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
packed("candle_pack", X.candles, body=alias({
    "hl_spread": "(high - low) / close",
    "close_position": "coalesce((close - low) / nullif(high - low, 0), 0.5)",
    "body_size": "abs(close - open) / open",
    "upper_shadow": "(high - greatest(open, close)) / open",
    "lower_shadow": "(least(open, close) - low) / open",
    "body_share": "abs(close - open) / (high - low + 1e-10)",
    "true_range": TR,
    "direction": "sign(close - open)",
    "up_volume": "CASE WHEN close > open THEN volume ELSE 0 END",
    "price_bucket": "floor(close / 10) * 10",
    "round_distance": ROUND,
    "is_doji": "CASE WHEN abs(close - open) / open < 0.001 THEN 1 ELSE 0 END",
    "near_round": f"CASE WHEN {ROUND} < 0.5 THEN 1 ELSE 0 END",
}), ints="direction price_bucket is_doji near_round",
    nums="hl_spread close_position body_size upper_shadow lower_shadow body_share true_range up_volume round_distance")

packed("sma_pack", X.averages, steps=[("m", alias({f"ma_{n}": full("avg", "close", n) for n in (10, 20, 50, 100, 200)}))],
       body=alias({
           "price_vs_ma_20": "close / ma_20 - 1", "price_vs_ma_50": "close / ma_50 - 1",
           "above_ma_20": "coalesce(close > ma_20, false)::INT", "above_ma_50": "coalesce(close > ma_50, false)::INT",
           "ma_20_vs_50": "ma_20 / ma_50 - 1"}, "m"),
       ints="above_ma_20 above_ma_50",
       nums="ma_10 ma_20 ma_50 ma_100 ma_200 price_vs_ma_20 price_vs_ma_50 ma_20_vs_50")

DIFF = ("d", f"SELECT *, close - {lag('close')} AS d FROM bars")
GAIN = "CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END"
LOSS = "CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END"
RSI_STEPS = [DIFF, ("gl", f"SELECT *, {GAIN} AS gain, {LOSS} AS loss FROM d"),
             ("avgs", alias({"ag": full("avg", "gain", 14), "al": full("avg", "loss", 14)}, "gl"))]
RSI = "CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) WHEN ag > 0 THEN 100 END"
packed("rsi_14", X.rsi, steps=RSI_STEPS, body=alias({"rsi_14": RSI}, "avgs"), nums="rsi_14")

TRS = ("tr", alias({"tr": TR}))
packed("atr_14", X.atr, steps=[TRS], body=alias({
    "atr_14": full("avg", "tr", 14), "atr_pct": f"{full('avg', 'tr', 14)} / close * 100"}, "tr"), nums="atr_14 atr_pct")

RP = ("rp", f"SELECT *, ln(close / {lag('close')}) AS r, close / {lag('close')} - 1 AS p FROM bars")
packed("volatility_pack", X.volatility, steps=[RP], body=alias({
    "vol_24": full("stddev_samp", "r", 24), "vol_168": full("stddev_samp", "r", 168),
    "hist_vol": f"{full('stddev_samp', 'p', 24)} * sqrt(24)"}, "rp"), nums="vol_24 vol_168 hist_vol")


def z(x, n, need=None):
    return f"(({x} - {full('avg', x, n, need)}) / ({full('stddev_samp', x, n, need)} + {EPS}))"


packed("zscore_pack", X.zscores, body=alias({
    "close_z_30": z("close", 30), "close_z_168_min24": z("close", 168, 24),
    "volume_z_30_min1": z("volume", 30, 1), "close_z_720_min24": z("close", 720, 24)}),
    nums="close_z_30 close_z_168_min24 volume_z_30_min1 close_z_720_min24")

packed("bollinger", X.bollinger, steps=[("m", alias({
    "bb_middle": full("avg", "close", 20), "bb_std": full("stddev_samp", "close", 20)}))],
    body=alias({"bb_upper": "bb_middle + 2 * bb_std", "bb_lower": "bb_middle - 2 * bb_std",
                "bb_width": "4 * bb_std / bb_middle",
                "bb_position": "(close - (bb_middle - 2 * bb_std)) / (4 * bb_std + 1e-10)"}, "m"),
    nums="bb_middle bb_std bb_upper bb_lower bb_width bb_position")

packed("volume_pack", X.volumes, body=alias({
    **{f"vol_ratio_{n}": f"volume / ({roll('avg', 'volume', n)} + 1e-10)" for n in (4, 12, 24, 72)},
    "volume_ma_20": full("avg", "volume", 20), "volume_ma_50": full("avg", "volume", 50),
    "volume_ratio": div("volume", full("avg", "volume", 20)), "volume_sum_24": full("sum", "volume", 24),
    "volume_spike": f"coalesce({div('volume', full('avg', 'volume', 20))} > 2, false)::INT"}),
    ints="volume_spike",
    nums="vol_ratio_4 vol_ratio_12 vol_ratio_24 vol_ratio_72 volume_ma_20 volume_ma_50 volume_ratio volume_sum_24")

PV = ("pv", "SELECT *, close * volume AS pv, (high + low + close) / 3 * volume AS tv FROM bars")
packed("vwap_24", X.vwap, steps=[PV, ("v", alias({
    "vwap": div(full("sum", "pv", 24), full("sum", "volume", 24)),
    "vwap_typical": div(full("sum", "tv", 24), full("sum", "volume", 24))}, "pv"))],
    body=alias({"price_vs_vwap": "(close - vwap) / vwap"}, "v"), nums="vwap vwap_typical price_vs_vwap")

packed("channels", X.channels, steps=[("h", alias({
    "high_4": full("max", "high", 4), "low_4": full("min", "low", 4), "high_24": full("max", "high", 24),
    "low_24": full("min", "low", 24), "hh": full("max", "high", 50), "ll": full("min", "low", 50),
    "h5": full("max", "high", 5), "l5": full("min", "low", 5)}))],
    body=alias({"swing_high": "coalesce(h5 = high, false)::INT", "swing_low": "coalesce(l5 = low, false)::INT",
                "distance_from_high": "(close - hh) / hh", "distance_from_low": "(close - ll) / ll"}, "h"),
    ints="swing_high swing_low", nums="high_4 low_4 high_24 low_24 distance_from_high distance_from_low")


@query("obv_vpt", sql("bars", ("f", f"""SELECT *, coalesce(sign(close - {lag('close')}) * volume, 0) AS flow,
  volume * ((close - {lag('close')}) / {lag('close')}) AS push FROM bars"""),
    ("o", f"SELECT *, sum(flow) OVER ({P}) AS obv, sum(push) OVER ({P}) AS vpt FROM f"),
    ("out_", alias({"obv_ma": full("avg", "obv", 20), "obv_trend": f"coalesce(obv > {full('avg', 'obv', 20)}, false)::INT"}, "o")),
    out=cols("out_", ints="obv_trend", nums="obv vpt:2 obv_ma")))
def obv_vpt(spark, folder):
    return report(X.on_balance(B.stored_bars(spark, folder)), "symbol", "ts", "obv_trend", "obv", "vpt:2", "obv_ma")


FR48 = f"OVER ({P} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)"
packed("autocorr", X.autocorrelation, steps=[RET, ("l", alias({"r1": lag("r", 1), "r5": lag("r", 5)}, "r"))],
       body=alias({f"autocorr_{k}": f"(CASE WHEN count(r + r{k}) {FR48} = 48 THEN covar_samp(r, r{k}) {FR48} END)"
                   f" / ({full('var_samp', 'r', 48)} + 1e-10)" for k in (1, 5)}, "l"), nums="autocorr_1 autocorr_5")

packed("skew_kurt", X.moments, steps=[RET], body=alias({
    "realized_skew_24": full("skewness", "r", 24), "realized_kurt_24": full("kurtosis", "r", 24)}, "r"),
    nums="realized_skew_24 realized_kurt_24")

GK = ("g", f"SELECT *, 0.5 * ln(high / low) ^ 2 - {2 * math.log(2) - 1} * ln(close / open) ^ 2 AS g FROM bars")
packed("garman_klass", X.garman_klass, steps=[GK], body=alias({
    "gk_volatility": f"CASE WHEN {full('avg', 'g', 24)} >= 0 THEN sqrt(greatest({full('avg', 'g', 24)}, 0)) END"}, "g"),
    nums="gk_volatility")

packed("volume_clock", X.volume_clock, steps=[RET, ("x", alias({"x": f"r * ({div('volume', roll('sum', 'volume', 24))})"}, "r"))],
       body=alias({"vol_clock_ret": full("sum", "x", 24)}, "x"), nums="vol_clock_ret")

MOM = ("m", alias({f"mom_{k}h": f"ln(close / {lag('close', k)})" for k in X.HORIZONS}))
packed("momentum_alignment", X.momentum, steps=[MOM], body=alias({
    "momentum_alignment": "CASE WHEN mom_1h IS NOT NULL THEN (" + " + ".join(
        f"coalesce(sign(mom_{k}h) = sign(mom_1h), false)::INT" for k in X.HORIZONS) + ") / 6.0 END"}, "m"),
    nums=" ".join(f"mom_{k}h" for k in X.HORIZONS) + " momentum_alignment")

packed("price_accel", X.acceleration, steps=[RET, ("a", alias({"a": f"r - {lag('r')}"}, "r"))],
       body=alias({"price_accel": full("avg", "a", 12)}, "a"), nums="price_accel")

packed("breakout", X.breakout, steps=[("h", alias({"hh": full("max", "high", 48), "ll": full("min", "low", 48)}))],
       body=alias({"breakout_intensity": "(close - (hh + ll) / 2) / (hh - ll + 1e-10)"}, "h"), nums="breakout_intensity")

IMB = [("s", alias({"s": f"sign(close - {lag('close')})"})),
       ("bs", alias({"bv": roll("sum", "CASE WHEN s = 1 THEN volume ELSE 0 END", 24),
                     "sv": roll("sum", "CASE WHEN s = -1 THEN volume ELSE 0 END", 24)}, "s"))]
packed("imbalance", X.imbalance, steps=IMB, body=alias({"volume_imbalance_24": "(bv - sv) / (bv + sv + 1e-10)"}, "bs"),
       nums="volume_imbalance_24")

packed("vol_regime_ratio", X.volatility_regime, steps=[RET], body=alias({
    "vol_regime_ratio": f"{full('stddev_samp', 'r', 12)} / ({full('stddev_samp', 'r', 72)} + 1e-10)"}, "r"),
    nums="vol_regime_ratio")

UD = ("u", alias({"up": "coalesce(d > 0, false)::INT", "dn": "coalesce(d < 0, false)::INT"}, "d"))
packed("trend_consistency", X.consistency, steps=[DIFF, UD], body=alias({
    f"trend_consistency_{n}": f"greatest({full('sum', 'up', n)}, {full('sum', 'dn', n)}) / "
    f"({full('sum', 'up', n)} + {full('sum', 'dn', n)} + 1e-10)" for n in (24, 72)}, "u"),
    nums="trend_consistency_24 trend_consistency_72")


def prank(x, n, source_list):
    return (f"(CASE WHEN len({source_list}) = {n} THEN (len(list_filter({source_list}, lambda v: v < {x})) + "
            f"(len(list_filter({source_list}, lambda v: v = {x})) + 1) / 2.0) / {n} END)")


def listed(x, n):
    return f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER ({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


packed("pct_rank_100", X.percentile_ranks, steps=[TRS, ("a", alias({"atr_14": full("avg", "tr", 14)}, "tr")),
                                                  ("l", alias({"vals": listed("atr_14", 100)}, "a")),
                                                  ("p", alias({"atr_percentile": prank("atr_14", 100, "vals")}, "l"))],
       body=alias({"high_volatility": "coalesce(atr_percentile > 0.7, false)::INT"}, "p"),
       ints="high_volatility", nums="atr_14 atr_percentile")

packed("rolling_q95", X.quantiles, steps=[("v", alias({"v": "abs(close - open)"})), ("q", alias({
    "move_q95": f"CASE WHEN {roll('count', 'v', 168)} >= 168 THEN quantile_cont(v, 0.95) OVER ({P} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) END"}, "v"))],
    body=alias({"extreme_move": "coalesce(v > move_q95, false)::INT"}, "q"), ints="extreme_move", nums="move_q95")

packed("level_touches", X.level_touches, steps=[("v", alias({"price_level": "CAST(floor(close / 10) * 10 AS BIGINT)"})),
                                                ("l", alias({"vals": listed("price_level", 200)}, "v"))],
       body=alias({"level_touches": "len(list_filter(vals, lambda v: v = price_level))"}, "l"), ints="price_level level_touches")

packed("multi_timeframe", X.multi_timeframe, steps=[("m", alias({
    "close_4h": full("avg", "close", 4), "close_1d": full("avg", "close", 24), "volume_1d": full("sum", "volume", 24),
    "ma_20_1h": full("avg", "close", 20), "ma_20_4h": full("avg", "close", 80), "ma_20_1d": full("avg", "close", 480)}))],
    body=alias({"trend_alignment": "(" + " + ".join(
        f"coalesce(close > {m}, false)::INT" for m in ("ma_20_1h", "ma_20_4h", "ma_20_1d")) + ") / 3.0"}, "m"),
    nums="close_4h close_1d volume_1d ma_20_1h:8 ma_20_4h:8 ma_20_1d:8 trend_alignment")

packed("cci_willr", X.cci_williams, steps=[
    ("t", alias({"tp": "(high + low + close) / 3"})),
    ("l", alias({"vals": listed("tp", 20), "mean": full("avg", "tp", 20),
                 "hh": full("max", "high", 14), "ll": full("min", "low", 14)}, "t"))],
    body=alias({"cci": "CASE WHEN mean IS NOT NULL THEN coalesce((tp - mean) / nullif(0.015 * list_sum(list_transform(vals, lambda v: abs(v - mean))) / 20, 0), 0) END",
                "williams_r": f"{div('hh - close', 'hh - ll')} * -100"}, "l"), nums="cci williams_r")

OB1 = ("o1", alias({
    "ob_spread_pct": "(high - low) / close * 100", "vr": div("volume", full("avg", "volume", 20)),
    "sg": f"sign(close / {lag('close')} - 1)",
    "ob_buy_volume_pct": "greatest(0, least(1, (close - open) / (high - low + 1e-10))) * 100",
    "tp": full("max", "high", 20), "lw": full("min", "low", 20), "near": f"({ROUND} < 0.5)::INT",
    "move": f"abs(close - {lag('close')})",
    "h50": f"list(high) OVER ({P} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)",
    "l50": f"list(low) OVER ({P} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)",
    "rn": f"row_number() OVER ({P}) - 1"}))
OB2 = ("o2", alias({
    "ob_spread_ma5": full("avg", "ob_spread_pct", 5), "ob_spread_volatility": full("stddev_samp", "ob_spread_pct", 20),
    "spl": listed("ob_spread_pct", 100), "ob_imbalance_proxy": "sg * vr", "ob_sell_volume_pct": "100 - ob_buy_volume_pct",
    "ob_large_order_signal": f"coalesce(vr > 2 AND ob_spread_pct < {full('avg', 'ob_spread_pct', 20)}, false)::INT",
    "ob_distance_to_resistance": "(tp - close) / close * 100", "ob_distance_to_support": "(close - lw) / close * 100",
    "ob_liquidity_score": "vr / (ob_spread_pct + 1e-10)", "ob_price_impact": "abs(close - open) / (volume + 1e-10)"}, "o1"))
OB3 = ("o3", alias({
    "ob_spread_regime": f"coalesce({prank('ob_spread_pct', 100, 'spl')} > 0.7, false)::INT",
    "ob_volume_imbalance_ratio": "ob_buy_volume_pct / (ob_sell_volume_pct + 1e-10)",
    **{f"ob_imbalance_ma{n}": full("avg", "ob_imbalance_proxy", n) for n in (5, 10, 20)},
    "ob_large_order_count": full("sum", "ob_large_order_signal", 10),
    "ob_resistance_touches": "CASE WHEN rn >= 20 THEN len(list_filter(h50, lambda v: v BETWEEN tp * 0.995 AND tp * 1.005)) ELSE 0 END",
    "ob_support_touches": "CASE WHEN rn >= 20 THEN len(list_filter(l50, lambda v: v BETWEEN lw * 0.995 AND lw * 1.005)) ELSE 0 END",
    "ob_round_level_volume_ma10": full("avg", "volume * near", 10), "ob_liquidity_ma20": full("avg", "ob_liquidity_score", 20),
    "ob_price_impact_ma20": full("avg", "ob_price_impact", 20), "ob_tick_intensity": full("sum", "move", 10),
    "lql": listed("ob_liquidity_score", 100)}, "o2"))
packed("book_proxies", X.book_proxies, steps=[OB1, OB2, OB3], body=alias({
    "ob_depth_strength": "ob_resistance_touches + ob_support_touches", "ob_flow_strength": "abs(ob_imbalance_ma5) * vr",
    "ob_liquidity_regime": f"coalesce({prank('ob_liquidity_score', 100, 'lql')} > 0.7, false)::INT"}, "o3"),
    ints="ob_spread_regime ob_large_order_signal ob_large_order_count ob_resistance_touches ob_support_touches ob_depth_strength ob_liquidity_regime",
    nums="ob_spread_pct ob_spread_ma5 ob_spread_volatility ob_imbalance_proxy ob_imbalance_ma5 ob_imbalance_ma10 ob_imbalance_ma20 "
         "ob_buy_volume_pct ob_sell_volume_pct ob_distance_to_resistance ob_distance_to_support ob_round_level_volume_ma10 "
         "ob_liquidity_ma20:1 ob_price_impact_ma20 ob_tick_intensity ob_flow_strength")

RG = ("rg", alias({**{f"ret_{k}h": f"close / {lag('close', k)} - 1" for k in (1, 4, 24, 168)},
                   "m20": full("avg", "close", 20), "m50": full("avg", "close", 50), "v20": full("avg", "volume", 20),
                   "v24": lag("volume", 24), "rsi": RSI}, "avgs"))
packed("regime_pack", X.regime_pack, steps=[*RSI_STEPS, RG], body=alias({
    "vol_24h": full("stddev_samp", "ret_1h", 24), "vol_168h": full("stddev_samp", "ret_1h", 168),
    "ma_diff": "(m20 - m50) / m50", "price_vs_ma50": "(close - m50) / m50", "vol_change": "volume / nullif(v24, 0) - 1",
    "vol_ma_ratio": "volume / nullif(v20, 0)", "hl_range": "(high - low) / close"}, "rg"),
    nums="ret_1h ret_4h ret_24h ret_168h vol_24h vol_168h ma_diff price_vs_ma50 vol_change vol_ma_ratio hl_range rsi")

packed("trend_regime", X.trend_regime, keys="symbol trend", steps=[
    ("n", alias({"rn": f"row_number() OVER ({P}) - 1"})),
    ("s", f"SELECT *, CASE WHEN count(close) OVER w = 24 THEN close / first_value(close) OVER w - 1 END AS change_24, CASE WHEN count(close) OVER w = 24 THEN regr_slope(close, rn) OVER w / avg(close) OVER w END AS slope_24 FROM n WINDOW w AS ({P} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)")],
    body=alias({"trend": "CASE WHEN change_24 < -0.02 AND slope_24 < -0.0001 THEN 'bear' WHEN change_24 > 0.02 AND slope_24 > 0.0001 THEN 'bull' ELSE 'sideways' END"}, "s"),
    nums="change_24 slope_24")

packed("interactions", X.interactions, steps=[*IMB, ("rr", f"SELECT *, ln(close / {lag('close')}) AS r, 0.5 * ln(high / low) ^ 2 - {2 * math.log(2) - 1} * ln(close / open) ^ 2 AS g FROM bs"),
    ("i", alias({"imb": "(bv - sv) / (bv + sv + 1e-10)", "gm": full("avg", "g", 24),
                 "vrr": f"{full('stddev_samp', 'r', 12)} / ({full('stddev_samp', 'r', 72)} + 1e-10)", "r12": full("sum", "r", 12)}, "rr")),
    ("gg", alias({"gkv": "CASE WHEN gm >= 0 THEN sqrt(greatest(gm, 0)) END"}, "i"))],
    body=alias({"vol_x_momentum": "imb * r12", "gk_x_vol_regime": "gkv * vrr", "gk_per_ratio": "gkv / (abs(vrr) + 1e-10)"}, "gg"),
    nums="vol_x_momentum gk_x_vol_regime gk_per_ratio")

ENT = [RET, ("e", alias({"vals": f"list(r) FILTER (WHERE r IS NOT NULL) OVER ({P} ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)",
                         "rn": f"row_number() OVER ({P}) - 1"}, "r")),
       ("b", """SELECT *, CASE WHEN rn >= 48 AND (rn - 48) % 4 = 0 AND len(vals) >= 5 THEN
  list_transform(vals, lambda v: CASE WHEN list_max(vals) > list_min(vals) THEN
    least(9, floor((v - list_min(vals)) / (list_max(vals) - list_min(vals)) * 10)) ELSE 0 END) END AS slots FROM e"""),
       ("h", """SELECT *, CASE WHEN slots IS NOT NULL THEN -list_sum(list_transform(range(0, 10), lambda k:
  CASE WHEN len(list_filter(slots, lambda s: s = k)) > 0 THEN len(list_filter(slots, lambda s: s = k)) / len(slots)
    * log2(len(list_filter(slots, lambda s: s = k)) / len(slots)) ELSE 0 END)) END AS ent FROM b"""),
       ("out_", f"SELECT *, last_value(ent IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS return_entropy_48 FROM h")]


@query("entropy_48", sql("bars", *ENT, out=cols("out_", nums="return_entropy_48")))
def entropy_48(spark, folder):
    return report(X.return_entropy(B.stored_bars(spark, folder)), "symbol", "ts", "return_entropy_48")


_L = list(range(2, 21))
_x = [math.log(k) for k in _L]
_m = sum(_x) / len(_x)
_s = sum((v - _m) ** 2 for v in _x)
HUR = [("n", alias({"rn": f"row_number() OVER ({P}) - 1", **{f"d{k}": f"close - {lag('close', k)}" for k in _L}})),
       ("t", alias({f"t{k}": f"stddev_pop(d{k}) OVER ({P} ROWS BETWEEN {100 - k} PRECEDING AND 1 PRECEDING)" for k in _L}, "n")),
       ("h", alias({"hv": "CASE WHEN rn >= 100 AND (rn - 100) % 4 = 0 AND least(" + ", ".join(f"t{k}" for k in _L) + ") > 0 THEN "
                    + " + ".join(f"ln(t{k}) * {(v - _m) / _s!r}" for k, v in zip(_L, _x)) + " END"}, "t")),
       ("out_", f"SELECT *, last_value(hv IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hurst_exp FROM h")]


@query("hurst_100", sql("bars", *HUR, out=cols("out_", nums="hurst_exp")))
def hurst_100(spark, folder):
    return report(X.hurst_exponent(B.stored_bars(spark, folder)), "symbol", "ts", "hurst_exp")
