"""Daily and intraday rule catalog: one engine, many (condition, entry, exit, direction, size) rows.

Conditions are SQL text over the daily feature frame, so users add rules without code. Columns:
st / drop_ previous streak and its depth in percent, vx previous volatility index and vchg its last
change, gap percent, dow (Monday 0), month, dom, td / tdl trading day of month and days left, rsi,
sma50, sma200, dist previous values, atr previous, atr_rank, vr previous volume ratio, week previous
week return, pc previous close, c1..c5 and o1 later closes and open, dow1..dow3 later weekdays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import c, div, flag
from barloom.operators import trades as T
from barloom.operators.chunks import DAILY, SharedWindow, bucket_of, chunked, clean, owned, prefix
from barloom.session import cut_lineage

W = SharedWindow()
MR = "st <= -3 AND vx < 25"
MW = "dow IN (0, 2) AND vx < 20"
CALM = "vx < 15"
SCORE = ("(CASE WHEN st <= -3 THEN 2 ELSE 0 END + CASE WHEN dow IN (0, 2) THEN 1 ELSE 0 END"
         " + CASE WHEN vx < 20 THEN 1 ELSE 0 END + CASE WHEN st <= -1 THEN 1 ELSE 0 END)")
SCORE9 = f"({SCORE} + CASE WHEN rsi < 40 THEN 1 ELSE 0 END + CASE WHEN close_prev > sma200 THEN 1 ELSE 0 END)"
DEPTH = "CASE WHEN drop_ >= 5 THEN 10 WHEN drop_ >= 3 THEN 7 ELSE 4 END"
DEPTH75 = "CASE WHEN drop_ >= 5 THEN 10 WHEN drop_ >= 3 THEN 7 ELSE 5 END"
UP200 = "close_prev > sma200"
BLACKOUT = "(month IN (1, 4, 7, 10) AND dom BETWEEN 10 AND 27)"
FOMC = "dow = 2 AND dom BETWEEN 14 AND 21 AND month IN (1, 3, 5, 6, 7, 9, 11, 12)"
CONVICTION = (f"(CASE WHEN {MR} THEN 3 ELSE 0 END + CASE WHEN {MW} THEN 1 ELSE 0 END + CASE WHEN {CALM} THEN 1 ELSE 0 END"
              " + CASE WHEN td <= 3 THEN 1 ELSE 0 END + CASE WHEN dow = 0 AND week < -0.01 THEN 1 ELSE 0 END"
              " + CASE WHEN st <= -3 AND gap < -0.3 THEN 1 ELSE 0 END)")
STACKED = (f"least(15, CASE WHEN {MR} THEN {DEPTH} ELSE 0 END + CASE WHEN {MW} THEN 3 ELSE 0 END + CASE WHEN {CALM} THEN 2 ELSE 0 END"
           " + CASE WHEN td <= 3 THEN 1 ELSE 0 END + CASE WHEN dow = 0 AND week < -0.01 THEN 1 ELSE 0 END"
           " + CASE WHEN st <= -3 AND gap < -0.3 THEN 2 ELSE 0 END)")


def stop_target_day(stop: str, target: str) -> str:
    """Exit price of a long day trade: stop first, then target, else the close."""
    return f"CASE WHEN low <= {stop} THEN {stop} WHEN high >= {target} THEN {target} ELSE close END"


# (rule, condition, entry, exit, direction, size percent)
DAILY_RULES = [
    ("S3", "open > 0", "open", "close", 1, "5"),
    ("S4", "st <= -3", "open", "close", 1, "5"),
    ("S4b", "st <= -2", "open", "close", 1, "5"),
    ("S5", "dow = 0", "open", "close", 1, "5"),
    ("S6", "dow = 2", "open", "close", 1, "5"),
    ("S7", MW, "open", "close", 1, "5"),
    ("S8", MR, "open", "close", 1, "5"),
    ("S8b", "st <= -3 AND vx < 30", "open", "c1", 1, "5"),
    ("S9", "gap > 0.5", "open", "close", -1, "5"),
    ("S9", "gap < -0.5", "open", "close", 1, "5"),
    ("S12", CALM, "open", "close", 1, "5"),
    ("S14", "open > 0", "close", "o1", 1, "5"),
    ("S16", "st <= -3", "open", "c2", 1, "5"),
    ("S19", "dow = 1", "close", "o1", 1, "5"),
    ("S20", f"{SCORE} >= 3", "open", "close", 1, "5"),
    ("S21", "gap > 0.3 AND vx < 15", "open", "close", 1, "5"),
    ("B1", MR, "open", "close", 1, "5"),
    ("B2", MW, "open", "close", 1, "5"),
    ("B3", CALM, "open", "close", 1, "5"),
    ("B4", f"{SCORE} >= 3", "open", "close", 1, "5"),
    ("E1a", f"{MR} AND {UP200}", "open", "close", 1, "5"),
    ("E1b", f"{MW} AND {UP200}", "open", "close", 1, "5"),
    ("E1c", f"{CALM} AND {UP200}", "open", "close", 1, "5"),
    ("E2a", f"{MR} AND rsi < 35", "open", "close", 1, "5"),
    ("E2b", "st <= -3 AND rsi < 40", "open", "close", 1, "5"),
    ("E2c", "rsi < 30", "open", "close", 1, "5"),
    ("E3", f"{MR} AND atr > 0", "open", stop_target_day("(open - 1.5 * atr)", "(open + 2.5 * atr)"), 1, "5"),
    ("E4_2", MR, "open", "coalesce(c2, c1, close)", 1, "5"),
    ("E4_3", MR, "open", "coalesce(c3, c2, c1, close)", 1, "5"),
    ("E4_5", MR, "open", "coalesce(c5, c4, c3, c2, c1, close)", 1, "5"),
    ("E6", "st <= -3", "open", "close", 1, DEPTH),
    ("E6b", MR, "open", "close", 1, DEPTH),
    ("E7a", f"{MW} AND (month >= 11 OR month <= 4)", "open", "close", 1, "5"),
    ("E7b", f"{CALM} AND (month >= 11 OR month <= 4)", "open", "close", 1, "5"),
    ("E8", MR, "open", "close", 1, "3"),
    ("E8", MW, "open", "close", 1, "3"),
    ("E8", CALM, "open", "close", 1, "2"),
    ("E9", f"{SCORE9} >= 3", "open", "close", 1, f"least(2 * {SCORE9}, 12)"),
    ("E13", f"{MR} AND {UP200} AND rsi < 45", "open", "close", 1, DEPTH75),
    ("E14a", f"{MR} AND sma50 > sma200", "open", "close", 1, "5"),
    ("E14b", f"{MW} AND sma50 > sma200", "open", "close", 1, "5"),
    ("E15", f"{MR} AND close > open", "close", "o1", 1, "5"),
    ("E16", f"{MR} AND {UP200}", "open", "c1", 1, "5"),
    ("E17", MR, "open", "close", 1, "8"),
    ("E17", MW, "open", "close", 1, "4"),
    ("E17", CALM, "open", "close", 1, "2"),
    ("E18", "dow = 4", "close", "CASE WHEN dow1 = 0 THEN c1 WHEN dow2 = 0 THEN c2 WHEN dow3 = 0 THEN c3 END", 1, "5"),
    ("E19", "vchg > 2", "open", "close", 1, "5"),
    ("E20a", "st <= -4", "open", "close", 1, "5"),
    ("E20b", "st <= -4 AND vx < 30", "open", "close", 1, "5"),
    ("E20c", "st <= -4 AND vx < 30", "open", "c1", 1, "5"),
    ("BASE", MR, "open", "close", 1, DEPTH),
    ("N1", FOMC, "open", "close", 1, "5"),
    ("N1b", FOMC, "o1", "c1", 1, "5"),
    ("N2", "td <= 3", "open", "close", 1, "4"),
    ("N2b", "td <= 3 AND vx < 20", "open", "close", 1, "4"),
    ("N3", "tdl <= 3", "open", "close", 1, "4"),
    ("N4", f"{MR} AND NOT {BLACKOUT}", "open", "close", 1, DEPTH),
    ("N5", "st <= -3 AND gap < -0.3", "open", "close", 1, DEPTH75),
    ("N5b", "st <= -3 AND gap < -0.3 AND vx < 30", "open", "close", 1, DEPTH75),
    ("N6", f"{MR} AND vr > 1.2", "open", "close", 1, DEPTH75),
    ("N6b", f"{MR} AND vr < 0.8", "open", "close", 1, DEPTH75),
    ("N7", "prev_mr = 1", "pc", "close", 1, "5"),
    ("N8", MR, "open", "close", 1, "CASE WHEN atr_rank < 0.3 THEN 8 WHEN atr_rank < 0.6 THEN 5 WHEN atr_rank >= 0.6 THEN 3 ELSE 5 END"),
    ("N9", f"{MR} AND {MW}", "open", "close", 1, "CASE WHEN drop_ >= 5 THEN 12 WHEN drop_ >= 3 THEN 10 ELSE 8 END"),
    ("N9", f"{MR} AND NOT ({MW})", "open", "close", 1, "CASE WHEN drop_ >= 5 THEN 7 WHEN drop_ >= 3 THEN 5 ELSE 4 END"),
    ("N9", f"{MW} AND NOT ({MR})", "open", "close", 1, "3"),
    ("N10_train", f"{MR} AND split = 'train'", "open", "close", 1, DEPTH),
    ("N10_test", f"{MR} AND split = 'test'", "open", "close", 1, DEPTH),
    ("N10b_train", f"{MW} AND split = 'train'", "open", "close", 1, "5"),
    ("N10b_test", f"{MW} AND split = 'test'", "open", "close", 1, "5"),
    ("N11", "dow = 3 AND st <= -2 AND dow1 = 4", "close", "c1", 1, "5"),
    ("N11b", "dow = 3 AND st <= -2 AND dow1 = 4 AND vx < 25", "close", "c1", 1, "5"),
    ("N12", "st <= -3 AND vx >= 20 AND vx < 25", "open", "close", 1, DEPTH75),
    ("N13", MR, "open", "close", 1, "CASE WHEN dist > 5 THEN 4 WHEN dist > 0 THEN 5 WHEN dist > -3 THEN 7 ELSE 3 END"),
    ("N14", "dow = 0 AND week < 0", "open", "close", 1, "5"),
    ("N14b", "dow = 0 AND week < 0 AND vx < 20", "open", "close", 1, "5"),
    ("N15", MR, "open", stop_target_day("(open * 0.995)", "(open * 1.015)"), 1, "5"),
    ("N15b", MR, "open", stop_target_day("(open * 0.99)", "(open * 1.02)"), 1, "5"),
    ("N16", f"{CONVICTION} >= 2", "open", "close", 1, STACKED),
]
# need ``term``, yesterday's slope from the index to its 3-month level
TERM_RULES = [
    ("E11a", "st <= -3 AND term > 0", "open", "close", 1, "5"),
    ("E11b", f"{MW} AND term > 0", "open", "close", 1, "5"),
]


def rule_frame(features: DataFrame, train_months: int = 48) -> DataFrame:
    """Daily feature frame under the short names the rule texts use."""
    from barloom.operators.splits import calendar_split
    df = calendar_split(features, train_months)
    prev_mr = flag((c("lag_streak") <= -3) & (c("lag_vix") < 25))
    term = c("term_prev") if "term_prev" in df.columns else F.lit(None).cast("double")
    return df.select(
        "symbol", "ts", "split", "open", "high", "low", "close", "gap", "dow", "month", "dom",
        c("prev_streak").alias("st"), F.abs("prev_drop").alias("drop_"), c("prev_vix").alias("vx"), c("prev_vix_change").alias("vchg"),
        c("trading_day").alias("td"), c("trading_days_left").alias("tdl"), c("prev_rsi").alias("rsi"), c("prev_sma50").alias("sma50"),
        c("prev_sma200").alias("sma200"), c("sma_distance").alias("dist"), c("prev_atr").alias("atr"), c("prev_atr_rank").alias("atr_rank"),
        c("prev_volume_ratio").alias("vr"), c("prev_week_ret").alias("week"), c("prev_close").alias("pc"), c("prev_close").alias("close_prev"),
        *[c(f"close_{k}").alias(f"c{k}") for k in (1, 2, 3, 4, 5)], c("open_1").alias("o1"),
        *[F.weekday(f"ts_{k}").alias(f"dow{k}") for k in (1, 2, 3)], prev_mr.alias("prev_mr"), term.alias("term"))


def rule_trades(frame: DataFrame, rules=DAILY_RULES, slip: float = 0.0001) -> DataFrame:
    """Every trade of every rule; rules are an exploded array of structs, the frame is read once."""
    options = [
        F.when(F.expr(cond), F.struct(
            F.lit(name).alias("rule"), F.lit(i).alias("leg"), F.lit(side).alias("side"), F.expr(entry).cast("double").alias("entry_price"),
            F.expr(exit_).cast("double").alias("exit_price"), F.expr(size).cast("double").alias("size")))
        for i, (name, cond, entry, exit_, side, size) in enumerate(rules)
    ]
    df = frame.select("symbol", "ts", F.explode(F.array_compact(F.array(*options))).alias("_t")).select("symbol", "ts", "_t.*")
    return net_returns(df.where("entry_price is not null and exit_price is not null"), slip)


def net_returns(df: DataFrame, slip: float = 0.0001) -> DataFrame:
    """Percent result of each trade with slippage on both fills."""
    s = c("side")
    paid, got = c("entry_price") * (1 + s * slip), c("exit_price") * (1 - s * slip)
    return df.withColumn("pnl_pct", div(s * (got - paid), paid) * 100)


def rule_equity(trades: DataFrame, capital: float = 25_000.0, key=("symbol", "rule"), order=("ts", "leg")) -> DataFrame:
    """Compounded equity, dollar result and drawdown after each trade of each rule."""
    df = trades.withColumn("_chunk", bucket_of("ts", DAILY.bucket_seconds * DAILY.width))
    df = df.withColumn("_growth", 1 + c("size") / 100 * c("pnl_pct") / 100)
    df = T.running_product(df, "_growth", "_g", key=key, order=order)
    df = df.withColumn("equity", capital * c("_g")).withColumn("pnl", c("equity") - div("equity", "_growth"))
    df = prefix(df, {"_peak": ("max", "equity")}, key=key, order=order)
    peak = F.greatest("_peak", F.lit(capital))
    return clean(df.withColumn("dd_pct", div(peak - c("equity"), peak) * 100))


def rule_stats(trades: DataFrame, key=("symbol", "rule"), order=("ts", "leg")) -> DataFrame:
    """Trades, win rate, profit factor, averages, t statistic and worst drawdown per rule."""
    won, lost = F.when(c("pnl_pct") > 0, c("pnl")), F.when(~(c("pnl_pct") > 0), c("pnl"))
    mean, std, n = F.avg("pnl_pct"), F.stddev_samp("pnl_pct"), F.count(F.lit(1))
    return trades.groupBy(*key).agg(
        n.alias("n_trades"), (F.avg(flag(c("pnl_pct") > 0)) * 100).alias("win_rate"), mean.alias("avg_pnl"),
        F.try_divide(F.sum(won), F.abs(F.sum(lost))).alias("profit_factor"), F.max("dd_pct").alias("max_dd"),
        F.max_by("equity", F.struct(*order)).alias("final_equity"), F.try_divide(mean, std / F.sqrt(n)).alias("t_stat"))


def viable(stats: DataFrame, min_trades: int = 20) -> DataFrame:
    """Rules with an edge; when none qualifies, all rules with enough trades, marked as fallback."""
    good = (c("profit_factor") > 1) & (c("avg_pnl") > 0) & (F.abs("t_stat") > 1.65) & (c("n_trades") > min_trades)
    hits = stats.where(good).withColumn("fallback", F.lit(False))
    none = stats.agg(F.max(flag(good))).scalar() == 0
    return hits.unionByName(stats.where((c("n_trades") > min_trades) & none).withColumn("fallback", F.lit(True)))


# --- sequential rules -----------------------------------------------------------------------

def kelly_sized(trades: DataFrame, warm_up: int = 10) -> DataFrame:
    """Size from the results of earlier trades of the same series: Kelly share within 2..15 percent."""
    df = trades.withColumn("_chunk", bucket_of("ts", DAILY.bucket_seconds * DAILY.width))
    won = c("pnl_pct") > 0
    df = prefix(df, {
        "_w": ("sum", F.when(won, 1.0).otherwise(0.0)), "_l": ("sum", F.when(won, 0.0).otherwise(1.0)),
        "_ws": ("sum", F.when(won, c("pnl_pct")).otherwise(0.0)), "_ls": ("sum", F.when(won, 0.0).otherwise(F.abs("pnl_pct"))),
    }, order=("ts",), inclusive=False)
    w, l = F.coalesce("_w", F.lit(0.0)), F.coalesce("_l", F.lit(0.0))  # noqa: E741
    rate = div(w, w + l)
    payoff = div(c("_ws") / F.greatest(w, F.lit(1.0)), c("_ls") / F.greatest(l, F.lit(1.0)))
    share = F.greatest(F.lit(0.02), F.least(rate - div(1 - rate, payoff), F.lit(0.15)))
    return clean(df.withColumn("size", F.when((w + l >= warm_up) & (payoff > 0), share * 100).when((w + l >= warm_up) & (c("_ls") > 0), 2.0).otherwise(5.0)))


def trailing_hold(daily: DataFrame, days: int = 5) -> DataFrame:
    """Exit of a long entered at each day's open: stop 1% below, then at half of the best gain, never on day 0."""
    df = chunked(daily, after=days, span=DAILY)
    df = df.withColumn("_days", F.collect_list(F.struct("high", "low", "close")).over(W.rowsBetween(0, days - 1)))
    state = F.struct(F.lit(0).alias("d"), c("open").alias("best"), (c("open") * 0.99).alias("stop"), F.lit(None).cast("double").alias("out"))

    def step(a, x):
        best = F.greatest(a["best"], x["high"])
        stop = F.when(x["high"] > a["best"], F.greatest(a["stop"], c("open") + 0.5 * (best - c("open")))).otherwise(a["stop"])
        hit = F.when((x["low"] <= stop) & (a["d"] > 0), stop)
        return F.when(a["out"].isNotNull(), a).otherwise(F.struct((a["d"] + 1).alias("d"), best.alias("best"), stop.alias("stop"), hit.alias("out")))

    df = df.withColumn("_x", F.aggregate("_days", state, step))
    return clean(df.withColumn("trail_exit", F.coalesce("_x.out", F.element_at("_days", -1)["close"])))


class _Pieces:
    """Effect of consecutive trades on (equity, peak) as a function of their ratio: piecewise constant factors.

    From ratio ``low`` of a piece up to the next one, equity is multiplied by ``gain`` and the peak becomes at least the first equity
    times ``top``. Every trade splits a piece at most at the ratio where the throttle sets in and where the peak is passed.
    """

    def __init__(self, full_size: float, small: float, limit: float):
        self.sizes, self.edge = (full_size / 100, small / 100), 1 - limit / 100
        self.low, self.gain, self.top = np.zeros(1), np.ones(1), np.zeros(1)

    def add(self, result: float) -> None:
        high = np.append(self.low[1:], np.inf)
        with np.errstate(divide="ignore"):
            cuts = np.stack([self.low, self.edge / self.gain, 1 / self.top])
        cuts = np.clip(cuts, self.low, np.minimum(high, 2.0))
        cuts.sort(axis=0)
        low, of = cuts.T.ravel(), np.repeat(np.arange(len(self.low)), 3)
        middle = (low + np.append(low[1:], 2.0)) / 2
        gain, top = self.gain[of], self.top[of]
        ratio = middle * gain / np.maximum(1.0, middle * top)
        gain = gain * (1 + np.where(ratio < self.edge, self.sizes[1], self.sizes[0]) * result / 100)
        top = np.maximum(top, gain)
        wide = low < np.append(low[1:], 2.0)
        low, gain, top = low[wide], gain[wide], top[wide]
        new = np.append(True, (gain[1:] != gain[:-1]) | (top[1:] != top[:-1]))
        self.low, self.gain, self.top = low[new], gain[new], top[new]


def throttled(trades: DataFrame, capital: float = 25_000.0, full_size: float = 5.0, small: float = 2.0, limit: float = 0.3,
              buckets: int = DAILY.bucket_seconds * DAILY.width) -> DataFrame:
    """Size each trade by the drawdown before it: ``small`` beyond ``limit`` percent, else ``full_size``; ``equity`` after it.

    The state is (equity, peak), and what a time chunk of trades does to it depends on their ratio alone. Every chunk is summed up as
    a table of pieces, these are chained along a series, and each chunk is gone through from its true state. ``trades`` is read
    twice: give a written table.
    """
    rows = trades.select("symbol", "ts", "pnl_pct").withColumn("_chunk", bucket_of("ts", buckets))

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        pieces = _Pieces(full_size, small, limit)
        for x in part.sort_values("ts")["pnl_pct"]:
            pieces.add(x)
        return pd.DataFrame({"symbol": part["symbol"].iloc[:1].values, "_chunk": part["_chunk"].iloc[:1].values,
                             "low": [pieces.low], "gain": [pieces.gain], "top": [pieces.top]})

    def chained(part: pd.DataFrame) -> pd.DataFrame:
        part, eq, peak, states = part.sort_values("_chunk"), capital, capital, []
        for low, gain, top in zip(part["low"], part["gain"], part["top"]):
            states.append((eq, peak))
            at = np.searchsorted(low, eq / peak, side="right") - 1
            eq, peak = eq * gain[at], max(peak, eq * top[at])
        return part[["symbol", "_chunk"]].assign(_eq=[s[0] for s in states], _peak=[s[1] for s in states])

    def gone_through(part: pd.DataFrame) -> pd.DataFrame:
        part, sizes, curve = part.sort_values("ts"), [], []
        eq, peak = part["_eq"].iloc[0], part["_peak"].iloc[0]
        for x in part["pnl_pct"]:
            sizes.append(small if (peak - eq) / peak * 100 > limit else full_size)
            eq *= 1 + sizes[-1] / 100 * x / 100
            peak = max(peak, eq)
            curve.append(eq)
        return part[["symbol", "ts", "pnl_pct"]].assign(size=sizes, equity=curve)

    tables = rows.groupBy("symbol", "_chunk").applyInPandas(summed, "symbol string, _chunk long, low array<double>, gain array<double>, top array<double>")
    states = tables.groupBy("symbol").applyInPandas(chained, "symbol string, _chunk long, _eq double, _peak double")
    return rows.join(states, ["symbol", "_chunk"]).groupBy("symbol", "_chunk").applyInPandas(
        gone_through, "symbol string, ts timestamp, pnl_pct double, size double, equity double")


def trailing_trades(frame: DataFrame, daily: DataFrame, days: int = 5) -> DataFrame:
    """Rule E10: mean reversion, left by the trailing stop of ``trailing_hold`` or after ``days`` days."""
    held = trailing_hold(daily, days).select("symbol", "ts", "trail_exit")
    return rule_trades(frame.where(MR).join(held, ["symbol", "ts"]), [("E10", MR, "open", "trail_exit", 1, "5")])


def red_runs(daily: DataFrame) -> DataFrame:
    """Candles in a row that closed below their open before each day, and the sum of their moves in percent."""
    red = c("close") < c("open")
    own = F.when(red, div(c("close") - c("open"), "open") * 100).otherwise(0.0)
    df = cut_lineage(prefix(owned(chunked(daily, span=DAILY)), {"_sum": ("sum", own)}))
    df = prefix(df, {"_calm": ("last", F.when(~red, F.struct(c("_rn").alias("rn"), c("_sum").alias("sum"))))}, inclusive=False)
    return df.select("symbol", "ts", (c("_rn") - 1 - F.coalesce(c("_calm.rn"), F.lit(-1))).alias("red_run"),
                     (c("_sum") - own - F.coalesce(c("_calm.sum"), F.lit(0.0))).alias("red_move"))


# --- intraday rules -------------------------------------------------------------------------

def intraday_prices(bars: DataFrame) -> DataFrame:
    """Per symbol and day: the prices the intraday rules trade at, from one conditional aggregation."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    first = lambda a, b: F.min_by("open", F.when((minute >= a) & (minute < b), c("ts")))
    last = lambda a, b: F.max_by("close", F.when((minute >= a) & (minute < b), c("ts")))
    return bars.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(
        first(540, 570).alias("pre_first"), last(540, 570).alias("pre_last"), last(565, 566).alias("at_925"),
        F.count_if((minute >= 540) & (minute < 570)).alias("pre_bars"), first(570, 600).alias("open_930"), first(570, 571).alias("bar_930"),
        last(570, 600).alias("at_10"), last(600, 630).alias("at_1030"), last(625, 636).alias("near_1030"), last(600, 660).alias("hour_10_close"),
        last(570, 630).alias("hour_end"), last(630, 960).alias("day_end"), last(900, 960).alias("at_15"),
        F.max(F.when((minute >= 570) & (minute < 585), c("high"))).alias("or_high"),
        F.min(F.when((minute >= 570) & (minute < 585), c("low"))).alias("or_low"),
        F.count_if((minute >= 570) & (minute < 585)).alias("or_bars"), F.count_if((minute >= 585) & (minute < 960)).alias("rest_bars"),
    ).withColumnRenamed("day", "ts")


INTRADAY_RULES = [
    ("S1", "pre_last > 0", "pre_last", "at_1030", 1, "5"),
    ("S2", "bar_930 > 0", "bar_930", "near_1030", 1, "5"),
    ("S10", "pre_bars > 1 AND pre_last > pre_first", "bar_930", "near_1030", 1, "5"),
    ("S10", "pre_bars > 1 AND pre_last <= pre_first", "bar_930", "near_1030", -1, "5"),
    ("S10b", "pre_bars > 1 AND pre_last > pre_first", "bar_930", "near_1030", -1, "5"),
    ("S10b", "pre_bars > 1 AND pre_last <= pre_first", "bar_930", "near_1030", 1, "5"),
    ("S11", "st <= -3", "at_925", "near_1030", 1, "5"),
    ("S15", MW, "open_930", "at_1030", 1, "5"),
    ("S17", "vx < 20", "open_930", "hour_10_close", 1, "5"),
    ("S18", "at_10 < open_930 * 0.997", "at_10", "day_end", 1, "5"),
    ("S22", "pre_last > 0", "pre_last", "day_end", 1, "5"),
    ("S23", "hour_end > open_930 * 1.005", "at_1030", "at_15", -1, "5"),
    ("S23", "hour_end < open_930 * 0.995", "at_1030", "at_15", 1, "5"),
    ("S24", "pre_last > pre_first", "pre_last", "at_1030", 1, "5"),
    ("S24", "pre_last < pre_first", "pre_last", "at_1030", -1, "5"),
]


def range_breaks(bars: DataFrame) -> DataFrame:
    """First break of the 9:30-9:45 range (up tested first within a bar), held to the day end."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    day = bars.withColumn("day", F.date_trunc("day", "ts"))
    prices = intraday_prices(bars).select("symbol", c("ts").alias("day"), "or_high", "or_low", "day_end", "or_bars", "rest_bars").where("or_bars > 1 and rest_bars > 4")
    rest = day.where((minute >= 585) & (minute < 960)).join(prices, ["symbol", "day"])
    side = F.when(c("high") > c("or_high"), 1).when(c("low") < c("or_low"), -1)
    broke = rest.withColumn("side", side).where("side is not null").groupBy("symbol", "day").agg(
        F.min_by(F.struct("side", "or_high", "or_low", "day_end"), "ts").alias("_b"))
    df = broke.select("symbol", c("day").alias("ts"), "_b.*").withColumn(
        "entry_price", F.when(c("side") > 0, c("or_high")).otherwise(c("or_low")))
    return net_returns(df.select("symbol", "ts", F.lit("S13").alias("rule"), F.lit(0).alias("leg"), "side", "entry_price",
                                 c("day_end").alias("exit_price"), F.lit(5.0).alias("size")).where("exit_price is not null"))


def bracket_trades(bars: DataFrame, hold: int = 30, stop: float = 0.3, target: float = 0.5) -> DataFrame:
    """Last bar before 9:30, both sides: stop and target in percent, at most ``hold`` bars (stop first)."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    df = cut_lineage(chunked(bars, after=hold))
    df = clean(T.with_future(df, hold).where((minute >= 540) & (minute < 570)).withColumnRenamed("_future", "later"))
    last = df.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.max_by(F.struct("ts", "close", "later"), "ts").alias("_b"))
    sides = F.explode(F.array(F.struct(F.lit("S25").alias("rule"), F.lit(1).alias("side")), F.struct(F.lit("S26").alias("rule"), F.lit(-1).alias("side"))))
    df = last.select("symbol", "_b.ts", c("_b.close").alias("entry_price"), c("_b.later").alias("_future"), sides.alias("_s")).select("*", "_s.*")
    df = df.withColumns({"atr_entry": c("entry_price") / 100, "tp_mult": F.lit(target), "sl_mult": F.lit(stop), "hold": F.size("_future"),
                         "exit_mode": F.lit("fixed"), "trail_mult": F.lit(1.0)})
    return net_returns(T.resolve_exits(df.where("hold > 0")).select(
        "symbol", "ts", "rule", F.lit(0).alias("leg"), "side", "entry_price", "exit_price", F.lit(5.0).alias("size"), "reason", "bars_held"))


# --- live daily score -----------------------------------------------------------------------

EDGES = [
    ("MEAN REVERSION", MR, DEPTH),
    ("MON/WED", MW, f"3 + CASE WHEN coalesce({UP200}, true) THEN 1 ELSE 0 END"),
    ("CALM MARKET", CALM, "2"),
    ("GAP DOWN BOUNCE", "st <= -3 AND gap < -0.3 AND vx < 30", "3"),
    ("MONTH-START FLOW", "td <= 3 AND vx < 20", "2"),
    ("VIX SWEET SPOT", f"st <= -3 AND vx >= 20 AND vx < 25 AND NOT ({MR})", "2"),
]


def edge_score(frame: DataFrame, runs: DataFrame) -> DataFrame:
    """Active edges, their reasons and total size per day; the streak is that of red candles (``red_runs``)."""
    frame = frame.join(runs, ["symbol", "ts"]).withColumns({"st": -c("red_run"), "drop_": F.abs("red_move")})
    hits = F.array_compact(F.array(*[
        F.when(F.expr(cond), F.struct(F.lit(name).alias("edge"), F.expr(size).cast("double").alias("size"))) for name, cond, size in EDGES]))
    df = frame.withColumn("_h", hits)
    return df.select("symbol", "ts", F.array_join(F.transform("_h", lambda h: h["edge"]), "|").alias("reasons"),
                     F.size("_h").alias("n_edges"), F.aggregate("_h", F.lit(0.0), lambda a, h: a + h["size"]).alias("total_size"))
