"""Rule and score signals as column expressions; a missing input never fires a rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.rolling import c, flag, sigmoid


def side(up: Column, down: Column) -> Column:
    """+1, -1 or 0; the later rule wins when both hold, missing counts as not holding."""
    return F.when(F.coalesce(down, F.lit(False)), -1).when(F.coalesce(up, F.lit(False)), 1).otherwise(0)


def ma_trend() -> Column:
    return flag((c("close") > c("ma_50")) & (c("ma_20") > c("ma_50")))


def rsi_momentum(low: float = 30, high: float = 70) -> Column:
    return side((c("rsi_14") < low) & (c("close") > c("ma_50")), (c("rsi_14") > high) & (c("close") < c("ma_50")))


def mean_reversion(z: float = 2.0) -> Column:
    return side(c("dev_z") < -z, c("dev_z") > z)


def volatility_breakout(mult: float = 2.0) -> Column:
    return side(c("close") > c("ma_20") + mult * c("atr_14"), c("close") < c("ma_20") - mult * c("atr_14"))


def funding_contrarian(threshold: float = 1.5) -> Column:
    z = c("funding_z_score")
    return side(z < -threshold, z > threshold)


def weighted_vote(cut: float = 0.5) -> Column:
    """Trend 0.4, momentum 0.4, funding 0.2."""
    score = 0.4 * ma_trend() + 0.4 * rsi_momentum() + 0.2 * funding_contrarian()
    return F.when(score > cut, 1).when(score < -cut, -1).otherwise(0)


def strategies() -> dict:
    """Registry: name to signal expression; users may add callables or SQL text."""
    return {
        "ma_trend": ma_trend, "rsi_momentum": rsi_momentum, "mean_reversion": mean_reversion,
        "volatility_breakout": volatility_breakout, "funding_sentiment": funding_contrarian,
        "combined": weighted_vote,
    }


def resolve(rule) -> Column:
    """A registered callable or a SQL expression string."""
    return rule() if callable(rule) else F.expr(rule)


def rule_sets() -> dict:
    """Named (long, short) conditions over rsi, cci, macd_hist, moving averages and adx."""
    rsi, cci, hist, before = c("rsi"), c("cci"), c("macd_hist"), c("macd_hist_prev")
    close, fast, slow, adx = c("close"), c("ma_20"), c("ma_100"), c("adx")
    return {
        "RSI_pullback": ((rsi < 35) & (close > fast), (rsi > 65) & (close < fast)),
        "RSI_extreme": (rsi < 25, rsi > 75),
        "CCI_bounce": (cci < -100, cci > 200),
        "MACD_momentum": ((hist > 0) & (before <= 0), (hist < 0) & (before >= 0)),
        "Trend_follow": ((close > fast) & (fast > slow) & (adx > 25), (close < fast) & (fast < slow) & (adx > 25)),
        "Mean_revert": ((rsi < 30) & (cci < -150), (rsi > 70) & (cci > 150)),
    }


# --- score filters --------------------------------------------------------------------------

def strengths(pred: Column, slope: float = 200.0) -> tuple:
    """Long and short strength of a predicted return."""
    return sigmoid(pred, slope), sigmoid(-pred, slope)


def funding_boost(short: Column, funding: Column, boost: float = 1.15) -> Column:
    """Positive funding lifts the short score (at most 1), very negative funding dampens it."""
    return F.when(funding > 0, F.least(short * boost, F.lit(1.0))).when(funding < -0.0003, short * 0.9).otherwise(short)


def momentum_filter(short: Column, fast: Column, slow: Column, row: Column, n_fast: int = 6, n_slow: int = 24,
                    slack: float = 0.003) -> Column:
    """Drop the short score when the last bars bounce more than the longer trend implies."""
    bounce = fast > slow * (n_fast / n_slow) + slack
    return F.when((row >= n_slow) & F.coalesce(bounce, F.lit(False)), F.lit(None)).otherwise(short)


def uncertainty_filter(pred: Column, log_variance: Column, threshold: float = 1.0) -> tuple:
    """Strengths only where the signal-to-noise ratio reaches the threshold."""
    snr = F.abs(pred) / F.exp(log_variance / 2)
    up, down = strengths(pred)
    return F.when(snr >= threshold, up), F.when(snr >= threshold, down)


def quantile_filter(strictness: str) -> tuple:
    """Strengths from predicted quantiles q10..q90; 'medium' also reads ``median_spread``."""
    q50, spread = c("q50"), c("q90") - c("q10")
    up, down = strengths(q50)
    if strictness == "strict":
        return F.when(c("q25") > 0, up), F.when(c("q75") < 0, down)
    if strictness == "medium":
        tight = spread < c("median_spread")
        return F.when((q50 > 0) & tight, up), F.when((q50 < 0) & tight, down)
    scaled = q50 * 5 / (spread + 1e-6)
    return F.when(q50 > 0, sigmoid(scaled)), F.when(q50 < 0, sigmoid(-scaled))


# --- sizing and levels ----------------------------------------------------------------------

def floor_places(x: Column, places: int = 3) -> Column:
    return F.floor(x * 10 ** places) / 10 ** places


def position_size(balance: Column, price: Column, confidence: Column, risk: float = 0.01, stop: float = 0.02,
                  max_usd: float = 1000.0, max_exposure: float = 0.5) -> Column:
    """Risk-based size scaled by confidence tier, capped, rounded down to 3 places."""
    tier = F.when(confidence >= 0.70, 1.0).when(confidence >= 0.60, 0.7).when(confidence >= 0.55, 0.5).otherwise(0.3)
    value = F.least(balance * risk / stop * tier, F.lit(max_usd), balance * max_exposure)
    return floor_places(F.try_divide(value, price))


def stop_target(price: Column, long_side: Column, atr_share: Column, regime: Column) -> tuple:
    """Stop and target by volatility bucket, adjusted by market regime."""
    sl = F.when(atr_share < 0.005, 0.05).otherwise(0.08)
    tp = F.when(atr_share < 0.0025, 0.02).when(atr_share < 0.005, 0.03).otherwise(0.04)
    sl = sl * F.when(regime == "bull", 0.9).when(regime == "bear", 1.2).when(regime == "sideways", 0.85).otherwise(1.0)
    tp = tp * F.when(regime == "bull", 1.5).when(regime == "bear", 0.7).when(regime == "sideways", 0.85).otherwise(1.0)
    sign = F.when(long_side, 1).otherwise(-1)
    return price * (1 - sign * sl), price * (1 + sign * tp)


def order_problem(quantity: Column, price: Column, max_value: float = 3000.0, min_value: float = 5.0) -> Column:
    """Reason an order is refused, NULL when it is fine."""
    value = quantity * price
    return (
        F.when(quantity <= 0, "quantity").when(price <= 0, "price")
        .when(value > max_value, "too large").when(value < min_value, "too small")
    )


def admitted(trades, max_loss: float = 200.0, max_trades: int = 2):
    """Decision on every trade (symbol, ts, entry_rn, pnl) in turn, from the admitted ones of its day; one row a trade.

    A day's trades of one symbol are folded as one short array: no more than its bars.
    """
    day = trades.groupBy("symbol", F.date_trunc("day", "ts").alias("_day")).agg(F.sort_array(F.collect_list(F.struct("entry_rn", "ts", "pnl"))).alias("_t"))
    return day.selectExpr("symbol", f"""inline(aggregate(_t,
        named_struct('pnl', 0D, 'n', 0L, 'rows', cast(array() AS array<struct<ts: timestamp, decision: string, day_trades: bigint, day_pnl: double>>)),
        (s, t) -> named_struct(
            'pnl', s.pnl + if(s.pnl <= {-max_loss}D OR s.n >= {max_trades}, 0D, t.pnl), 'n', s.n + if(s.pnl <= {-max_loss}D OR s.n >= {max_trades}, 0L, 1L),
            'rows', array_append(s.rows, named_struct('ts', t.ts, 'decision',
                CASE WHEN s.pnl <= {-max_loss}D THEN 'daily loss' WHEN s.n >= {max_trades} THEN 'daily trades' ELSE 'ok' END, 'day_trades', s.n, 'day_pnl', s.pnl))),
        s -> s.rows))""")
