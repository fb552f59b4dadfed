"""Signals, backtests, barrier exits, equity, statistics and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import signals as G
from barloom.functions.rolling import c
from barloom.operators import features as X
from barloom.operators import sweep as S
from barloom.operators import trades as T
from barloom.operators.chunks import clean
from barloom.plans.q_features import RSI, TR, alias
from barloom.plans.q_labels import EXC
from barloom.plans.q_sources import bars_with_funding
from barloom.plans.registry import query, report
from barloom.plans.sqltext import P, cols, full, lag, lead, sql
from barloom.session import cut_lineage
from barloom.sources import bars as B

STRAT = [
    ("st1", alias({"d": f"close - {lag('close')}", "ma_20": full("avg", "close", 20), "ma_50": full("avg", "close", 50), "tr": TR,
                   "fz": f"(funding_rate - {full('avg', 'funding_rate', 30)}) / nullif({full('stddev_samp', 'funding_rate', 30)}, 0)",
                   "rn": f"row_number() OVER ({P}) - 1"}, "bars_f")),
    ("st2", alias({"gain": "CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END", "loss": "CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END",
                   "dev": "close - ma_20", "atr_14": full("avg", "tr", 14)}, "st1")),
    ("st3", alias({"ag": full("avg", "gain", 14), "al": full("avg", "loss", 14),
                   "dev_z": f"dev / nullif({full('stddev_samp', 'dev', 20)}, 0)"}, "st2")),
    ("st4", alias({"rsi_14": RSI}, "st3")),
]


def sided(up, down):
    return f"CASE WHEN coalesce({down}, false) THEN -1 WHEN coalesce({up}, false) THEN 1 ELSE 0 END"


RULES = {
    "ma_trend": "coalesce(close > ma_50 AND ma_20 > ma_50, false)::INT",
    "rsi_momentum": sided("rsi_14 < 30 AND close > ma_50", "rsi_14 > 70 AND close < ma_50"),
    "mean_reversion": sided("dev_z < -2", "dev_z > 2"),
    "volatility_breakout": sided("close > ma_20 + 2 * atr_14", "close < ma_20 - 2 * atr_14"),
    "funding_sentiment": sided("fz < -1.5", "fz > 1.5"),
}
SIG = ("sig", alias(RULES, "st4"))
SIG2 = ("sig2", "SELECT *, CASE WHEN 0.4 * ma_trend + 0.4 * rsi_momentum + 0.2 * funding_sentiment > 0.5 THEN 1 "
                "WHEN 0.4 * ma_trend + 0.4 * rsi_momentum + 0.2 * funding_sentiment < -0.5 THEN -1 ELSE 0 END AS combined FROM sig")
NAMES = " ".join([*RULES, "combined"])


def strategy_frame(spark, folder):
    return cut_lineage(X.features(bars_with_funding(spark, folder), X.strategy_inputs))


@query("strategy_signals", sql("bars_f", *STRAT, SIG, SIG2, out=cols("sig2", ints=NAMES)))
def strategy_signals(spark, folder):
    df = strategy_frame(spark, folder)
    return report(df.select("symbol", "ts", *[rule().alias(name) for name, rule in G.strategies().items()]))


@query("strategy_sql_rule", sql("bars_f", *STRAT, SIG, out=cols("sig", ints="ma_trend")))
def strategy_sql_rule(spark, folder):
    rule = "cast(coalesce(close > ma_50 and ma_20 > ma_50, false) as int)"
    return report(strategy_frame(spark, folder).select("symbol", "ts", G.resolve(rule).alias("ma_trend")))


def curve(spark, folder, rule=G.ma_trend):
    df = strategy_frame(spark, folder).withColumn("signal", rule())
    return cut_lineage(T.signal_backtest(df))


def backtest_steps(source="sig2", signal="ma_trend", p=P, key="symbol"):
    return [
        ("bt1", f"SELECT *, coalesce(lag({signal}, 1) OVER ({p}), 0) AS pos, row_number() OVER ({p}) - 1 AS brn FROM {source}"),
        ("bt2", f"SELECT *, lag(pos, 1) OVER ({p}) AS before, open / lag(open, 1) OVER ({p}) - 1 AS move FROM bt1"),
        ("bt3", "SELECT *, pos - coalesce(before, 0) AS change, before * move AS strategy_ret, "
                "before * move - CASE WHEN pos <> coalesce(before, 0) THEN 0.0004::DOUBLE ELSE 0 END AS net_ret FROM bt2"),
        ("bt4", f"SELECT *, 10000 * product(coalesce(1 + net_ret, 1)) OVER ({p}) AS equity FROM bt3"),
        ("turns", f"SELECT {key}, ts, brn, pos, open, lead(open) OVER ({p}) AS exit_price, lead(ts) OVER ({p}) AS exit_ts, lead(brn) OVER ({p}) AS exit_rn FROM bt4 WHERE change <> 0"),
        ("tl", f"""SELECT {key}, ts AS entry_ts, exit_ts, pos AS position, open AS entry_price, exit_price, exit_rn - brn AS duration,
  (CASE WHEN pos = 1 THEN exit_price / open - 1 ELSE open / exit_price - 1 END) - 0.0008::DOUBLE AS pnl_pct,
  ((CASE WHEN pos = 1 THEN exit_price / open - 1 ELSE open / exit_price - 1 END) - 0.0008::DOUBLE) * 10000 AS pnl FROM turns WHERE pos <> 0 AND exit_rn IS NOT NULL"""),
        ("dd", f"SELECT *, (equity - max(equity) OVER ({p})) / max(equity) OVER ({p}) AS drawdown FROM bt4"),
        ("dd2", f"SELECT *, CASE WHEN drawdown < -0.01 THEN brn - coalesce(max(CASE WHEN NOT drawdown < -0.01 THEN brn END) OVER ({p} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) ELSE 0 END AS dd_bars FROM dd"),
    ]


@query("signal_backtest", sql("bars_f", *STRAT, SIG, SIG2, *backtest_steps(), ("out_", "SELECT *, ln(equity) AS log_equity, pos AS position, change AS position_change FROM bt4"),
    out=cols("out_", ints="position position_change", nums="strategy_ret net_ret log_equity")))
def signal_backtest(spark, folder):
    df = curve(spark, folder).withColumn("log_equity", F.ln("equity"))
    return report(df, "symbol", "ts", "position", "position_change", "strategy_ret", "net_ret", "log_equity")


@query("position_trades", sql("bars_f", *STRAT, SIG, SIG2, *backtest_steps(signal="volatility_breakout"),
    out=cols("tl", ts="entry_ts exit_ts", ints="position duration", nums="entry_price exit_price pnl_pct pnl:3")))
def position_trades(spark, folder):
    trades = T.position_trades(curve(spark, folder, G.volatility_breakout))
    return report(trades, "symbol", "entry_ts", "exit_ts", "position", "duration", "entry_price", "exit_price", "pnl_pct", "pnl:3")


@query("drawdown", sql("bars_f", *STRAT, SIG, SIG2, *backtest_steps(), out=cols("dd2", ints="dd_bars", nums="drawdown")))
def drawdown(spark, folder):
    return report(T.drawdowns(curve(spark, folder)), "symbol", "ts", "dd_bars", "drawdown")


def perf_out(key):
    return f"""SELECT {key}, ln(fe) AS log_final_equity, ln(fe / ie) / (steps / 8766) AS cagr_log, sd * sqrt(8766) AS volatility,
  mu * 8766 / nullif(sd * sqrt(8766), 0) AS sharpe, max_drawdown, max_dd_bars, coalesce(n_trades, 0) AS n_trades, wins / n_trades AS win_rate,
  abs(won / nullif(lost, 0)) AS profit_factor, avg_win, avg_loss, n_losses, avg_duration, max_duration
  FROM (SELECT {key}, arg_max(equity, ts) AS fe, arg_min(equity, ts) AS ie, count(*) - 1 AS steps, avg(coalesce(net_ret, 0)) AS mu,
    stddev_samp(coalesce(net_ret, 0)) AS sd, min(drawdown) AS max_drawdown, max(dd_bars) AS max_dd_bars FROM dd2 GROUP BY ALL)
  LEFT JOIN (SELECT {key}, count(*) AS n_trades, count(*) FILTER (WHERE pnl > 0) AS wins, avg(pnl) FILTER (WHERE pnl > 0) AS avg_win,
    avg(pnl) FILTER (WHERE pnl < 0) AS avg_loss, sum(pnl) FILTER (WHERE pnl > 0) AS won, sum(pnl) FILTER (WHERE pnl < 0) AS lost,
    count(*) FILTER (WHERE pnl < 0) AS n_losses, avg(duration) AS avg_duration, max(duration) AS max_duration FROM tl GROUP BY ALL) USING ({key})"""


PERF_INTS = "max_dd_bars n_trades n_losses max_duration"
PERF_NUMS = "cagr_log:4 volatility sharpe max_drawdown win_rate profit_factor avg_win:3 avg_loss:3 avg_duration"


@query("perf_stats", sql("bars_f", *STRAT, SIG, SIG2, *backtest_steps(), ("out_", perf_out("symbol")),
    out=cols("out_", ts="", ints=PERF_INTS, nums="log_final_equity " + PERF_NUMS)))
def perf_stats(spark, folder):
    positions = curve(spark, folder)
    df = T.performance(T.drawdowns(positions), T.position_trades(positions)).withColumn("log_final_equity", F.ln("final_equity"))
    return report(df, "symbol", *PERF_INTS.split(), "log_final_equity", *PERF_NUMS.split())


SP = "PARTITION BY symbol, strategy ORDER BY ts"


@query("strategy_compare", sql("bars_f", *STRAT, SIG, SIG2, ("u", f"UNPIVOT sig2 ON {', '.join(NAMES.split())} INTO NAME strategy VALUE signal"),
    *backtest_steps("u", "signal", SP, "symbol, strategy"), ("out_", perf_out("symbol, strategy")),
    ("cmp", "SELECT *, sharpe - max(sharpe) FILTER (WHERE strategy = 'ma_trend') OVER (PARTITION BY symbol) AS sharpe_gain FROM out_"),
    out=cols("cmp", keys="symbol strategy", ts="", ints="n_trades n_losses", nums="volatility sharpe win_rate profit_factor sharpe_gain")))
def strategy_compare(spark, folder):
    df = strategy_frame(spark, folder)
    rules = F.array(*[F.struct(F.lit(n).alias("strategy"), r().alias("signal")) for n, r in G.strategies().items()])
    runs = df.select("symbol", "ts", "open", F.explode(rules).alias("_r")).select("symbol", "ts", "open", "_r.*")
    key = ("symbol", "strategy")
    positions = cut_lineage(T.signal_backtest(cut_lineage(runs), key=key))
    stats = T.performance(T.drawdowns(positions, key=key), T.position_trades(positions, key=key), key=key)
    base = stats.where("strategy = 'ma_trend'").select("symbol", F.col("sharpe").alias("_base"))
    out = stats.join(base, "symbol", "left").withColumn("sharpe_gain", c("sharpe") - c("_base"))
    return report(out, "symbol", "strategy", "n_trades", "n_losses", "volatility", "sharpe", "win_rate", "profit_factor", "sharpe_gain")


# --- barrier exits --------------------------------------------------------------------------

SCORE = [
    ("s0", alias({"m": f"ln(close / {lag('close', 12)})", "tr": TR, "rn": f"row_number() OVER ({P}) - 1"}, "{src}")),
    ("s1", alias({"z": f"(m - {full('avg', 'm', 48)}) / ({full('stddev_samp', 'm', 48)} + 1e-10)", "atr": full("avg", "tr", 14)}, "s0")),
    ("s2", "SELECT *, 1 / (1 + exp(-z)) AS long_prob, 1 / (1 + exp(z)) AS short_prob, atr / close * 100 AS atr_pct FROM s1"),
]


def score_steps(src="bars"):
    return [(n, b.replace("{src}", src)) for n, b in SCORE]


def entries_sql(pct, both=True, slip=0.01):
    return [
        ("th", f"SELECT symbol, quantile_cont(long_prob, {1 - pct}) AS lt, quantile_cont(short_prob, {1 - pct}) AS sht, median(atr_pct) AS atr_median FROM s2 GROUP BY 1"),
        ("e0", "SELECT s2.*, th.atr_median, coalesce(long_prob >= lt, false) AS ls, " + ("coalesce(short_prob >= sht, false)" if both else "false") + " AS ss FROM s2 JOIN th USING (symbol) WHERE atr > 0"),
        ("e1", "SELECT *, CASE WHEN ls AND (NOT ss OR long_prob >= short_prob) THEN 1 WHEN ss THEN -1 END AS side FROM e0"),
        ("ent", f"SELECT *, close * (1 + side * {slip / 100!r}::DOUBLE) AS ep FROM e1 WHERE side IS NOT NULL"),
    ]


def exits_sql(tp, sl, hold, mode, trail):
    moved = {"fixed": "NULL", "trailing": f"max(side * (CASE WHEN side > 0 THEN high ELSE low END) - {trail} * atr) OVER w",
             "breakeven": f"CASE WHEN max(CASE WHEN side * ((CASE WHEN side > 0 THEN high ELSE low END) - (ep + side * {trail} * atr)) >= 0 THEN 1 ELSE 0 END) OVER w = 1 THEN side * ep END"}[mode]
    return [
        ("fw", f"SELECT e.symbol, e.rn, e.side, e.ep, e.atr, b.rn - e.rn AS k, b.high, b.low, b.close FROM ent e JOIN s2 b ON b.symbol = e.symbol AND b.rn BETWEEN e.rn + 1 AND e.rn + {hold}"),
        ("fs", f"SELECT *, side * greatest(side * (ep - side * {sl} * atr), {moved}) AS stop, ep + side * {tp} * atr AS tpp FROM fw WINDOW w AS (PARTITION BY symbol, rn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
        ("fh", f"""SELECT *, CASE WHEN side * ((CASE WHEN side > 0 THEN low ELSE high END) - stop) <= 0 THEN 'SL'
  WHEN side * ((CASE WHEN side > 0 THEN high ELSE low END) - tpp) >= 0 THEN 'TP' WHEN k >= {hold} THEN 'TIMEOUT' END AS reason FROM fs"""),
        ("fx", "SELECT symbol, rn, min(k) AS bars_held FROM fh WHERE reason IS NOT NULL GROUP BY 1, 2"),
        ("ex", """SELECT e.symbol, e.ts, e.rn, e.side, e.ep AS entry_price, e.atr, e.atr_pct, e.atr_median, x.bars_held, h.reason,
  CASE h.reason WHEN 'SL' THEN h.stop WHEN 'TP' THEN h.tpp ELSE h.close END AS exit_price,
  e.side * ((CASE h.reason WHEN 'SL' THEN h.stop WHEN 'TP' THEN h.tpp ELSE h.close END) - e.ep) / e.ep AS gross_ret
  FROM ent e LEFT JOIN fx x ON e.symbol = x.symbol AND e.rn = x.rn LEFT JOIN fh h ON h.symbol = x.symbol AND h.rn = x.rn AND h.k = x.bars_held"""),
    ]


def exits_df(bars, pct, grid_row, direction="both"):
    tp, sl, hold, mode, trail = grid_row
    grid = S.Grid(percentiles=(pct,), directions=(direction,), hours=(("allhours", -1, -1),))
    frame = cut_lineage(S.scored_frame(bars, hold))
    slim = frame.select("symbol", "long_prob", "short_prob")
    entries = S.entry_signals(frame, S.score_thresholds(slim, (pct,)), grid)
    entries = entries.withColumns({
        "entry_price": c("close") * (1 + c("side") * 0.0001), "atr_entry": c("atr_14"), "tp_mult": F.lit(tp), "sl_mult": F.lit(sl),
        "hold": F.lit(hold), "exit_mode": F.lit(mode), "trail_mult": F.lit(trail)})
    return T.resolve_exits(entries)


for _name, _row in {"barrier_exits": (2.0, 1.0, 12, "fixed", 1.0), "trailing_exits": (3.0, 1.5, 18, "trailing", 0.75),
                    "breakeven_exits": (3.0, 1.5, 18, "breakeven", 1.0)}.items():
    @query(_name, sql("bars", *score_steps(), *entries_sql(0.2), *exits_sql(*_row),
                      out=cols("ex", keys="symbol reason", ints="side bars_held", nums="entry_price exit_price gross_ret")))
    def barrier_exits(spark, folder, row=_row):
        return report(exits_df(B.stored_bars(spark, folder), 0.2, row), "symbol", "reason", "ts", "side", "bars_held", "entry_price", "exit_price", "gross_ret")


PICK = ("pick", """SELECT symbol, min(rn) AS rn FROM ex GROUP BY 1 UNION ALL
  SELECT p.symbol, n.rn FROM pick p JOIN nxt n ON n.symbol = p.symbol AND n.prev = p.rn WHERE n.rn IS NOT NULL""")
NXT = ("nxt", "SELECT a.symbol, a.rn AS prev, min(b.rn) AS rn FROM ex a JOIN ex b ON a.symbol = b.symbol AND b.rn > a.rn + a.bars_held GROUP BY 1, 2")
PORT = [NXT, PICK, ("tk", "SELECT ex.* FROM ex JOIN pick USING (symbol, rn) WHERE bars_held IS NOT NULL")]


def recursive(text):
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("one_position", recursive(sql("bars", *score_steps(), *entries_sql(0.2), *exits_sql(2.0, 1.0, 12, "fixed", 1.0), *PORT,
    out=cols("tk", keys="symbol reason", ints="side bars_held", nums="gross_ret"))))
def one_position(spark, folder):
    exits = cut_lineage(exits_df(B.stored_bars(spark, folder), 0.2, (2.0, 1.0, 12, "fixed", 1.0)))
    kept = T.one_at_a_time(exits, ["symbol"], 12).where("bars_held is not null")
    return report(kept, "symbol", "reason", "ts", "side", "bars_held", "gross_ret")


EQ = [
    ("fu", f"SELECT symbol, rn, sum(coalesce(funding_rate, 0)) OVER ({P}) AS cf FROM s2"),
    ("sz", """SELECT tk.*, -side * (b.cf - a.cf) AS funding_ret, least(0.01::DOUBLE * greatest(0.5, least(2.0, 1 / (atr_pct / (atr_median + 1e-10)))) / greatest(1.0 * atr / entry_price, 1e-6), 0.25) AS share
  FROM tk JOIN fu a ON a.symbol = tk.symbol AND a.rn = tk.rn JOIN fu b ON b.symbol = tk.symbol AND b.rn = tk.rn + tk.bars_held"""),
    ("gr", "SELECT *, share * (gross_ret + funding_ret - 0.0006::DOUBLE) AS growth FROM sz"),
    ("eq", "SELECT *, 25000 * product(1 + growth) OVER (PARTITION BY symbol ORDER BY rn) AS capital FROM gr"),
    ("pk", "SELECT *, capital - capital / (1 + growth) AS pnl, greatest(25000, max(capital) OVER (PARTITION BY symbol ORDER BY rn)) AS peak FROM eq"),
    ("br", "SELECT *, (peak - capital) / (peak + 1e-10) AS dd, coalesce(sum((capital < peak * 0.9)::INT) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM pk"),
    ("tq", "SELECT * FROM br WHERE earlier = 0"),
]
ONE_RUN = dict(pct=0.1, row=(2.0, 1.0, 12, "fixed", 1.0))


def equity_sql(*steps, out):
    return recursive(sql("bars_f", *score_steps("bars_f"), *entries_sql(0.1), *exits_sql(2.0, 1.0, 12, "fixed", 1.0), *PORT, *EQ, *steps, out=out))


def one_run(spark, folder):
    """One configuration through the whole sweep machinery, funding and volatility sizing included."""
    grid = S.Grid(barriers=((2.0, 1.0),), percentiles=(0.1,), fees=(("maker", 0.02, 0.01),), exits=(("fixed", 1.0),), directions=("both",),
                  holds=(12,), hours=(("allhours", -1, -1),), sizings=((False, True),))
    return S.sweep_trades(bars_with_funding(spark, folder), grid), grid


@query("trade_equity", equity_sql(out=cols("tq", keys="symbol reason", ints="side bars_held", nums="funding_ret:9 share growth capital:3 pnl:3 dd")))
def trade_equity(spark, folder):
    trades, _ = one_run(spark, folder)
    return report(trades, "symbol", "reason", "ts", "side", "bars_held", "funding_ret:9", "share", "growth", "capital:3", "pnl:3", "dd")


STAT_INTS = "n_trades n_long n_short n_tp n_sl n_timeout"
STAT_NUMS = "win_rate profit_factor final_capital:3 max_dd sharpe avg_pnl:3 avg_win:3 avg_loss:3"
STATS = """SELECT {k}, count(*) AS n_trades, avg((pnl > 0)::INT) AS win_rate, sum(pnl) FILTER (WHERE pnl > 0) / nullif(abs(sum(pnl) FILTER (WHERE NOT pnl > 0)), 0) AS profit_factor,
  arg_max(capital, rn) AS final_capital, max(dd) * 100 AS max_dd, avg(pnl / 25000) / (stddev_pop(pnl / 25000) + 1e-10) * sqrt(730) AS sharpe, avg(pnl) AS avg_pnl,
  avg(pnl) FILTER (WHERE pnl > 0) AS avg_win, avg(pnl) FILTER (WHERE NOT pnl > 0) AS avg_loss, count(*) FILTER (WHERE side > 0) AS n_long, count(*) FILTER (WHERE side < 0) AS n_short,
  count(*) FILTER (WHERE reason = 'TP') AS n_tp, count(*) FILTER (WHERE reason = 'SL') AS n_sl, count(*) FILTER (WHERE reason = 'TIMEOUT') AS n_timeout FROM tq GROUP BY ALL"""


@query("trade_stats", equity_sql(("out_", STATS.format(k="symbol")), out=cols("out_", ts="", ints=STAT_INTS, nums=STAT_NUMS)))
def trade_stats(spark, folder):
    trades, grid = one_run(spark, folder)
    return report(T.trade_stats(trades, ["symbol"], grid.capital), "symbol", *STAT_INTS.split(), *STAT_NUMS.split())


@query("trade_stats_by_reason", equity_sql(("out_", "SELECT symbol, coalesce(reason, 'ALL') AS reason, n, pnl, win_rate, avg_bars FROM (SELECT symbol, reason, count(*) AS n, sum(pnl) AS pnl, avg((pnl > 0)::INT) AS win_rate, avg(bars_held) AS avg_bars FROM tq GROUP BY ROLLUP (symbol, reason)) WHERE symbol IS NOT NULL"),
    out=cols("out_", keys="symbol reason", ts="", ints="n", nums="pnl:3 win_rate avg_bars")))
def trade_stats_by_reason(spark, folder):
    trades, _ = one_run(spark, folder)
    df = trades.rollup("symbol", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"), F.avg((c("pnl") > 0).cast("int")).alias("win_rate"), F.avg("bars_held").alias("avg_bars"))
    return report(df.where("symbol is not null").withColumn("reason", F.coalesce("reason", F.lit("ALL"))), "symbol", "reason", "n", "pnl:3", "win_rate", "avg_bars")


@query("sweep_small")
def sweep_small(spark, folder):
    return report(S.sweep(bars_with_funding(spark, folder), S.SMALL))


@query("sweep_full")
def sweep_full(spark, folder):
    """All 7,680 configurations, every symbol."""
    return report(S.sweep(bars_with_funding(spark, folder), S.Grid()))


# --- MAE/MFE grid ---------------------------------------------------------------------------

# Stops and targets of the grid, in percent, and those of the grid by volatility.
SL_RANGE = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 7.0, 8.0)
TP_RANGE = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 12.0, 15.0)
VOL_SL = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0)
VOL_TP = (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0)
GRID_INTS = "total_trades wins losses premature_stops"
GRID_NUMS = "sl_pct tp_pct reward_risk win_rate profit_factor expectancy premature_pct total_profit total_loss net_profit"


def grid_sql(key, stops=SL_RANGE, targets=TP_RANGE):
    k = f"{key}, " if key else ""
    return [("gv", f"SELECT {k}sl_pct, tp_pct, mae <= -sl_pct AS lost, mae > -sl_pct AND mfe >= tp_pct AS won, mae <= -sl_pct AND mfe >= tp_pct AS early FROM exc, (SELECT unnest({list(stops)})::DOUBLE AS sl_pct), (SELECT unnest({list(targets)})::DOUBLE AS tp_pct) WHERE mae IS NOT NULL"),
            ("gc", f"SELECT {k}sl_pct, tp_pct, sum(won::INT) AS wins, sum(lost::INT) AS losses, sum(early::INT) AS premature_stops FROM gv GROUP BY ALL"),
            ("gr", """SELECT *, wins + losses AS total_trades, tp_pct / sl_pct AS reward_risk, wins / (wins + losses) AS win_rate,
  CASE WHEN losses > 0 THEN wins * tp_pct / (losses * sl_pct) ELSE 0 END AS profit_factor, wins / (wins + losses) * tp_pct - (1 - wins / (wins + losses)) * sl_pct AS expectancy,
  CASE WHEN losses > 0 THEN premature_stops / losses ELSE 0 END AS premature_pct, wins * tp_pct AS total_profit, losses * sl_pct AS total_loss, wins * tp_pct - losses * sl_pct AS net_profit
  FROM gc WHERE wins + losses > 0""")]


@query("sltp_grid", sql("bars", EXC, *grid_sql(""), out=cols("gr", keys="", ts="", ints=GRID_INTS, nums=GRID_NUMS)))
def sltp_grid(spark, folder):
    from barloom.operators.labels import excursions
    return report(T.sltp_grid(excursions(B.stored_bars(spark, folder)), SL_RANGE, TP_RANGE), *GRID_INTS.split(), *GRID_NUMS.split())


VOLQ = [("ra", alias({"tr": TR}, "bars")), ("rb", alias({"ap": f"{full('avg', 'tr', 14)} / close * 100"}, "ra")),
        ("rq", "SELECT symbol, quantile_cont(ap, 0.33) AS lo, quantile_cont(ap, 0.67) AS hi FROM rb GROUP BY 1"),
        ("exc", f"SELECT r.*, CASE WHEN ap < lo THEN 'low' WHEN ap < hi THEN 'normal' WHEN ap >= hi THEN 'high' END AS regime, " + EXC[1].split("*, ", 1)[1].replace("FROM bars", "FROM rb r JOIN rq USING (symbol)").replace(P, P.replace("symbol", "r.symbol")))]


@query("sltp_by_vol", sql("bars", *VOLQ, *grid_sql("regime", VOL_SL, VOL_TP), ("out_", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY expectancy DESC, sl_pct, tp_pct) AS p FROM gr WHERE regime IS NOT NULL) WHERE p = 1"),
    out=cols("out_", keys="regime", ts="", ints="total_trades wins losses", nums="sl_pct tp_pct win_rate profit_factor expectancy")))
def sltp_by_vol(spark, folder):
    from barloom.operators.labels import excursions
    bars = X.features(B.stored_bars(spark, folder), X.atr)
    best = T.best_by_regime(T.sltp_grid(T.volatility_buckets(excursions(bars)), VOL_SL, VOL_TP, ["regime"]))
    return report(best, "regime", "total_trades", "wins", "losses", "sl_pct", "tp_pct", "win_rate", "profit_factor", "expectancy")
