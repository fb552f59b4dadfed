"""Daily and intraday rule catalogs, their trades and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import c
from barloom.operators import rules as R
from barloom.operators import studies as E
from barloom.plans.q_features import TR, RSI, alias
from barloom.plans.registry import query, report
from barloom.plans.sqltext import P, cols, full, lag, lead, sql
from barloom.session import cut_lineage
from barloom.sources import bars as B

FRAME = [
    ("d0", f"SELECT *, close / {lag('close')} - 1 AS ret FROM daily"),
    ("k1", "SELECT *, CASE WHEN ret >= 0 THEN 1 WHEN ret IS NOT NULL THEN -1 ELSE 0 END AS s FROM d0"),
    ("k2", f"SELECT *, CASE WHEN s IS DISTINCT FROM {lag('s')} THEN 1 ELSE 0 END AS turn FROM k1"),
    ("k3", f"SELECT *, sum(turn) OVER ({P}) AS run FROM k2"),
    ("k4", "SELECT *, CASE WHEN s = 0 THEN 0 ELSE s * row_number() OVER (PARTITION BY symbol, run ORDER BY ts) END AS streak, CASE WHEN s = 0 THEN 0 ELSE sum(coalesce(ret, 0)) OVER (PARTITION BY symbol, run ORDER BY ts) * 100 END AS move FROM k3"),
    ("v1", "SELECT *, CASE WHEN count(vix) OVER w = 60 THEN avg(vix) OVER w END AS m60 FROM vix WINDOW w AS (ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"),
    ("vt", "SELECT *, lag((m60 - vix) / vix) OVER (ORDER BY ts) AS term_prev FROM v1"),
    ("k5", "SELECT k4.*, v.vix, v.term_prev FROM k4 ASOF LEFT JOIN vt v ON k4.ts >= v.ts"),
    ("x1", alias({"d": f"close - {lag('close')}", "tr": TR}, "k5")),
    ("x2", alias({"gain": "CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END", "loss": "CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END", "atr_14": full("avg", "tr", 14)}, "x1")),
    ("x3", alias({"ag": full("avg", "gain", 14), "al": full("avg", "loss", 14),
                  "al100": f"list(atr_14) FILTER (WHERE atr_14 IS NOT NULL) OVER ({P} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"}, "x2")),
    ("x4", alias({"rsi_14": RSI, "s50": full("avg", "close", 50), "s200": full("avg", "close", 200), "vrat": f"volume / nullif({full('avg', 'volume', 20)}, 0)",
                  "arank": "CASE WHEN len(al100) = 100 THEN (len(list_filter(al100, lambda v: v < atr_14)) + (len(list_filter(al100, lambda v: v = atr_14)) + 1) / 2.0) / 100 END",
                  "wk": "date_trunc('week', ts)::TIMESTAMP"}, "x3")),
    ("wr", "SELECT symbol, wk, arg_max(close, ts) / arg_min(open, ts) - 1 AS wret FROM x4 GROUP BY 1, 2"),
    ("x5", f"""SELECT symbol, ts, open, high, low, close, wk, term_prev AS term, CASE WHEN ts < min(ts) OVER (PARTITION BY symbol) + INTERVAL 48 MONTHS THEN 'train' ELSE 'test' END AS split,
  (open / {lag('close')} - 1) * 100 AS gap, isodow(ts) - 1 AS dow, month(ts) AS month, day(ts) AS dom, coalesce({lag('streak')}, 0) AS st, abs(coalesce({lag('move')}, 0)) AS drop_,
  {lag('vix')} AS vx, {lag('vix')} - {lag('vix', 2)} AS vchg, row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts) AS td,
  row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts DESC) - 1 AS tdl, {lag('rsi_14')} AS rsi, {lag('s50')} AS sma50, {lag('s200')} AS sma200,
  ({lag('close')} / {lag('s200')} - 1) * 100 AS dist, {lag('atr_14')} AS atr, {lag('arank')} AS atr_rank, {lag('vrat')} AS vr, {lag('close')} AS pc, {lag('close')} AS close_prev,
  {', '.join(f"{lead('close', k)} AS c{k}" for k in (1, 2, 3, 4, 5))}, {lead('open')} AS o1, {', '.join(f"isodow({lead('ts', k)}) - 1 AS dow{k}" for k in (1, 2, 3))},
  coalesce(lag(streak, 2) OVER ({P}) <= -3 AND {lag('vix', 2)} < 25, false)::INT AS prev_mr FROM x4"""),
    ("rf", "SELECT x5.*, wr.wret AS week FROM x5 LEFT JOIN wr ON x5.symbol = wr.symbol AND x5.wk = wr.wk + INTERVAL 7 DAYS"),
]


def trades_sql(source="rf", rules=R.DAILY_RULES):
    legs = " UNION ALL ".join(
        f"SELECT symbol, ts, '{n}' AS rule, {i} AS leg, {side} AS side, CAST({entry} AS DOUBLE) AS entry_price, CAST({exit_} AS DOUBLE) AS exit_price, CAST({size} AS DOUBLE) AS size FROM {source} WHERE {cond}"
        for i, (n, cond, entry, exit_, side, size) in enumerate(rules))
    return [("legs", legs),
            ("tr_", "SELECT *, side * (exit_price * (1 - side * 0.0001::DOUBLE) - entry_price * (1 + side * 0.0001::DOUBLE)) / (entry_price * (1 + side * 0.0001::DOUBLE)) * 100 AS pnl_pct FROM legs WHERE entry_price IS NOT NULL AND exit_price IS NOT NULL")]


EQ = [("eq", "SELECT *, 25000 * product(1 + size / 100 * pnl_pct / 100) OVER (PARTITION BY symbol, rule ORDER BY ts, leg) AS equity FROM tr_"),
      ("pk", "SELECT *, equity - equity / (1 + size / 100 * pnl_pct / 100) AS pnl, greatest(25000, max(equity) OVER (PARTITION BY symbol, rule ORDER BY ts, leg)) AS peak FROM eq"),
      ("st_", """SELECT symbol, rule, count(*) AS n_trades, avg((pnl_pct > 0)::INT) * 100 AS win_rate, avg(pnl_pct) AS avg_pnl, sum(pnl) FILTER (WHERE pnl_pct > 0) / nullif(abs(sum(pnl) FILTER (WHERE NOT pnl_pct > 0)), 0) AS profit_factor,
  ln(1 + max((peak - equity) / peak * 100)) AS log_dd, ln(abs(arg_max(equity, ts * 1))) AS log_final, avg(pnl_pct) / nullif(stddev_samp(pnl_pct) / sqrt(count(*)), 0) AS t_stat FROM (SELECT * REPLACE (epoch(ts)::BIGINT * 1000 + leg AS ts) FROM pk) GROUP BY 1, 2""")]


def frame(spark, folder):
    daily = B.stored_daily(spark, folder)
    vix = cut_lineage(B.index_with_term(spark, folder))
    return cut_lineage(R.rule_frame(cut_lineage(E.daily_features(daily, vix))))


@query("daily_rule_trades", sql("daily vix", *FRAME, *trades_sql(), out=cols("tr_", keys="symbol rule", ints="leg side", nums="entry_price:8 exit_price:8 size pnl_pct:5")))
def daily_rule_trades(spark, folder):
    return report(R.rule_trades(frame(spark, folder)), "symbol", "rule", "ts", "leg", "side", "entry_price:8", "exit_price:8", "size", "pnl_pct:5")


def stats(spark, folder):
    trades = cut_lineage(R.rule_trades(frame(spark, folder)))
    return R.rule_stats(cut_lineage(R.rule_equity(trades)))


@query("daily_rule_stats", sql("daily vix", *FRAME, *trades_sql(), *EQ, out=cols("st_", keys="symbol rule", ts="", ints="n_trades", nums="win_rate avg_pnl:5 profit_factor log_dd log_final:5 t_stat")))
def daily_rule_stats(spark, folder):
    df = stats(spark, folder).withColumns({"log_final": F.ln(F.abs("final_equity")), "log_dd": F.ln(1 + c("max_dd"))})
    return report(df, "symbol", "rule", "n_trades", "win_rate", "avg_pnl:5", "profit_factor", "log_dd", "log_final:5", "t_stat")


@query("term_rule_trades", sql("daily vix", *FRAME, *trades_sql(rules=R.TERM_RULES), out=cols("tr_", keys="symbol rule", ints="leg side", nums="entry_price:8 exit_price:8 size pnl_pct:5")))
def term_rule_trades(spark, folder):
    return report(R.rule_trades(frame(spark, folder), R.TERM_RULES), "symbol", "rule", "ts", "leg", "side", "entry_price:8", "exit_price:8", "size", "pnl_pct:5")


@query("viable_rules", sql("daily vix", *FRAME, *trades_sql(), *EQ, ("good", "SELECT * FROM st_ WHERE profit_factor > 1 AND avg_pnl > 0 AND abs(t_stat) > 1.65 AND n_trades > 20"),
    ("out_", "SELECT symbol, rule, n_trades, profit_factor, 0 AS fallback FROM good UNION ALL SELECT symbol, rule, n_trades, profit_factor, 1 FROM st_ WHERE n_trades > 20 AND NOT EXISTS (SELECT 1 FROM good)"),
    out=cols("out_", keys="symbol rule", ts="", ints="n_trades fallback", nums="profit_factor")))
def viable_rules(spark, folder):
    return report(R.viable(cut_lineage(stats(spark, folder))), "symbol", "rule", "n_trades", "fallback", "profit_factor")


@query("top_configs", sql("daily vix", *FRAME, *trades_sql(), *EQ, ("out_", "SELECT * FROM st_ WHERE n_trades >= 20 ORDER BY profit_factor DESC, symbol, rule LIMIT 10"),
    out=cols("out_", keys="symbol rule", ts="", ints="n_trades", nums="profit_factor")))
def top_configs(spark, folder):
    best = stats(spark, folder).where("n_trades >= 20").orderBy(F.desc_nulls_last("profit_factor"), "symbol", "rule").limit(10)
    return report(best, "symbol", "rule", "n_trades", "profit_factor")


RED = [("q1", "SELECT symbol, ts, (close < open)::INT AS red, (close - open) / open * 100 AS m, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM daily"),
       ("q2", f"SELECT *, coalesce(max(CASE WHEN red = 0 THEN rn END) OVER ({P}), 0) AS calm FROM q1"),
       ("q3", "SELECT *, rn - calm AS run, sum(CASE WHEN red = 1 THEN m ELSE 0 END) OVER (PARTITION BY symbol, calm ORDER BY ts) AS move FROM q2"),
       ("q4", f"SELECT symbol, ts, -coalesce({lag('run')}, 0) AS st, abs(coalesce({lag('move')}, 0)) AS drop_ FROM q3"),
       ("q5", "SELECT rf.* EXCLUDE (st, drop_), q4.st, q4.drop_ FROM rf JOIN q4 USING (symbol, ts)"),
       ("q6", """SELECT symbol, ts, CASE WHEN st <= -3 AND vx < 25 THEN CASE WHEN drop_ >= 5 THEN 10 WHEN drop_ >= 3 THEN 7 ELSE 4 END END AS a,
  CASE WHEN (dow = 0 OR dow = 2) AND vx < 20 THEN CASE WHEN sma200 IS NULL OR close_prev > sma200 THEN 4 ELSE 3 END END AS b, CASE WHEN vx < 15 THEN 2 END AS c,
  CASE WHEN st <= -3 AND gap < -0.3 AND vx < 30 THEN 3 END AS d, CASE WHEN td <= 3 AND vx < 20 THEN 2 END AS e, CASE WHEN st <= -3 AND vx >= 20 AND vx < 25 AND NOT (st <= -3 AND vx < 25) THEN 2 END AS f FROM q5"""),
       ("out_", """SELECT symbol, ts, concat_ws('|', CASE WHEN a > 0 THEN 'MEAN REVERSION' END, CASE WHEN b > 0 THEN 'MON/WED' END, CASE WHEN c > 0 THEN 'CALM MARKET' END, CASE WHEN d > 0 THEN 'GAP DOWN BOUNCE' END,
  CASE WHEN e > 0 THEN 'MONTH-START FLOW' END, CASE WHEN f > 0 THEN 'VIX SWEET SPOT' END) AS reasons, (a > 0 IS TRUE)::INT + (b > 0 IS TRUE)::INT + (c > 0 IS TRUE)::INT + (d > 0 IS TRUE)::INT + (e > 0 IS TRUE)::INT + (f > 0 IS TRUE)::INT AS n_edges,
  coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0) + coalesce(e, 0) + coalesce(f, 0) AS total_size FROM q6""")]


@query("edge_score", sql("daily vix", *FRAME, *RED, out=cols("out_", keys="symbol reasons", ints="n_edges", nums="total_size")))
def edge_score(spark, folder):
    runs = cut_lineage(R.red_runs(B.stored_daily(spark, folder)))
    return report(R.edge_score(frame(spark, folder), runs), "symbol", "reasons", "ts", "n_edges", "total_size")


# E10 by hand: five days from the entry, the stop follows half of the best gain and is not tested on the first day
TRAIL = [("e1", "SELECT symbol, ts, open AS paid, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, high, low, close, st <= -3 AND vx < 25 AS go FROM rf"),
         ("e2", """SELECT symbol, ts, rn, paid, 0 AS d, greatest(paid, high) AS best, CASE WHEN high > paid THEN greatest(paid * 0.99::DOUBLE, paid + 0.5 * (high - paid)) ELSE paid * 0.99::DOUBLE END AS stop,
    NULL::DOUBLE AS hit, close FROM e1 WHERE go
  UNION ALL SELECT e.symbol, e.ts, e.rn, e.paid, e.d + 1, greatest(e.best, b.high), CASE WHEN b.high > e.best THEN greatest(e.stop, e.paid + 0.5 * (b.high - e.paid)) ELSE e.stop END,
    CASE WHEN b.low <= CASE WHEN b.high > e.best THEN greatest(e.stop, e.paid + 0.5 * (b.high - e.paid)) ELSE e.stop END THEN CASE WHEN b.high > e.best THEN greatest(e.stop, e.paid + 0.5 * (b.high - e.paid)) ELSE e.stop END END, b.close
  FROM e2 e JOIN e1 b ON b.symbol = e.symbol AND b.rn = e.rn + e.d + 1 WHERE e.d < 4 AND e.hit IS NULL"""),
         ("e3", "SELECT symbol, ts, any_value(paid) AS entry_price, coalesce(arg_max(hit, d), arg_max(close, d)) AS exit_price FROM e2 GROUP BY 1, 2"),
         ("out_", "SELECT *, (exit_price * 0.9999::DOUBLE - entry_price * 1.0001::DOUBLE) / (entry_price * 1.0001::DOUBLE) * 100 AS pnl_pct FROM e3")]


@query("trailing_rule_trades", sql("daily vix", *FRAME, *TRAIL, out=cols("out_", nums="entry_price:7 exit_price:7 pnl_pct:5")).replace("WITH ", "WITH RECURSIVE ", 1))
def trailing_rule_trades(spark, folder):
    trades = R.trailing_trades(frame(spark, folder), B.stored_daily(spark, folder))
    return report(trades, "symbol", "ts", "entry_price:7", "exit_price:7", "pnl_pct:5")


MR_TRADES = [("mt", f"SELECT symbol, ts, (close * 0.9999::DOUBLE / (open * 1.0001::DOUBLE) - 1) * 100 AS pnl_pct FROM rf WHERE {R.MR}")]


def mr_trades(spark, folder):
    one = [r for r in R.DAILY_RULES if r[0] == "B1"]
    return cut_lineage(R.rule_trades(frame(spark, folder), one))


@query("kelly_sizing", sql("daily vix", *FRAME, *MR_TRADES, ("h", """SELECT *, coalesce(sum((pnl_pct > 0)::INT) OVER w, 0) AS w, coalesce(sum((NOT pnl_pct > 0)::INT) OVER w, 0) AS l, coalesce(sum(CASE WHEN pnl_pct > 0 THEN pnl_pct ELSE 0 END) OVER w, 0) AS ws,
  coalesce(sum(CASE WHEN pnl_pct > 0 THEN 0 ELSE abs(pnl_pct) END) OVER w, 0) AS ls FROM mt WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    ("out_", "SELECT symbol, ts, CASE WHEN w + l >= 10 AND ls > 0 THEN CASE WHEN ws > 0 THEN 100 * greatest(0.02, least(0.15, w / (w + l) - (1 - w / (w + l)) / ((ws / greatest(w, 1)) / (ls / greatest(l, 1))))) ELSE 2 END ELSE 5 END AS size FROM h"),
    out=cols("out_", nums="size")))
def kelly_sizing(spark, folder):
    return report(R.kelly_sized(mr_trades(spark, folder)), "symbol", "ts", "size")


@query("trailing_hold")
def trailing_hold(spark, folder):
    return report(R.trailing_hold(B.stored_daily(spark, folder)), "symbol", "ts", "open", "trail_exit")


@query("drawdown_throttle", sql("daily vix", *FRAME, ("mt", f"SELECT symbol, ts, (close * 0.9999::DOUBLE / (open * 1.0001::DOUBLE) - 1) * 100 AS pnl_pct, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM rf WHERE {R.SCORE} >= 3"),
    ("fold", """SELECT symbol, i, ts, 5.0::DOUBLE AS size, 25000 * (1 + 0.05::DOUBLE * pnl_pct / 100) AS eq, greatest(25000, 25000 * (1 + 0.05::DOUBLE * pnl_pct / 100)) AS peak FROM mt WHERE i = 1
  UNION ALL SELECT m.symbol, m.i, m.ts, z.s, f.eq * (1 + z.s / 100 * m.pnl_pct / 100), greatest(f.peak, f.eq * (1 + z.s / 100 * m.pnl_pct / 100)) FROM fold f JOIN mt m ON m.symbol = f.symbol AND m.i = f.i + 1, LATERAL (SELECT CASE WHEN (f.peak - f.eq) / f.peak * 100 > 0.3 THEN 2.0::DOUBLE ELSE 5.0::DOUBLE END AS s) z"""),
    ("out_", "SELECT symbol, ts, size, ln(eq) AS log_equity FROM fold"), out=cols("out_", nums="size log_equity:5")).replace("WITH ", "WITH RECURSIVE ", 1))
def drawdown_throttle(spark, folder):
    one = [r for r in R.DAILY_RULES if r[0] == "S20"]
    df = R.throttled(cut_lineage(R.rule_trades(frame(spark, folder), one)))
    return report(df.withColumn("log_equity", F.ln("equity")), "symbol", "ts", "size", "log_equity:5")


def intraday_frame(spark, folder):
    """Intraday prices joined with the daily context of the same symbol."""
    bars = cut_lineage(B.resample(B.ticks(spark, folder), "5 minutes"))
    day = cut_lineage(B.rebar(bars, "1 day"))
    context = R.rule_frame(cut_lineage(E.daily_features(day, cut_lineage(B.volatility_index(spark, folder)))), 1).select("symbol", "ts", "st", "vx", "dow")
    return bars, R.intraday_prices(bars).join(context, ["symbol", "ts"])


@query("intraday_rule_trades")
def intraday_rule_trades(spark, folder):
    bars, prices = intraday_frame(spark, folder)
    trades = R.rule_trades(prices, R.INTRADAY_RULES).unionByName(R.range_breaks(bars)).unionByName(R.bracket_trades(bars).drop("reason", "bars_held"))
    return report(trades, "symbol", "rule", "ts", "leg", "side", "entry_price", "exit_price", "size", "pnl_pct")


@query("intraday_rule_stats")
def intraday_rule_stats(spark, folder):
    bars, prices = intraday_frame(spark, folder)
    trades = R.rule_trades(prices, R.INTRADAY_RULES).unionByName(R.range_breaks(bars)).unionByName(R.bracket_trades(bars).drop("reason", "bars_held"))
    return report(R.rule_stats(cut_lineage(R.rule_equity(cut_lineage(trades)))))


@query("buy_hold", sql("daily", ("g", f"SELECT *, close / first_value(close) OVER ({P}) AS growth FROM daily"), ("h", f"SELECT *, growth / max(growth) OVER ({P}) - 1 AS dd FROM g"),
    ("out_", "SELECT symbol, ln(arg_max(growth, ts)) AS log_growth, ln(arg_max(growth, ts)) / (date_diff('day', min(ts), max(ts)) / 365.25) AS cagr_log, min(dd) AS max_dd, count(*) AS n FROM h GROUP BY 1"),
    out=cols("out_", ts="", ints="n", nums="log_growth cagr_log max_dd")))
def buy_hold(spark, folder):
    from barloom.operators.chunks import DAILY, prefix, with_time_chunk
    daily = B.stored_daily(spark, folder)
    first = daily.groupBy("symbol").agg(F.min_by("close", "ts").alias("_first"))
    df = with_time_chunk(daily.join(first, "symbol").withColumn("growth", F.try_divide("close", "_first")), DAILY)
    df = prefix(df, {"peak": ("max", "growth")}).withColumn("dd", F.try_divide("growth", "peak") - 1)
    out = df.groupBy("symbol").agg(
        F.ln(F.max_by("growth", "ts")).alias("log_growth"), (F.date_diff(F.max("ts"), F.min("ts")) / 365.25).alias("_y"),
        F.min("dd").alias("max_dd"), F.count(F.lit(1)).alias("n"))
    return report(out.withColumn("cagr_log", F.try_divide("log_growth", "_y")), "symbol", "n", "log_growth", "cagr_log", "max_dd")
