"""Portfolios of score rules: label backtest, hysteresis, rule scan; studies of extremes and day parts; a user's ordered kernel."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barloom.functions import custom as U
from barloom.functions.rolling import ahead, c, div, flag, full as full_, lag as lag_, lead as lead_
from barloom.operators import features as X
from barloom.operators import ranks as K
from barloom.operators import recursive as R
from barloom.operators import stats as A
from barloom.operators import trades as T
from barloom.operators.chunks import chunked, clean
from barloom.plans.q_features import HUR, RSI, TR, alias, listed
from barloom.plans.q_recursive import ADX, rec
from barloom.plans.q_signals import LABELLED, labelled_trades
from barloom.plans.q_studies import hourly
from barloom.plans.q_trades import STAT_INTS, STAT_NUMS, STATS, exits_sql, recursive, score_steps
from barloom.plans.registry import query, report
from barloom.plans.sqltext import P, cols, full, lag, lead, sql
from barloom.session import cut_lineage
from barloom.sources import bars as B

CAPITAL = 10_000.0


def account(trades, key, order="entry_rn"):
    """Equity of the whole run: no drawdown ends it."""
    return T.account_curve(cut_lineage(trades), "growth", key, CAPITAL, limit=1.0, order=order)


def account_sql(source="gr", key="symbol"):
    w = f"OVER (PARTITION BY {key} ORDER BY rn)"
    return [("eq", f"SELECT *, 10000 * product(1 + growth) {w} AS capital FROM {source}"),
            ("pk", f"SELECT *, capital - capital / (1 + growth) AS pnl, greatest(10000, max(capital) {w}) AS peak FROM eq"),
            ("tq", "SELECT *, (peak - capital) / (peak + 1e-10) AS dd FROM pk"),
            ("st_", STATS.format(k=key).replace("25000", "10000"))]


def positions_sql(source="ex", key="symbol"):
    """One position at a time among ``source``, as ``tk``."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in key.split(", "))
    next_ = " AND ".join(f"n.{k} = p.{k}" for k in key.split(", "))
    a, p = (", ".join(f"{t}.{k}" for k in key.split(", ")) for t in "ap")
    return [("nxt", f"SELECT {a}, a.rn AS prev, min(b.rn) AS rn FROM {source} a JOIN {source} b ON {same} AND b.rn > a.rn + a.bars_held GROUP BY ALL"),
            ("pick", f"SELECT {key}, min(rn) AS rn FROM {source} GROUP BY ALL UNION ALL SELECT {p}, n.rn FROM pick p JOIN nxt n ON {next_} AND n.prev = p.rn"),
            ("tk", f"SELECT {source}.* FROM {source} JOIN pick USING ({key}, rn) WHERE bars_held IS NOT NULL")]


RETURN_INTS = "n_trades n_tp n_sl n_timeout"
RETURN_NUMS = "win_rate avg_ret avg_win avg_loss profit_factor log_growth max_dd:4"


@query("label_backtest", sql("bars", *LABELLED, *account_sql()[:3],
    ("out_", """SELECT symbol, count(*) AS n_trades, avg((growth > 0)::INT) AS win_rate, avg(growth) AS avg_ret, avg(growth) FILTER (WHERE growth > 0) AS avg_win, avg(growth) FILTER (WHERE NOT growth > 0) AS avg_loss,
  sum(growth) FILTER (WHERE growth > 0) / nullif(abs(sum(growth) FILTER (WHERE NOT growth > 0)), 0) AS profit_factor, sum(ln(1 + growth)) AS log_growth, max(dd) * 100 AS max_dd,
  count(*) FILTER (WHERE reason = 'TP') AS n_tp, count(*) FILTER (WHERE reason = 'SL') AS n_sl, count(*) FILTER (WHERE reason = 'TIMEOUT') AS n_timeout FROM tq GROUP BY 1"""),
    out=cols("out_", ts="", ints=RETURN_INTS, nums=RETURN_NUMS)))
def label_backtest(spark, folder):
    """Equity and statistics of the label-driven backtest."""
    df = T.return_stats(account(labelled_trades(spark, folder), ["symbol"], "rn"), ["symbol"], "rn")
    return report(df, "symbol", *RETURN_INTS.split(), *RETURN_NUMS.split())


HYSTERESIS = [
    *score_steps(), ("en", "SELECT symbol, ts, rn, close, close * (1 - CASE WHEN atr_pct / 100 < 0.0025 THEN 0.05::DOUBLE WHEN atr_pct / 100 < 0.005 THEN 0.05::DOUBLE ELSE 0.08::DOUBLE END) AS lo, close * (1 + CASE WHEN atr_pct / 100 < 0.0025 THEN 0.02::DOUBLE WHEN atr_pct / 100 < 0.005 THEN 0.03::DOUBLE ELSE 0.04::DOUBLE END) AS hi FROM s2 WHERE long_prob > 0.55"),
    ("fo", """SELECT e.symbol, e.rn, b.rn - e.rn AS k, CASE WHEN b.low <= lo THEN 'SL' WHEN b.high >= hi THEN 'TP' WHEN b.long_prob < 0.45 THEN 'SIGNAL' WHEN b.rn - e.rn >= 72 THEN 'TIMEOUT' END AS reason,
  CASE WHEN b.low <= lo THEN lo WHEN b.high >= hi THEN hi ELSE b.close END AS px FROM en e JOIN s2 b ON e.symbol = b.symbol AND b.rn BETWEEN e.rn + 1 AND e.rn + 72"""),
    ("fi", "SELECT symbol, rn, min(k) AS k, arg_min(reason, k) AS reason, arg_min(px, k) AS px FROM fo WHERE reason IS NOT NULL GROUP BY 1, 2"),
    ("la", "SELECT symbol, max(rn) AS rn, arg_max(close, rn) AS px FROM s2 GROUP BY 1"),
    ("ex", """SELECT en.symbol, en.ts, en.rn, 1 AS side, coalesce(fi.reason, 'EOD') AS reason, coalesce(fi.k, la.rn - en.rn) AS bars_held, coalesce(fi.px, la.px) / en.close - 1 AS gross_ret
  FROM en LEFT JOIN fi ON fi.symbol = en.symbol AND fi.rn = en.rn JOIN la ON la.symbol = en.symbol"""),
    *positions_sql(), ("gr", "SELECT *, (1 - 0.0006::DOUBLE) * (1 - 0.0006::DOUBLE) * (1 + gross_ret) - 1 AS growth FROM tk"), *account_sql()]


def hysteresis_account(spark, folder, hold=72):
    df = X.scores(X.atr(chunked(B.stored_bars(spark, folder), before=80, after=hold)))
    bar = F.struct("high", "low", "close", c("long_prob").alias("p"))
    df = df.withColumn("_next", F.collect_list(bar).over(ahead(X.W, hold))).where(c("_own") & (c("long_prob") > 0.55))
    df = df.select("symbol", "ts", c("_rn").alias("entry_rn"), "close", c("long_prob").alias("p"), (c("atr_pct") / 100).alias("atr_share"), "_next")
    return account(T.hysteresis_trades(df, hold=hold), ["symbol"])


@query("hysteresis_portfolio", recursive(sql("bars", *HYSTERESIS, out=cols("tq", keys="symbol reason", ints="bars_held", nums="gross_ret capital:3 pnl:3 dd"))))
def hysteresis_portfolio(spark, folder):
    return report(hysteresis_account(spark, folder), "symbol", "reason", "ts", "bars_held", "gross_ret", "capital:3", "pnl:3", "dd")


@query("hysteresis_stats", recursive(sql("bars", *HYSTERESIS, out=cols("st_", ts="", ints=STAT_INTS, nums=STAT_NUMS))))
def hysteresis_stats(spark, folder):
    return report(T.trade_stats(hysteresis_account(spark, folder), ["symbol"], CAPITAL), "symbol", *STAT_INTS.split(), *STAT_NUMS.split())


# --- rule scan ------------------------------------------------------------------------------

#: Name and condition of every scanned rule, over score, RSI, CCI, volume and its 20-bar mean.
SCAN_RULES = [*[(f"score {t / 100:.2f}", f"long_prob > {t}e-2") for t in range(50, 95, 5)],
              ("rsi high", "rsi_14 > 75"), ("volume up", "volume > 2 * volume_20 AND close > open"), ("rsi low", "rsi_14 < 30"),
              ("score rsi", "long_prob > 0.6D AND rsi_14 > 60"), ("score cci", "long_prob > 0.6D AND cci < -100")]
SCANNED = [
    *score_steps(), ("g0", alias({"d": f"close - {lag('close')}", "tp": "(high + low + close) / 3"}, "s2")),
    ("g1", alias({"gain": "CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END", "loss": "CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END",
                  "vals": listed("tp", 20), "mean": full("avg", "tp", 20), "volume_20": full("avg", "volume", 20)}, "g0")),
    ("g2", alias({"ag": full("avg", "gain", 14), "al": full("avg", "loss", 14)}, "g1")),
    ("g3", alias({"rsi_14": RSI, "cci": "CASE WHEN mean IS NOT NULL THEN coalesce((tp - mean) / nullif(0.015 * list_sum(list_transform(vals, lambda v: abs(v - mean))) / 20, 0), 0) END"}, "g2")),
    ("sg", " UNION ALL ".join(f"SELECT symbol, rn, '{n}' AS strategy FROM g3 WHERE atr > 0 AND {cond.replace('0.6D', '6e-1')}" for n, cond in SCAN_RULES)),
    ("ent", "SELECT symbol, ts, rn, 1 AS side, close * (1 + 0.0002::DOUBLE) AS ep, atr, atr_pct, 0 AS atr_median FROM g3 WHERE (symbol, rn) IN (SELECT symbol, rn FROM sg)"),
    *exits_sql(4.0, 2.0, 12, "fixed", 1.0), ("sx", "SELECT ex.*, strategy FROM ex JOIN sg USING (symbol, rn)"), *positions_sql("sx", "symbol, strategy"),
    ("gr", "SELECT *, least(0.02::DOUBLE / (2 * atr / entry_price), 0.25) * (gross_ret - 0.0019::DOUBLE) AS growth FROM tk"), *account_sql(key="symbol, strategy"),
    ("out_", "SELECT * REPLACE (CASE WHEN n_trades > 1 THEN sharpe END AS sharpe) FROM st_")]


@query("rule_scan", recursive(sql("bars", *SCANNED, out=cols("out_", keys="symbol strategy", ts="", ints=STAT_INTS, nums=STAT_NUMS))))
def rule_scan(spark, folder, hold=12):
    """Score thresholds and mixed rules, each with costs, risk sizing and one position at a time; exits are resolved once a bar."""
    df = chunked(B.stored_bars(spark, folder), before=80, after=hold)
    df = X.cci_williams(X.rsi(X.scores(X.atr(T.with_future(df, hold))))).withColumn("volume_20", full_(F.avg, "volume", 20, X.W))
    hits = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in SCAN_RULES]))
    df = df.where("_own").withColumn("strategies", hits).where((c("atr_14") > 0) & (F.size("strategies") > 0))
    exits = T.resolve_exits(df.select(
        "symbol", "ts", c("_rn").alias("entry_rn"), "strategies", "_future", F.lit(1).alias("side"), (c("close") * (1 + 0.0002)).alias("entry_price"),
        c("atr_14").alias("atr_entry"), F.lit(4.0).alias("tp_mult"), F.lit(2.0).alias("sl_mult"), F.lit(hold).alias("hold"),
        F.lit("fixed").alias("exit_mode"), F.lit(1.0).alias("trail_mult")))
    runs = cut_lineage(exits.withColumn("strategy", F.explode("strategies")).drop("strategies"))
    trades = T.one_at_a_time(runs, ["symbol", "strategy"], hold).where("bars_held is not null")
    trades = trades.withColumn("growth", T.risk_fraction(F.lit(0.02)) * (c("gross_ret") - 0.0019))
    key = ["symbol", "strategy"]
    stats = T.trade_stats(account(trades, key), key, CAPITAL).withColumn("sharpe", F.when(c("n_trades") > 1, c("sharpe")))
    return report(stats, *key, *STAT_INTS.split(), *STAT_NUMS.split())


# --- studies --------------------------------------------------------------------------------

EXTREME = ("x_", " UNION ALL ".join(
    f"SELECT symbol, {t} AS threshold, '{n}' AS side, {h} AS horizon, {lead_sql} AS r FROM fw WHERE {cond}"
    for t in (20, 25, 30) for n, cond in (("oversold", f"rsi_14 < {t}"), ("overbought", f"rsi_14 > {100 - t}"))
    for h in (4, 12, 24) for lead_sql in (f"f{h}",)))


@query("rsi_extremes", sql("bars", ("g0", alias({"d": f"close - {lag('close')}"})),
    ("g1", alias({"gain": "CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END", "loss": "CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END"}, "g0")),
    ("g2", alias({"ag": full("avg", "gain", 14), "al": full("avg", "loss", 14)}, "g1")),
    ("fw", alias({"rsi_14": RSI, **{f"f{h}": f"{lead('close', h)} / close - 1" for h in (4, 12, 24)}}, "g2")), EXTREME,
    ("out_", "SELECT symbol, threshold, side, horizon, count(r) AS n, avg(r) AS mean, avg(r) / nullif(stddev_samp(r) / sqrt(count(r)), 0) AS t_stat, avg((CASE side WHEN 'oversold' THEN r > 0 ELSE r < 0 END)::INT) AS win_rate FROM x_ WHERE r IS NOT NULL GROUP BY ALL"),
    out=cols("out_", keys="symbol side", ts="", ints="threshold horizon n", nums="mean t_stat win_rate")))
def rsi_extremes(spark, folder, thresholds=(20, 25, 30), horizons=(4, 12, 24)):
    """Mean, t against zero and share in the expected direction of the returns after oversold and overbought bars."""
    df = X.rsi(chunked(B.stored_bars(spark, folder), before=16, after=max(horizons)))
    df = clean(df.withColumns({f"r{h}": div(lead_("close", h, X.W), "close") - 1 for h in horizons}))
    cells = [F.when(low, F.struct(F.lit(t).alias("threshold"), F.lit(side).alias("side"), F.lit(h).alias("horizon"), c(f"r{h}").alias("r")))
             for t in thresholds for side, low in (("oversold", c("rsi_14") < t), ("overbought", c("rsi_14") > 100 - t)) for h in horizons]
    df = df.select("symbol", F.explode(F.array_compact(F.array(*cells))).alias("_x")).select("symbol", "_x.*").where("r is not null")
    right = F.when(c("side") == "oversold", c("r") > 0).otherwise(c("r") < 0)
    return report(df.groupBy("symbol", "side", "threshold", "horizon").agg(
        F.count("r").alias("n"), F.avg("r").alias("mean"), F.try_divide(F.avg("r"), F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("t_stat"),
        F.avg(flag(right)).alias("win_rate")))


@query("day_parts", sql("bars", ("h_", f"SELECT *, close / {lag('close')} - 1 AS ret, hour(timezone('America/New_York', timezone('UTC', ts))) AS h FROM bars"),
    ("p_", "SELECT *, CASE WHEN h = 9 THEN 'first hour' WHEN h = 15 THEN 'last hour' WHEN h BETWEEN 11 AND 13 THEN 'mid-day' END AS part FROM h_ WHERE ret IS NOT NULL"),
    ("out_", """SELECT part, count(ret) AS n, avg(ret) AS mean, median(ret) AS median, stddev_samp(ret) AS std, stddev_samp(ret) * sqrt(252) AS volatility, avg((ret > 0)::INT) AS pos_share,
  avg(ret) / nullif(stddev_samp(ret) / sqrt(count(ret)), 0) AS t_stat, avg(volume) AS avg_volume FROM p_ WHERE part IS NOT NULL GROUP BY 1"""),
    out=cols("out_", keys="part", ts="", ints="n", nums="mean median std volatility pos_share t_stat avg_volume")))
def day_parts(spark, folder):
    """First hour, last hour and mid-day in New York: returns, their spread and the volume."""
    hour = F.hour(F.from_utc_timestamp("ts", "America/New_York"))
    part = F.when(hour == 9, "first hour").when(hour == 15, "last hour").when(hour.between(11, 13), "mid-day")
    df = hourly(spark, folder).withColumn("part", part).where("part is not null and ret is not null")
    volume = df.groupBy("part").agg(F.avg("volume").alias("avg_volume"))
    out = A.group_stats(df, "ret", ["part"]).join(volume, "part").withColumn("volatility", c("std") * F.lit(252 ** 0.5))
    return report(out, "part", "n", "mean", "median", "std", "volatility", "pos_share", "t_stat", "avg_volume")


MASKS = {"trending adx": "adx > 25", "ranging adx": "adx < 20", "trending hurst": "hurst_exp > 0.55", "reverting hurst": "hurst_exp < 0.45",
         "high volatility": "atr_pct > q75", "low volatility": "atr_pct < q25"}
MASKED = [
    *ADX[:-1], ("ax", ADX[-1][1]), *[(f"h{n}", re.sub(r"FROM (n|t)$", r"FROM h\1", body)) for n, body in HUR[:-1]],
    ("hx", re.sub(r"FROM h$", "FROM hh", HUR[-1][1])), ("vx_", alias({"tr": TR})),
    ("vy_", alias({"atr_pct": f"{full('avg', 'tr', 14)} / close * 100", "mom": f"ln(close / {lag('close', 12)})", "fwd": f"{lead('close', 8)} / close - 1"}, "vx_")),
    ("vz_", "SELECT v.*, a.adx, h.hurst_exp FROM vy_ v LEFT JOIN ax a USING (symbol, ts) LEFT JOIN hx h USING (symbol, ts) WHERE mom IS NOT NULL AND fwd IS NOT NULL"),
    ("vq_", "SELECT quantile_cont(atr_pct, 0.25) AS q25, quantile_cont(atr_pct, 0.75) AS q75 FROM vz_"),
    ("vm_", " UNION ALL ".join(f"SELECT '{n}' AS regime, mom, (fwd > 0)::INT AS label FROM vz_, vq_ WHERE {cond}" for n, cond in MASKS.items())),
    ("vr_", "SELECT *, rank() OVER (PARTITION BY regime ORDER BY mom) + (count(*) OVER (PARTITION BY regime, mom) - 1) / 2 AS rk FROM vm_"),
    ("vo_", "SELECT regime, count(*) AS n, (sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auc FROM vr_ GROUP BY 1")]


@query("regime_masks", rec("bars", *MASKED, out=cols("vo_", keys="regime", ts="", ints="n", nums="auc")))
def regime_masks(spark, folder):
    """How well momentum ranks the next eight bars in trending, ranging, reverting, calm and wild markets."""
    bars = B.stored_bars(spark, folder)
    df = X.atr(chunked(bars, before=16, after=8))
    df = clean(df.withColumns({"mom": F.ln(div("close", lag_("close", 12, X.W))), "fwd": div(lead_("close", 8, X.W), "close") - 1}))
    df = df.where("mom is not null and fwd is not null").select("symbol", "ts", "mom", "fwd", "atr_pct")
    df = df.join(cut_lineage(R.wilder_atr_adx(bars).select("symbol", "ts", "adx")), ["symbol", "ts"], "left")
    df = cut_lineage(df.join(cut_lineage(X.hurst_exponent(bars).select("symbol", "ts", "hurst_exp")), ["symbol", "ts"], "left"))
    cut = K.quantiles(df, "atr_pct", {"q25": .25, "q75": .75}).select(F.struct("q25", "q75")).scalar()
    df = df.withColumn("_q", cut).select("*", "_q.*")
    hits = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in MASKS.items()]))
    rows = cut_lineage(df.select("mom", flag(c("fwd") > 0).alias("label"), F.explode(hits).alias("regime")))
    return report(K.auc(rows, "mom", "label", ["regime"]), "regime", "n", "auc")


# --- a user's ordered kernel ----------------------------------------------------------------

CUSUM = [("c0", f"SELECT symbol, ts, date_trunc('day', ts) AS day, coalesce(ln(close / {lag('close')}), 0) AS r FROM bars"),
         ("c1", "SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts) AS i FROM c0"),
         ("c2", """SELECT symbol, day, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, 0::DOUBLE AS up, 0::DOUBLE AS down, 0 AS side FROM c1 WHERE i = 1
  UNION ALL SELECT c.symbol, c.day, c.i, c.ts, CASE WHEN s.up + c.r > 0.02 THEN 0 ELSE greatest(0, s.up + c.r) END,
    CASE WHEN s.up + c.r > 0.02 THEN least(0, s.down + c.r) WHEN s.down + c.r < -0.02 THEN 0 ELSE least(0, s.down + c.r) END,
    CASE WHEN s.up + c.r > 0.02 THEN 1 WHEN s.down + c.r < -0.02 THEN -1 ELSE 0 END
  FROM c2 s JOIN c1 c ON c.symbol = s.symbol AND c.day = s.day AND c.i = s.i + 1""")]


@query("cusum_events", recursive(sql("bars", *CUSUM, out=cols("c2", ints="side", where="side <> 0"))))
def cusum_events(spark, folder):
    """Bars at which the day's summed returns, restarted at every event, leave a band of two percent."""
    df = clean(chunked(B.stored_bars(spark, folder), before=1).withColumn("r", F.coalesce(F.ln(div("close", lag_("close", 1, X.W))), F.lit(0.0))))
    df = df.select("symbol", F.date_trunc("day", "ts").alias("day"), "ts", "r")
    return report(U.ordered_kernel(df, U.cusum(0.02), "symbol string, ts timestamp, side int", ["symbol", "day"], ["ts"]), "symbol", "ts", "side")
