"""Score signals, live signal rows, sizing and risk rules, account rules, remaining trade reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import signals as G
from barloom.functions.rolling import c, div, flag, full as full_, lag as lag_
from barloom.operators import align as A
from barloom.operators import features as X
from barloom.operators import ranks as K
from barloom.operators import sweep as S
from barloom.operators import trades as T
from barloom.operators.chunks import chunked, clean, owned, prefix
from barloom.plans.q_features import alias
from barloom.plans.q_sources import bars_with_funding
from barloom.plans.q_trades import entries_sql, equity_sql, exits_df, exits_sql, one_run, recursive, score_steps
from barloom.plans.registry import query, report
from barloom.plans.sqltext import P, cols, full, lag, lead, roll, sql
from barloom.session import cut_lineage
from barloom.sources import bars as B

PRED = ("pr", alias({"pred": f"0.001::DOUBLE * (close / {lag('close', 12)} - 1)"}))


def predicted(spark, folder):
    """A deterministic stand-in for model output: 0.1% of the 12-bar momentum."""
    df = chunked(B.stored_bars(spark, folder), before=13)
    return clean(df.withColumn("pred", 0.001 * (div("close", lag_("close", 12, X.W)) - 1)))


@query("signal_strength", sql("bars", PRED, ("out_", "SELECT symbol, ts, 1 / (1 + exp(-200 * pred)) AS long_strength, 1 / (1 + exp(200 * pred)) AS short_strength FROM pr"), out=cols("out_", nums="long_strength short_strength")))
def signal_strength(spark, folder):
    up, down = G.strengths(c("pred"))
    return report(predicted(spark, folder).select("symbol", "ts", up.alias("long_strength"), down.alias("short_strength")))


@query("funding_boost", sql("bars_f", *score_steps("bars_f"), ("out_", "SELECT symbol, ts, CASE WHEN funding_rate > 0 THEN least(short_prob * 1.15::DOUBLE, 1) WHEN funding_rate < -0.0003::DOUBLE THEN short_prob * 0.9::DOUBLE ELSE short_prob END AS boosted FROM s2"), out=cols("out_", nums="boosted")))
def funding_boost(spark, folder):
    df = X.features(bars_with_funding(spark, folder), X.scores)
    return report(df.select("symbol", "ts", G.funding_boost(c("short_prob"), c("funding_rate")).alias("boosted")))


@query("momentum_filter", sql("bars", *score_steps(), ("r_", f"SELECT *, coalesce(ln(close / {lag('close')}), 0) AS r FROM s2"),
    ("m_", alias({"f6": roll("sum", "r", 6), "f24": roll("sum", "r", 24)}, "r_")),
    ("out_", "SELECT symbol, ts, CASE WHEN rn >= 24 AND f6 > f24 * 0.25 + 0.003::DOUBLE THEN NULL ELSE short_prob END AS filtered FROM m_"), out=cols("out_", nums="filtered")))
def momentum_filter(spark, folder):
    df = X.scores(chunked(B.stored_bars(spark, folder), before=90)).withColumn("_r", F.coalesce(F.ln(div("close", lag_("close", 1, X.W))), F.lit(0.0)))
    df = df.withColumns({"f6": F.sum("_r").over(X.W.rowsBetween(-5, 0)), "f24": F.sum("_r").over(X.W.rowsBetween(-23, 0)), "row": c("_rn")})
    return report(clean(df).select("symbol", "ts", G.momentum_filter(c("short_prob"), c("f6"), c("f24"), c("row")).alias("filtered")))


@query("uncertainty_filter", sql("bars", ("v", alias({"pred": f"close / {lag('close', 12)} - 1", "sd": full("stddev_samp", "close", 24)}, "bars")), ("w", "SELECT *, 2 * ln(sd / close) AS lv FROM v WHERE sd > 0"),
    ("out_", "SELECT symbol, ts, CASE WHEN abs(pred) / exp(lv / 2) >= 1 THEN 1 / (1 + exp(-200 * pred)) END AS lg, CASE WHEN abs(pred) / exp(lv / 2) >= 1 THEN 1 / (1 + exp(200 * pred)) END AS sh FROM w"), out=cols("out_", nums="lg sh")))
def uncertainty_filter(spark, folder):
    df = chunked(B.stored_bars(spark, folder), before=25)
    df = clean(df.withColumns({"pred": div("close", lag_("close", 12, X.W)) - 1, "sd": full_(F.stddev_samp, "close", 24, X.W)})).where("sd > 0")
    up, down = G.uncertainty_filter(c("pred"), 2 * F.ln(div("sd", "close")))
    return report(df.select("symbol", "ts", up.alias("lg"), down.alias("sh")))


QUANT = ("qp", f"SELECT symbol, ts, " + ", ".join(f"CASE WHEN count(r) OVER w >= 24 THEN quantile_cont(r, {q}) OVER w END AS q{int(q * 100)}" for q in (.1, .25, .5, .75, .9)) + f" FROM (SELECT *, close / {lag('close')} - 1 AS r FROM bars) WINDOW w AS ({P} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)")


def quantile_predictions(spark, folder):
    df = chunked(B.stored_bars(spark, folder), before=26).withColumn("_r", div("close", lag_("close", 1, X.W)) - 1)
    df = df.withColumn("_q", full_(lambda x: F.percentile(x, F.array(*[F.lit(q) for q in (.1, .25, .5, .75, .9)])), "_r", 24, X.W))
    return clean(df.withColumns({f"q{n}": c("_q")[i] for i, n in enumerate((10, 25, 50, 75, 90))}))


@query("quantile_filters", sql("bars", QUANT, ("md", "SELECT median(q90 - q10) AS ms FROM qp WHERE q50 IS NOT NULL"),
    ("out_", """SELECT symbol, ts, CASE WHEN q25 > 0 THEN 1 / (1 + exp(-200 * q50)) END AS strict_long, CASE WHEN q75 < 0 THEN 1 / (1 + exp(200 * q50)) END AS strict_short,
  CASE WHEN q50 > 0 AND q90 - q10 < ms THEN 1 / (1 + exp(-200 * q50)) END AS medium_long, CASE WHEN q50 < 0 AND q90 - q10 < ms THEN 1 / (1 + exp(200 * q50)) END AS medium_short,
  CASE WHEN q50 > 0 THEN 1 / (1 + exp(-q50 * 5 / (q90 - q10 + 1e-6))) END AS relaxed_long, CASE WHEN q50 < 0 THEN 1 / (1 + exp(q50 * 5 / (q90 - q10 + 1e-6))) END AS relaxed_short FROM qp, md"""),
    out=cols("out_", nums="strict_long strict_short medium_long medium_short relaxed_long relaxed_short")))
def quantile_filters(spark, folder):
    df = cut_lineage(quantile_predictions(spark, folder).withColumn("spread", c("q90") - c("q10")))
    median = K.quantiles(df.where("q50 is not null"), "spread", {"m": 0.5}).scalar()
    df = df.withColumn("median_spread", median)
    out = {}
    for kind in ("strict", "medium", "relaxed"):
        out[f"{kind}_long"], out[f"{kind}_short"] = G.quantile_filter(kind)
    return report(df.select("symbol", "ts", *[e.alias(n) for n, e in out.items()]))


@query("percentile_signals", sql("bars", *score_steps(), *entries_sql(0.1), ("out_", "SELECT * FROM ent WHERE NOT (hour(ts) >= 6 AND hour(ts) < 10)"), out=cols("out_", ints="side", nums="long_prob short_prob")))
def percentile_signals(spark, folder):
    grid = S.Grid(percentiles=(0.1,), directions=("both",), hours=(("skip0610", 6, 10),))
    frame = cut_lineage(S.scored_frame(B.stored_bars(spark, folder), 1))
    entries = S.entry_signals(frame, S.score_thresholds(frame.select("symbol", "long_prob", "short_prob"), (0.1,)), grid)
    return report(entries, "symbol", "ts", "side", "long_prob", "short_prob")


@query("confirmation_filter", sql("bars", *score_steps(), ("md", "SELECT symbol, median(long_prob) AS lm, median(short_prob) AS sm FROM s2 GROUP BY 1"),
    ("out_", "SELECT symbol, ts, coalesce(long_prob >= 0.7 AND short_prob < sm, false)::INT AS long_ok, coalesce(short_prob >= 0.7 AND long_prob < lm, false)::INT AS short_ok FROM s2 JOIN md USING (symbol)"), out=cols("out_", ints="long_ok short_ok")))
def confirmation_filter(spark, folder):
    df = cut_lineage(X.features(B.stored_bars(spark, folder), X.scores))
    mids = K.quantiles(df, "long_prob", {"lm": .5}, ["symbol"]).join(K.quantiles(df, "short_prob", {"sm": .5}, ["symbol"]), "symbol")
    return report(df.join(mids, "symbol").select("symbol", "ts", flag((c("long_prob") >= 0.7) & (c("short_prob") < c("sm"))).alias("long_ok"),
                                                 flag((c("short_prob") >= 0.7) & (c("long_prob") < c("lm"))).alias("short_ok")))


@query("probability_actions", sql("bars", *score_steps(), ("m_", alias({"ma": full("avg", "close", 50)}, "s2")),
    ("out_", "SELECT symbol, ts, CASE WHEN long_prob >= 0.6 AND close > ma THEN 'ENTER' WHEN short_prob >= 0.6 AND close < ma THEN 'ENTER' WHEN greatest(long_prob, short_prob) < 0.52 THEN 'CLOSE' ELSE 'HOLD' END AS action, CASE WHEN long_prob >= 0.6 AND close > ma THEN 'Buy' WHEN short_prob >= 0.6 AND close < ma THEN 'Sell' ELSE 'None' END AS side, concat_ws('|', CASE WHEN long_prob >= 0.6 THEN 'up' WHEN short_prob >= 0.6 THEN 'down' ELSE 'weak' END, CASE WHEN close > ma THEN 'above trend' ELSE 'below trend' END) AS reasons FROM m_ WHERE long_prob IS NOT NULL AND ma IS NOT NULL"),
    out=cols("out_", keys="symbol action side reasons")))
def probability_actions(spark, folder):
    df = X.scores(chunked(B.stored_bars(spark, folder), before=80)).withColumn("ma", full_(F.avg, "close", 50, X.W))
    df = clean(df).where("long_prob is not null and ma is not null")
    up, down = (c("long_prob") >= 0.6) & (c("close") > c("ma")), (c("short_prob") >= 0.6) & (c("close") < c("ma"))
    action = F.when(up | down, "ENTER").when(F.greatest("long_prob", "short_prob") < 0.52, "CLOSE").otherwise("HOLD")
    side = F.when(up, "Buy").when(down, "Sell").otherwise("None")
    why = F.array(F.when(c("long_prob") >= 0.6, "up").when(c("short_prob") >= 0.6, "down").otherwise("weak"),
                  F.when(c("close") > c("ma"), "above trend").otherwise("below trend"))
    return report(df.select("symbol", "ts", action.alias("action"), side.alias("side"), F.array_join(why, "|").alias("reasons")))


@query("live_signal", sql("bars", *score_steps(), ("th", "SELECT symbol, quantile_cont(long_prob, 0.8) AS l20, quantile_cont(long_prob, 0.9) AS l10, quantile_cont(short_prob, 0.8) AS s20, quantile_cont(short_prob, 0.9) AS s10, quantile_cont(atr_pct, 0.25) AS a25 FROM s2 GROUP BY 1"),
    ("nw", "SELECT * FROM (SELECT s2.*, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS p FROM s2) JOIN th USING (symbol) WHERE p = 1"),
    ("ac", "SELECT *, CASE WHEN atr_pct < a25 THEN 0 WHEN long_prob >= l20 THEN 1 WHEN short_prob >= s20 THEN -1 ELSE 0 END AS side FROM nw"),
    ("out_", "SELECT symbol, ts, CASE side WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'HOLD' END AS action, CASE WHEN side = 0 THEN 'none' WHEN side = 1 AND long_prob >= l10 OR side = -1 AND short_prob >= s10 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN side <> 0 THEN close - side * 1.5 * atr END AS stop_loss, CASE WHEN side <> 0 THEN close + side * 3 * atr END AS take_profit, CASE WHEN side <> 0 THEN close - side * 0.75 * atr END AS trail, CASE WHEN side <> 0 THEN 250 / (1.5 * atr) END AS size FROM ac"),
    out=cols("out_", keys="symbol action confidence", nums="stop_loss take_profit trail size")))
def live_signal(spark, folder):
    """Newest row per symbol with action, confidence tier, levels and size."""
    df = cut_lineage(X.features(B.stored_bars(spark, folder), X.scores, X.atr))
    cuts = (K.quantiles(df, "long_prob", {"l20": .8, "l10": .9}, ["symbol"]).join(K.quantiles(df, "short_prob", {"s20": .8, "s10": .9}, ["symbol"]), "symbol")
            .join(K.quantiles(df, "atr_pct", {"a25": .25}, ["symbol"]), "symbol"))
    newest = A.pick(df.select("symbol", "ts", "close", "atr_14", "atr_pct", "long_prob", "short_prob"), ["symbol"], "ts", newest=True).join(cuts, "symbol")
    side = F.when(c("atr_pct") < c("a25"), 0).when(c("long_prob") >= c("l20"), 1).when(c("short_prob") >= c("s20"), -1).otherwise(0)
    df = newest.withColumn("side", side)
    strong = ((c("side") == 1) & (c("long_prob") >= c("l10"))) | ((c("side") == -1) & (c("short_prob") >= c("s10")))
    level = lambda m: F.when(c("side") != 0, c("close") + c("side") * m * c("atr_14"))
    return report(df.select(
        "symbol", "ts", F.when(c("side") == 1, "BUY").when(c("side") == -1, "SELL").otherwise("HOLD").alias("action"),
        F.when(c("side") == 0, "none").when(strong, "high").otherwise("medium").alias("confidence"),
        level(-1.5).alias("stop_loss"), level(3.0).alias("take_profit"), level(-0.75).alias("trail"),
        F.when(c("side") != 0, F.try_divide(F.lit(250.0), 1.5 * c("atr_14"))).alias("size")))


@query("risk_levels", sql("bars", *score_steps(), ("a_", "SELECT *, atr_pct / 100 AS ash, CASE WHEN long_prob > 0.6 THEN 'bull' WHEN long_prob < 0.4 THEN 'bear' ELSE 'sideways' END AS regime, coalesce(long_prob >= 0.5, false) AS lg FROM s2 WHERE atr IS NOT NULL"),
    ("b_", "SELECT *, CASE WHEN ash < 0.005 THEN 0.05::DOUBLE ELSE 0.08::DOUBLE END * CASE regime WHEN 'bull' THEN 0.9::DOUBLE WHEN 'bear' THEN 1.2::DOUBLE ELSE 0.85::DOUBLE END AS sl, CASE WHEN ash < 0.0025 THEN 0.02::DOUBLE WHEN ash < 0.005 THEN 0.03::DOUBLE ELSE 0.04::DOUBLE END * CASE regime WHEN 'bull' THEN 1.5::DOUBLE WHEN 'bear' THEN 0.7::DOUBLE ELSE 0.85::DOUBLE END AS tp FROM a_"),
    ("out_", "SELECT symbol, ts, regime, close * (1 - CASE WHEN lg THEN 1 ELSE -1 END * sl) AS stop_price, close * (1 + CASE WHEN lg THEN 1 ELSE -1 END * tp) AS target_price, floor(least(10000 * 0.01::DOUBLE / 0.02::DOUBLE * CASE WHEN long_prob >= 0.7 THEN 1 WHEN long_prob >= 0.6 THEN 0.7::DOUBLE WHEN long_prob >= 0.55 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END, 1000, 5000) / close * 1000) / 1000 AS quantity FROM b_"),
    out=cols("out_", keys="symbol regime", nums="stop_price:7 target_price:7 quantity")))
def risk_levels(spark, folder):
    df = X.features(B.stored_bars(spark, folder), X.scores, X.atr).where("atr_14 is not null")
    df = df.withColumn("regime", F.when(c("long_prob") > 0.6, "bull").when(c("long_prob") < 0.4, "bear").otherwise("sideways"))
    stop, target = G.stop_target(c("close"), F.coalesce(c("long_prob") >= 0.5, F.lit(False)), c("atr_pct") / 100, c("regime"))
    return report(df.select("symbol", "regime", "ts", stop.alias("stop_price"), target.alias("target_price"),
                            G.position_size(F.lit(10_000.0), c("close"), c("long_prob")).alias("quantity")), "symbol", "regime", "ts", "stop_price:7", "target_price:7", "quantity")


_DECIDED = "CASE WHEN {p} <= -200 THEN 'daily loss' WHEN {n} >= 2 THEN 'daily trades' ELSE 'ok' END"
ADMIT = [("tx", "SELECT symbol, ts, pnl, date_trunc('day', ts) AS day, row_number() OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY rn) AS i FROM tq"),
         ("ad", f"""SELECT symbol, day, i, ts, 'ok' AS decision, 0::BIGINT AS day_trades, 0::DOUBLE AS day_pnl, 1::BIGINT AS n, pnl::DOUBLE AS p FROM tx WHERE i = 1
  UNION ALL SELECT t.symbol, t.day, t.i, t.ts, {_DECIDED.format(p='a.p', n='a.n')}, a.n, a.p, a.n + ({_DECIDED.format(p='a.p', n='a.n')} = 'ok')::INT, a.p + CASE WHEN {_DECIDED.format(p='a.p', n='a.n')} = 'ok' THEN t.pnl ELSE 0 END
  FROM ad a JOIN tx t ON t.symbol = a.symbol AND t.day = a.day AND t.i = a.i + 1""")]


@query("trade_admission", equity_sql(*ADMIT, out=cols("ad", keys="symbol decision", ints="day_trades", nums="day_pnl:3")))
def trade_admission(spark, folder):
    """Admission by the day's result and trades so far; a refused trade changes neither."""
    trades, _ = one_run(spark, folder)
    return report(G.admitted(trades), "symbol", "decision", "ts", "day_trades", "day_pnl:3")


@query("order_validation", sql("ticks", ("out_", "SELECT symbol, CASE WHEN qty <= 0 THEN 'quantity' WHEN price <= 0 THEN 'price' WHEN qty * price > 3000 THEN 'too large' WHEN qty * price < 5 THEN 'too small' ELSE 'ok' END AS verdict, count(*) AS n FROM ticks GROUP BY 1, 2"),
    out=cols("out_", keys="symbol verdict", ts="", ints="n")))
def order_validation(spark, folder):
    df = B.ticks(spark, folder).withColumn("verdict", F.coalesce(G.order_problem(c("qty"), c("price")), F.lit("ok")))
    return report(df.groupBy("symbol", "verdict").agg(F.count(F.lit(1)).alias("n")))


# --- trade reports --------------------------------------------------------------------------

@query("trade_runs", equity_sql(("r1_", "SELECT *, pnl > 0 AS won, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS i FROM tq"), ("r2_", "SELECT *, i - row_number() OVER (PARTITION BY symbol, won ORDER BY rn) AS grp FROM r1_"),
    ("r3_", "SELECT symbol, won, grp, count(*) AS n FROM r2_ GROUP BY 1, 2, 3"), ("out_", "SELECT symbol, coalesce(max(n) FILTER (WHERE won), 0) AS longest_win, coalesce(max(n) FILTER (WHERE NOT won), 0) AS longest_loss FROM r3_ GROUP BY 1"),
    out=cols("out_", ts="", ints="longest_win longest_loss")))
def trade_runs(spark, folder):
    trades, _ = one_run(spark, folder)
    return report(T.longest_runs(cut_lineage(trades)), "symbol", "longest_win", "longest_loss")


@query("monthly_returns", equity_sql(("out_", "SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS month, sum(pnl) AS pnl, count(*) AS n, avg((pnl > 0)::INT) AS win_rate FROM tq GROUP BY 1, 2"), out=cols("out_", ts="month", ints="n", nums="pnl:3 win_rate")))
def monthly_returns(spark, folder):
    trades, _ = one_run(spark, folder)
    return report(trades.groupBy("symbol", F.date_trunc("month", "ts").alias("month")).agg(
        F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("n"), F.avg(flag(c("pnl") > 0)).alias("win_rate")), "symbol", "month", "n", "pnl:3", "win_rate")


@query("account_rules", equity_sql(("d1_", "SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS day, sum(pnl) AS pnl, count(*) AS n FROM tq GROUP BY 1, 2"),
    ("d2_", "SELECT *, 25000 + sum(pnl) OVER (PARTITION BY symbol ORDER BY day) AS bal FROM d1_"), ("d3_", "SELECT *, greatest(25000, max(bal) OVER (PARTITION BY symbol ORDER BY day)) - bal AS trail FROM d2_"),
    ("out_", "SELECT symbol, count(*) AS days, max(trail) AS max_trailing_dd, max(pnl) / nullif(sum(pnl), 0) AS best_day_share, min(pnl) AS worst_day, max(n) AS most_trades, (max(trail) <= 1000)::INT AS within_drawdown FROM d3_ GROUP BY 1"),
    out=cols("out_", ts="", ints="days most_trades within_drawdown", nums="max_trailing_dd:3 best_day_share:4 worst_day:3")))
def account_rules(spark, folder):
    trades, _ = one_run(spark, folder)
    return report(T.account_rules(cut_lineage(trades)), "symbol", "days", "most_trades", "within_drawdown", "max_trailing_dd:3", "best_day_share:4", "worst_day:3")


LABELLED = [
    *score_steps(), ("lb", alias({"n_": "count(*) OVER (PARTITION BY symbol)"}, "s2")),
    ("lh", """SELECT a.symbol, a.rn, min(CASE WHEN b.high >= a.close + 2 * a.atr THEN b.rn - a.rn END) AS t, min(CASE WHEN b.low <= a.close - a.atr THEN b.rn - a.rn END) AS s
  FROM lb a JOIN lb b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 23 WHERE a.atr > 0 GROUP BY 1, 2"""),
    ("ll", "SELECT lb.*, CASE WHEN h.s IS NOT NULL AND (h.t IS NULL OR h.s <= h.t) THEN 'SL' WHEN h.t IS NOT NULL THEN 'TP' ELSE 'TIMEOUT' END AS reason FROM lb LEFT JOIN lh h ON h.symbol = lb.symbol AND h.rn = lb.rn WHERE lb.atr > 0 AND lb.rn + 24 <= lb.n_"),
    ("gr", "SELECT symbol, ts, rn, 1 AS side, reason, CASE reason WHEN 'TP' THEN 2 * atr / close WHEN 'SL' THEN -atr / close ELSE 0 END - 0.0019::DOUBLE AS growth FROM ll WHERE long_prob > 0.55")]


def labelled_trades(spark, folder):
    from barloom.operators.labels import triple_barrier
    scored = cut_lineage(X.features(B.stored_bars(spark, folder), X.scores).select("symbol", "ts", "open", "high", "low", "close", "long_prob"))
    return T.label_trades(cut_lineage(A.clean_numbered(triple_barrier(scored))), "long_prob", 0.55)


@query("label_outcomes", sql("bars", *LABELLED, ("z_", "SELECT symbol, reason AS outcome, count(*) AS n, avg(growth) AS avg_ret, sum(growth) AS total_ret FROM gr GROUP BY 1, 2"),
    out=cols("z_", keys="symbol outcome", ts="", ints="n", nums="avg_ret total_ret")))
def label_outcomes(spark, folder):
    """Label-driven backtest: every bar above the score threshold is entered, the label decides the result."""
    df = labelled_trades(spark, folder)
    return report(df.groupBy("symbol", c("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.avg("growth").alias("avg_ret"), F.sum("growth").alias("total_ret")))


@query("mark_to_market", recursive(sql("bars", *score_steps(), *entries_sql(0.2), *exits_sql(2.0, 1.0, 12, "fixed", 1.0),
    ("op", "SELECT * FROM ex WHERE bars_held IS NULL"), ("lp", "SELECT symbol, arg_max(close, ts) AS last_price FROM bars GROUP BY 1"),
    ("out_", "SELECT symbol, count(*) AS n_open, sum(side * (last_price - entry_price) / entry_price) AS unrealized FROM op JOIN lp USING (symbol) GROUP BY 1"), out=cols("out_", ts="", ints="n_open", nums="unrealized"))))
def mark_to_market(spark, folder):
    bars = B.stored_bars(spark, folder)
    still = exits_df(bars, 0.2, (2.0, 1.0, 12, "fixed", 1.0)).where("bars_held is null")
    last = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("last_price"))
    return report(still.join(last, "symbol").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_open"), F.sum(div(c("side") * (c("last_price") - c("entry_price")), "entry_price")).alias("unrealized")))


@query("random_baseline")
def random_baseline(spark, folder):
    """Seeded hash entries on a tenth of all bars through the same exits: what chance alone earns."""
    frame = cut_lineage(S.scored_frame(B.stored_bars(spark, folder), 12))
    pick = F.pmod(F.xxhash64("symbol", "ts", F.lit(42)), F.lit(10)) == 0
    entries = frame.where(pick & (c("atr_14") > 0)).withColumns({
        "side": F.lit(1), "entry_price": c("close"), "atr_entry": c("atr_14"), "tp_mult": F.lit(2.0), "sl_mult": F.lit(1.0),
        "hold": F.lit(12), "exit_mode": F.lit("fixed"), "trail_mult": F.lit(1.0)})
    kept = T.one_at_a_time(cut_lineage(T.resolve_exits(entries)), ["symbol"], 12).where("bars_held is not null")
    return report(kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_trades"), F.avg("gross_ret").alias("avg_ret"), F.avg(flag(c("gross_ret") > 0)).alias("win_rate")))


SCAN = (0.55, 0.6, 0.7, 0.8)


@query("threshold_scan", sql("bars", *score_steps(), ("th", f"SELECT s2.symbol, s2.ts, s2.rn, s2.close AS ep, s2.atr, t AS threshold, 1 AS side, 0 AS atr_median, s2.atr_pct FROM s2, (SELECT unnest({list(SCAN)})::DOUBLE AS t) WHERE atr > 0 AND long_prob >= t"),
    ("ent", "SELECT DISTINCT symbol, ts, rn, ep, atr, side, atr_median, atr_pct FROM th"), *exits_sql(2.0, 1.0, 12, "fixed", 1.0),
    ("out_", "SELECT th.symbol, th.threshold, count(*) AS n, avg(gross_ret) AS avg_ret, avg((gross_ret > 0)::INT) AS win_rate FROM th JOIN ex ON th.symbol = ex.symbol AND th.rn = ex.rn WHERE ex.bars_held IS NOT NULL GROUP BY 1, 2"),
    out=cols("out_", ts="", ints="n", nums="threshold avg_ret win_rate")))
def threshold_scan(spark, folder):
    """Exits once per bar, then every threshold the bar passes."""
    frame = S.scored_frame(B.stored_bars(spark, folder), 12).where((c("atr_14") > 0) & (c("long_prob") >= min(SCAN)))
    df = T.resolve_exits(frame.withColumns({
        "side": F.lit(1), "entry_price": c("close"), "atr_entry": c("atr_14"), "tp_mult": F.lit(2.0), "sl_mult": F.lit(1.0),
        "hold": F.lit(12), "exit_mode": F.lit("fixed"), "trail_mult": F.lit(1.0)})).where("bars_held is not null")
    df = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in SCAN]))).where(c("long_prob") >= c("threshold"))
    return report(df.groupBy("symbol", "threshold").agg(F.count(F.lit(1)).alias("n"), F.avg("gross_ret").alias("avg_ret"), F.avg(flag(c("gross_ret") > 0)).alias("win_rate")))


HYST = [("e_", "SELECT symbol, ts, rn, close, long_prob FROM s2 WHERE long_prob > 0.55"),
        ("f_", """SELECT e.symbol, e.ts, e.rn, e.close, b.rn - e.rn AS k, CASE WHEN b.low <= e.close * 0.95::DOUBLE THEN 'SL' WHEN b.high >= e.close * 1.1::DOUBLE THEN 'TP' WHEN b.long_prob < 0.45 THEN 'SIGNAL' WHEN b.rn - e.rn >= 24 THEN 'TIMEOUT' END AS reason,
  CASE WHEN b.low <= e.close * 0.95::DOUBLE THEN e.close * 0.95::DOUBLE WHEN b.high >= e.close * 1.1::DOUBLE THEN e.close * 1.1::DOUBLE ELSE b.close END AS px FROM e_ e JOIN s2 b ON e.symbol = b.symbol AND b.rn BETWEEN e.rn + 1 AND e.rn + 24"""),
        ("g_", "SELECT symbol, ts, arg_min(reason, k) AS reason, min(k) AS bars_held, arg_min(px / close - 1, k) AS gross_ret FROM f_ WHERE reason IS NOT NULL GROUP BY 1, 2")]


@query("hysteresis_exits", sql("bars", *score_steps(), *HYST, out=cols("g_", keys="symbol reason", ints="bars_held", nums="gross_ret")))
def hysteresis_exits(spark, folder):
    df = X.scores(chunked(B.stored_bars(spark, folder), before=80, after=24))
    bar = F.struct("high", "low", "close", c("long_prob").alias("p"))
    df = df.withColumn("_next", F.collect_list(bar).over(X.W.rowsBetween(1, 24))).where(c("_own") & (c("long_prob") > 0.55))
    return report(T.hysteresis(df.select("symbol", "ts", "close", "_next")), "symbol", "reason", "ts", "bars_held", "gross_ret")


@query("partial_exits")
def partial_exits(spark, folder):
    """Half of the position leaves at +1 ATR and the rest is secured at entry."""
    frame = S.scored_frame(B.stored_bars(spark, folder), 18).where((c("atr_14") > 0) & (c("long_prob") >= 0.7))
    df = frame.withColumns({"side": F.lit(1), "entry_price": c("close"), "atr_entry": c("atr_14"), "tp_mult": F.lit(3.0), "sl_mult": F.lit(1.5),
                            "hold": F.lit(18), "exit_mode": F.lit("partial"), "trail_mult": F.lit(1.0)})
    return report(T.with_partial(df, 0.5), "symbol", "ts", "reason", "bars_held", "partial_taken", "total_ret")


@query("session_vwap", sql("bars", ("o_", """SELECT symbol, ts, sum(tp * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap, CASE WHEN sum(volume) OVER w > 0 THEN sqrt(greatest(0, sum(tp * tp * volume) OVER w / nullif(sum(volume) OVER w, 0) - (sum(tp * volume) OVER w / nullif(sum(volume) OVER w, 0)) ^ 2)) END AS sigma
  FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars) WINDOW w AS (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts)"""),
    ("out_", "SELECT *, vwap + sigma AS up1, vwap - 2 * sigma AS down2 FROM o_"), out=cols("out_", nums="vwap sigma:4 up1:4 down2:4")))
def session_vwap(spark, folder):
    from pyspark.sql import Window
    w = Window.partitionBy("symbol", F.date_trunc("day", "ts")).orderBy("ts")
    tp = (c("high") + c("low") + c("close")) / 3
    v = F.sum("volume").over(w)
    mean, square = F.try_divide(F.sum(tp * c("volume")).over(w), v), F.try_divide(F.sum(tp * tp * c("volume")).over(w), v)
    df = B.bars_1h(spark, folder).withColumns({"vwap": mean, "_sq": square})
    df = df.withColumn("sigma", F.when(c("vwap").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), c("_sq") - c("vwap") * c("vwap")))))
    return report(df.withColumns({"up1": c("vwap") + c("sigma"), "down2": c("vwap") - 2 * c("sigma")}), "symbol", "ts", "vwap", "sigma:4", "up1:4", "down2:4")


@query("trading_calendar", sql("daily", ("out_", """SELECT symbol, ts, row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts) AS trading_day, row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts DESC) - 1 AS days_left,
  week(ts) AS iso_week, isodow(ts) - 1 AS dow, month(ts) AS month FROM daily"""), out=cols("out_", ints="trading_day days_left iso_week dow month")))
def trading_calendar(spark, folder):
    from pyspark.sql import Window
    w = Window.partitionBy("symbol", F.date_trunc("month", "ts"))
    return report(B.daily(spark, folder).select(
        "symbol", "ts", F.row_number().over(w.orderBy("ts")).alias("trading_day"), (F.row_number().over(w.orderBy(F.desc("ts"))) - 1).alias("days_left"),
        F.weekofyear("ts").alias("iso_week"), F.weekday("ts").alias("dow"), F.month("ts").alias("month")))


@query("expanding_stats", sql("bars", ("out_", f"SELECT symbol, ts, row_number() OVER ({P}) - 1 AS seen, max(high) OVER ({P}) AS top_so_far, first_value(open) OVER ({P}) AS first_open, {lead('close')} AS next_close FROM bars"), out=cols("out_", ints="seen", nums="top_so_far first_open next_close")))
def expanding_stats(spark, folder):
    df = chunked(B.stored_bars(spark, folder), after=1).withColumn("next_close", F.lead("close").over(X.W())).withColumn("seen", c("_rn"))
    df = prefix(owned(df), {"top_so_far": ("max", "high"), "first_open": ("last", F.when(c("_rn") == 0, c("open")))})
    return report(df, "symbol", "ts", "seen", "top_so_far", "first_open", "next_close")


@query("funding_features", sql("bars_f", ("d", f"SELECT *, funding_rate - {lag('funding_rate')} AS dfr FROM bars_f"), ("out_", alias({
    **{f"funding_cum_{n}": roll("sum", "funding_rate", n) for n in (8, 24, 72)},
    "funding_mr": f"-(funding_rate - {full('avg', 'funding_rate', 168)}) / ({full('stddev_samp', 'funding_rate', 168)} + 1e-10)",
    "funding_accel": full("avg", "dfr", 8), "funding_change_24": f"funding_rate - {lag('funding_rate', 24)}", "oi_change_24": f"open_interest - {lag('open_interest', 24)}"}, "d")),
    out=cols("out_", ints="oi_change_24", nums="funding_cum_8:9 funding_cum_24:9 funding_cum_72:9 funding_mr funding_accel:12 funding_change_24:9")))
def funding_features(spark, folder):
    return report(X.features(bars_with_funding(spark, folder), X.funding_features), "symbol", "ts", "oi_change_24", "funding_cum_8:9", "funding_cum_24:9", "funding_cum_72:9", "funding_mr", "funding_accel:12", "funding_change_24:9")


@query("null_policy", sql("bars", ("n_", f"SELECT symbol, ts, CASE WHEN volume > 0 THEN close / volume END AS x FROM bars"), ("out_", f"SELECT symbol, ts, coalesce(last_value(x IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS filled FROM n_"), out=cols("out_", nums="filled")))
def null_policy(spark, folder):
    from barloom.functions.rolling import finite
    from barloom.operators.chunks import with_time_chunk
    raw = B.stored_bars(spark, folder).withColumn("x", finite(F.when(c("volume") == 0, F.lit(float("inf"))).otherwise(div("close", "volume"))))
    return report(prefix(with_time_chunk(raw), {"filled": ("last", "x")}).select("symbol", "ts", F.coalesce("filled", F.lit(0.0)).alias("filled")))


@query("feature_catalog")
def feature_catalog(spark, folder):
    from barloom.operators.stats import feature_catalog as catalog
    return report(catalog(X.features(B.stored_bars(spark, folder), X.returns, X.averages, X.volatility)))


@query("feature_differences", sql("bars", ("m_", alias({"ret_1": f"ln(close / {lag('close')})", "ret_4": f"ln(close / {lag('close', 4)})"})),
    ("n_", "SELECT unnest(['ret_1', 'ret_4', 'rsi_14', 'hurst_exp']) AS feature, unnest([count(ret_1), count(ret_4), 0, 0]) AS n FROM m_"),
    out="SELECT string_agg(feature, ',' ORDER BY feature) FILTER (WHERE n = 0) AS missing, string_agg(feature, ',' ORDER BY feature) FILTER (WHERE n > 0) AS present FROM n_"))
def feature_differences(spark, folder):
    """Features a model expects and a frame holds values of, and those it lacks."""
    from barloom.operators.stats import feature_differences as differences
    return differences(X.features(B.stored_bars(spark, folder), X.returns), ["ret_1", "ret_4", "rsi_14", "hurst_exp"])
