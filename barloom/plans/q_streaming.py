"""Streaming jobs run to completion over the landed files; SQL says what a closed window holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import c
from barloom.operators import features as X
from barloom.operators.ranks import quantiles
from barloom.plans.q_book import snapshots
from barloom.plans.q_features import alias
from barloom.plans.registry import query, report
from barloom.plans.sqltext import P, cols, full, sql
from barloom.session import cut_lineage
from barloom.sources import bars as B
from barloom.sources.files import BAR_SCHEMA
from barloom.streaming import jobs as J

DONE = "(SELECT max(ts) - INTERVAL 10 MINUTES FROM ticks)"
CLOSED = ("cb", f"SELECT * FROM bars WHERE ts + INTERVAL 1 HOUR <= {DONE}")
OHLCV = "open high low close volume"


def bar_table(spark, folder):
    return J.run_to_table(J.closed_bars(J.tick_stream(spark, folder)), "bars")


@query("stream_closed_bars", sql("bars", CLOSED, out=cols("cb", nums=OHLCV)))
def stream_closed_bars(spark, folder):
    return report(spark.read.parquet(bar_table(spark, folder)), "symbol", "ts", *OHLCV.split())


@query("stream_newest_candles", sql("ticks", ("m_", "SELECT symbol, date_trunc('minute', ts) AS ts, max(ord) AS ord, arg_max(price, ord) AS price FROM ticks GROUP BY 1, 2"),
    ("out_", f"SELECT * FROM m_ WHERE ts + INTERVAL 1 MINUTE <= {DONE}"), out=cols("out_", ints="ord", nums="price")))
def stream_newest_candles(spark, folder):
    path = J.run_to_table(J.newest_candles(J.tick_stream(spark, folder)), "candles")
    return report(spark.read.parquet(path), "symbol", "ts", "ord", "price")


@query("stream_deduplicated", sql("ticks", ("out_", "SELECT symbol, count(*) AS n, sum(qty) AS qty FROM ticks GROUP BY 1"), out=cols("out_", ts="", ints="n", nums="qty")))
def stream_deduplicated(spark, folder):
    ticks = J.tick_stream(spark, folder)
    path = J.run_to_table(J.exact_duplicates_dropped(ticks.unionByName(J.tick_stream(spark, folder))), "unique")
    return report(spark.read.parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty")))


@query("stream_sliding", sql("ticks", ("s_", "SELECT symbol, date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS ts, price, qty FROM ticks, (SELECT unnest([0, 1, 2, 3]) AS k)"),
    ("g_", "SELECT symbol, ts, count(*) AS n, avg(price) AS avg_price, sum(qty) AS volume FROM s_ GROUP BY 1, 2"), ("out_", f"SELECT * FROM g_ WHERE ts + INTERVAL 4 HOURS <= {DONE}"),
    out=cols("out_", ints="n", nums="avg_price volume")))
def stream_sliding(spark, folder):
    path = J.run_to_table(J.sliding_stats(J.tick_stream(spark, folder)), "sliding")
    return report(spark.read.parquet(path), "symbol", "ts", "n", "avg_price", "volume")


@query("stream_sessions", sql("ticks", ("a_", f"SELECT *, CASE WHEN ts >= lag(ts) OVER ({P}) + INTERVAL 30 MINUTES OR lag(ts) OVER ({P}) IS NULL THEN 1 ELSE 0 END AS brk FROM ticks"),
    ("b_", f"SELECT *, sum(brk) OVER ({P}) AS sid FROM a_"), ("g_", "SELECT symbol, min(ts) AS ts, max(ts) + INTERVAL 30 MINUTES AS end_ts, count(*) AS n, max(price) AS top FROM b_ GROUP BY symbol, sid"),
    ("out_", f"SELECT * FROM g_ WHERE end_ts <= {DONE}"), out=cols("out_", ts="ts end_ts", ints="n", nums="top")))
def stream_sessions(spark, folder):
    path = J.run_to_table(J.sessions(J.tick_stream(spark, folder)), "sessions")
    return report(spark.read.parquet(path), "symbol", "ts", "end_ts", "n", "top")


@query("stream_static_join", sql("bars", CLOSED, ("t_", "SELECT symbol, quantile_cont(abs((close - open) / open), 0.9) AS threshold FROM bars GROUP BY 1"),
    ("out_", "SELECT cb.symbol, cb.ts, (close - open) / open AS move, (abs((close - open) / open) > threshold)::INT AS alert FROM cb JOIN t_ USING (symbol)"), out=cols("out_", ints="alert", nums="move")))
def stream_static_join(spark, folder):
    moves = B.stored_bars(spark, folder).select("symbol", F.abs(F.try_divide(c("close") - c("open"), c("open"))).alias("m"))
    limits = cut_lineage(quantiles(moves, "m", {"threshold": 0.9}, ["symbol"]))
    stream = J.table_stream(spark, bar_table(spark, folder), BAR_SCHEMA)
    path = J.run_to_table(J.with_thresholds(stream, limits), "alerts")
    return report(spark.read.parquet(path), "symbol", "ts", "alert", "move")


#: Bars that the ordered jobs have released: all but those of the last six hours of the stream.
RELEASED = ("cb", f"SELECT * FROM bars WHERE ts + INTERVAL 1 HOUR <= {DONE} AND ts + INTERVAL 6 HOURS <= (SELECT max(ts) FROM bars WHERE ts + INTERVAL 1 HOUR <= {DONE})")


@query("stream_features", sql("bars", CLOSED, ("out_", alias({"ma_20": full("avg", "close", 20), "ma_50": full("avg", "close", 50)}, "cb")), out=cols("out_", nums="close ma_20 ma_50")))
def stream_features(spark, folder):
    """Closed bars in, the batch feature pack out."""
    stream = J.table_stream(spark, bar_table(spark, folder), BAR_SCHEMA)
    path = J.serve_features(stream, X.averages)
    return report(spark.read.parquet(path), "symbol", "ts", "close", "ma_20", "ma_50")


@query("stream_book_averages")
def stream_book_averages(spark, folder):
    books = cut_lineage(snapshots(spark, folder))
    path = f"{J.shared_folder(spark)}/books-{J.uuid.uuid4().hex}"
    books.write.parquet(path)
    out = J.run_to_table(J.book_averages(J.table_stream(spark, path, books.schema)), "book")
    return report(spark.read.parquet(out), "symbol", "ts", "n", "avg_spread", "avg_imbalance")


WALK = [("n_", f"SELECT *, row_number() OVER ({P}) AS rn FROM cb"),
        ("w_", """SELECT symbol, rn, ts, CASE WHEN close > open THEN ts END AS ets, CASE WHEN close > open THEN close END AS ep, CAST(NULL AS TIMESTAMP) AS xts, CAST(NULL AS TIMESTAMP) AS xets, CAST(NULL AS DOUBLE) AS xp, CAST(NULL AS VARCHAR) AS reason FROM n_ WHERE rn = 1
  UNION ALL SELECT n.symbol, n.rn, n.ts, CASE WHEN w.ep IS NULL THEN CASE WHEN n.close > n.open THEN n.ts END WHEN n.low <= w.ep * 0.95::DOUBLE OR n.high >= w.ep * 1.1::DOUBLE THEN NULL ELSE w.ets END,
    CASE WHEN w.ep IS NULL THEN CASE WHEN n.close > n.open THEN n.close END WHEN n.low <= w.ep * 0.95::DOUBLE OR n.high >= w.ep * 1.1::DOUBLE THEN NULL ELSE w.ep END,
    CASE WHEN n.low <= w.ep * 0.95::DOUBLE OR n.high >= w.ep * 1.1::DOUBLE THEN n.ts END, w.ets, w.ep, CASE WHEN n.low <= w.ep * 0.95::DOUBLE THEN 'SL' WHEN n.high >= w.ep * 1.1::DOUBLE THEN 'TP' END
  FROM w_ w JOIN n_ n ON n.symbol = w.symbol AND n.rn = w.rn + 1"""),
        ("out_", "SELECT symbol, xets AS entry_ts, xts AS exit_ts, reason, xp AS entry_price, CASE reason WHEN 'SL' THEN -0.05::DOUBLE ELSE 0.1::DOUBLE END AS pnl FROM w_ WHERE reason IS NOT NULL")]


def closes(spark, folder):
    stream = J.table_stream(spark, bar_table(spark, folder), BAR_SCHEMA)
    return J.on_time(spark.read.parquet(J.run_to_table(J.positions(stream), "positions")))


@query("stream_positions", sql("bars", RELEASED, *WALK, out=cols("out_", keys="symbol reason", ts="entry_ts exit_ts", nums="entry_price pnl")).replace("WITH ", "WITH RECURSIVE ", 1))
def stream_positions(spark, folder):
    df = closes(spark, folder).withColumns({"entry_ts": F.timestamp_micros("entry_at"), "exit_ts": F.timestamp_micros("exit_at")})
    return report(df, "symbol", "reason", "entry_ts", "exit_ts", "entry_price", "pnl")


#: Every bar that closes above its open is an order of its volume's value, closed four hours later at the close of its bar.
ORDERS = [("o1_", f"SELECT *, lead(close, 4) OVER ({P}) AS later, lead(ts, 4) OVER ({P}) AS cts FROM bars WHERE ts + INTERVAL 1 HOUR <= {DONE}"),
          ("o2_", "SELECT symbol, ts, cts, 25 * (1 + volume % 200) AS val, 25 * (1 + volume % 200) * (later / close - 1) AS res FROM o1_ WHERE close > open AND later IS NOT NULL"),
          ("o3_", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM o2_ WHERE ts + INTERVAL 6 HOURS <= (SELECT max(ts) FROM o2_)")]
_PAST = "list_filter(w.fr, lambda f: f.cts <= n.ts)"
_HELD = "list_filter(w.fr, lambda f: f.cts > n.ts)"
_TODAY = f"list_filter(w.done || {_PAST}, lambda f: date_trunc('day', f.cts) = date_trunc('day', n.ts))"
_SUM = "coalesce(list_sum(list_transform({}, lambda f: f.{})), 0)"
_DECIDE = (f"CASE WHEN {_SUM.format(_TODAY, 'res')} <= -200 THEN 'daily loss' WHEN len({_TODAY}) >= 2 THEN 'daily trades' "
           f"WHEN {_SUM.format(_HELD, 'val')} >= 8000 THEN 'exposure' ELSE 'ok' END")
_SELF = "{'cts': n.cts, 'val': n.val, 'res': n.res}"
GUARD = [("g_", f"""SELECT symbol, rn, ts, 'ok' AS decision, 0::DOUBLE AS day_pnl, 0::BIGINT AS day_trades, 0::DOUBLE AS exposure, [{{'cts': cts, 'val': val, 'res': res}}] AS fr, [{{'cts': cts, 'val': val, 'res': res}}][1:0] AS done FROM o3_ WHERE rn = 1
  UNION ALL SELECT n.symbol, n.rn, n.ts, {_DECIDE}, {_SUM.format(_TODAY, 'res')}, len({_TODAY}), {_SUM.format(_HELD, 'val')},
    CASE WHEN {_DECIDE} = 'ok' THEN list_append({_HELD}, {_SELF}) ELSE {_HELD} END, {_TODAY} FROM g_ w JOIN o3_ n ON n.symbol = w.symbol AND n.rn = w.rn + 1""")]


@query("stream_daily_guard", sql("bars", *ORDERS, *GUARD, out=cols("g_", keys="symbol decision", ints="day_trades", nums="day_pnl:4 exposure:4")).replace("WITH ", "WITH RECURSIVE ", 1))
def stream_daily_guard(spark, folder):
    """Orders are admitted or refused one by one before they are filled; refused ones change nothing."""
    from pyspark.sql import Window
    w = Window.partitionBy("symbol").orderBy("ts")
    bars = spark.read.parquet(bar_table(spark, folder)).withColumns({"later": F.lead("close", 4).over(w), "close_at": F.unix_micros(F.lead("ts", 4).over(w))})
    value = 25 * (1 + c("volume") % 200)
    orders = cut_lineage(bars.where("close > open AND later IS NOT NULL").select("symbol", "ts", value.alias("value"), "close_at", (value * (c("later") / c("close") - 1)).alias("pnl")))
    stream = J.table_stream(spark, orders.inputFiles()[0].rsplit("/", 1)[0], orders.schema)
    out = J.on_time(spark.read.parquet(J.run_to_table(J.daily_guard(stream), "guard")))
    return report(out.withColumn("ts", F.timestamp_micros("at")), "symbol", "decision", "ts", "day_trades", "day_pnl:4", "exposure:4")


REGIME = "CASE WHEN (close - open) / nullif(open, 0) > 0.3 THEN 'bull' WHEN (close - open) / nullif(open, 0) < -0.3 THEN 'bear' ELSE 'sideways' END"


@query("stream_regimes", sql("bars", RELEASED, ("r1_", f"SELECT symbol, ts, {REGIME} AS regime FROM cb"),
    ("r2_", f"SELECT *, lag(regime, 1) OVER ({P}) AS b, lag(regime, 2) OVER ({P}) AS a FROM r1_"),
    ("out_", "SELECT symbol, ts, regime, CASE WHEN a IS NOT NULL AND a = b THEN a WHEN regime = a OR regime = b THEN regime ELSE regime END AS steady_regime FROM r2_"),
    out=cols("out_", keys="symbol regime steady_regime")))
def stream_regimes(spark, folder):
    bars = J.table_stream(spark, bar_table(spark, folder), BAR_SCHEMA)
    move = F.try_divide(c("close") - c("open"), c("open"))
    rows = bars.withColumn("regime", F.when(move > 0.3, "bull").when(move < -0.3, "bear").otherwise("sideways"))
    out = J.on_time(spark.read.parquet(J.run_to_table(J.steady_regimes(rows), "regimes")))
    return report(out.withColumn("ts", F.timestamp_micros("at")), "symbol", "regime", "steady_regime", "ts")
