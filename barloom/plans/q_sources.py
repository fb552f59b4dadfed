"""Sources, sinks, bar building and joins between series."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import align as A
from barloom.operators.chunks import DAILY, chunked, clean
from barloom.operators.studies import daily_frame
from barloom.plans.registry import query, report
from barloom.plans.sqltext import P, cols, lag, sql
from barloom.sources import bars as B
from barloom.session import cut_lineage
from barloom.sources import files as S

OHLCV = "open high low close volume"
OHLCV8 = "open:8 high:8 low:8 close:8 volume"


@query("bars_1h", sql("bars", out=cols("bars", nums=OHLCV)))
def bars_1h(spark, folder):
    return report(B.bars_1h(spark, folder))


def resampled(width):
    return ("out_", f"""SELECT symbol, time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01') AS ts,
  arg_min(price, ord) AS open, max(price) AS high, min(price) AS low, arg_max(price, ord) AS close,
  sum(qty) AS volume FROM ticks GROUP BY 1, 2""")


@query("bars_4h_resample", sql("ticks", resampled("4 hours"), out=cols("out_", nums=OHLCV)))
def bars_4h(spark, folder):
    return report(B.resample(B.ticks(spark, folder), "4 hours"))


@query("bars_1h_to_daily", sql("ticks", resampled("1 day"), out=cols("out_", nums=OHLCV)))
def bars_daily(spark, folder):
    return report(B.rebar(B.stored_bars(spark, folder), "1 day"), "symbol", "ts", *OHLCV.split())


@query("daily_bars", sql("daily", out=cols("daily", nums=OHLCV8)))
def daily_bars(spark, folder):
    return report(B.daily(spark, folder), "symbol", "ts", *OHLCV8.split())


@query("source_union_dedupe", sql("bars", ("out_", """SELECT symbol, ts, close, volume, 0 AS source FROM bars WHERE hour(ts) % 3 <> 0
  UNION ALL SELECT symbol, ts, close, volume, 1 FROM (SELECT symbol, ts, (high + low) / 2 AS close, volume FROM bars) WHERE hour(ts) % 3 = 0"""),
    out=cols("out_", ints="source", nums="close volume")))
def source_union(spark, folder):
    bars = B.stored_bars(spark, folder)
    first = bars.where(F.hour("ts") % 3 != 0).select("symbol", "ts", "close", "volume", F.lit(0).alias("source"))
    second = bars.select("symbol", "ts", ((F.col("high") + F.col("low")) / 2).alias("close"), "volume", F.lit(1).alias("source"))
    return report(A.merge_sources([first, second]), "symbol", "ts", "source", "close", "volume")


@query("duplicate_drop", sql("ticks", ("out_", """SELECT symbol, date_trunc('minute', ts) AS ts, min(ord) AS first_ord,
  arg_min(price, ord) AS first_price, max(ord) AS last_ord, arg_max(price, ord) AS last_price FROM ticks GROUP BY 1, 2"""),
    out=cols("out_", ints="first_ord last_ord", nums="first_price last_price")))
def duplicate_drop(spark, folder):
    ticks = B.ticks(spark, folder).withColumn("ts", F.date_trunc("minute", "ts")).select("symbol", "ts", "ord", "price")
    row = F.struct("ord", "price")
    both = ticks.groupBy("symbol", "ts").agg(F.min_by(row, "ord").alias("first"), F.max_by(row, "ord").alias("last"))
    return report(both.select("symbol", "ts", *[F.col(f"{k}.{x}").alias(f"{k}_{x}") for k in ("first", "last") for x in ("ord", "price")]))


@query("last_n_bars", sql("bars", ("out_", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS p FROM bars) WHERE p <= 100"""),
    out=cols("out_", nums=OHLCV)))
def last_n_bars(spark, folder):
    return report(A.newest_rows(B.stored_bars(spark, folder), 100), "symbol", "ts", *OHLCV.split())


@query("timestamp_repair", sql("bars", ("n", f"SELECT *, row_number() OVER ({P}) - 1 AS rn FROM bars"),
    ("b", f"SELECT symbol, close, rn, row_number() OVER ({P}) - 1 AS rb FROM n WHERE rn >= 37"),
    ("o", "SELECT n.symbol, min(n.rn) AS off FROM n JOIN (SELECT symbol, close FROM b WHERE rb = 0) f ON n.symbol = f.symbol AND n.close = f.close GROUP BY 1"),
    ("out_", "SELECT b.symbol, n.ts AS true_ts, b.rb AS rn, b.close FROM b JOIN o ON b.symbol = o.symbol JOIN n ON n.symbol = b.symbol AND n.rn = b.rb + o.off"),
    out=cols("out_", ts="true_ts", ints="rn", nums="close")))
def timestamp_repair(spark, folder):
    bars = B.stored_bars(spark, folder)
    tail = A.clean_numbered(bars).where("rn >= 37").drop("rn").withColumn("ts", F.col("ts") + F.expr("INTERVAL 5 HOURS"))
    return report(A.repair_stamps(tail.select("symbol", "ts", "close"), bars), "symbol", "true_ts", "rn", "close")


@query("time_zones", sql("bars", ("out_", """SELECT symbol, ts, ts - INTERVAL 5 HOURS AS eastern, epoch_ms(ts) AS ms, make_timestamp(epoch_ms(ts) * 1000) AS back FROM bars"""),
    out=cols("out_", ts="ts eastern back", ints="ms")))
def time_zones(spark, folder):
    bars = B.stored_bars(spark, folder)
    return report(bars.select(
        "symbol", "ts", F.from_utc_timestamp("ts", "America/New_York").alias("eastern"),
        F.unix_millis("ts").alias("ms"), F.timestamp_millis(F.unix_millis("ts")).alias("back")))


@query("kline_json_pages", sql("bars", out=cols("bars", nums=OHLCV)))
def kline_json(spark, folder):
    return report(S.parse_klines(S.kline_pages(B.stored_bars(spark, folder))))


@query("funding_json_pages", sql("funding", out=cols("funding", nums="funding_rate:9")))
def funding_json(spark, folder):
    pages = S.series_pages(B.funding(spark, folder), "funding_rate", "fundingRateTimestamp")
    return report(S.parse_series(pages, "funding_rate", "fundingRateTimestamp"), "symbol", "ts", "funding_rate:9")


@query("parquet_roundtrip", sql("bars", out=cols("bars", nums=OHLCV, where="symbol <> 'view' AND ts >= TIMESTAMP '2024-01-10'")))
def parquet_roundtrip(spark, folder):
    path = S.fresh_path(spark, "bars")
    S.write_bars(B.stored_bars(spark, folder), path)
    kept = S.read_bars(spark, path).where("symbol <> 'view' and month >= '2024-01' and ts >= timestamp'2024-01-10'")
    return report(kept, "symbol", "ts", *OHLCV.split())


@query("csv_roundtrip", sql("bars", out=cols("bars", nums=OHLCV)))
def csv_roundtrip(spark, folder):
    path = S.fresh_path(spark, "csv")
    S.write_csv(B.stored_bars(spark, folder), path)
    return report(S.read_csv(spark, path, S.BAR_SCHEMA))


@query("json_roundtrip", sql("bars", ("out_", "SELECT symbol, count(*) AS n, max(high) AS top, sum(volume) AS volume FROM bars GROUP BY 1"),
    out=cols("out_", ts="", ints="n", nums="top volume")))
def json_roundtrip(spark, folder):
    path = S.fresh_path(spark, "json")
    bars = B.stored_bars(spark, folder)
    stats = F.struct(F.count(F.lit(1)).alias("n"), F.max("high").alias("top"), F.sum("volume").alias("volume"))
    S.write_json(bars.groupBy("symbol").agg(stats.alias("stats")), path)
    back = S.read_json(spark, path, "symbol string, stats struct<n: bigint, top: double, volume: double>")
    return report(back.select("symbol", "stats.*"))


# --- joins ----------------------------------------------------------------------------------

@query("asof_funding", sql("bars_f", out=cols("bars_f", ints="open_interest", nums="close funding_rate:9")))
def asof_funding(spark, folder):
    return report(bars_with_funding(spark, folder), "symbol", "ts", "open_interest", "close", "funding_rate:9")


def bars_with_funding(spark, folder):
    """Hourly bars with the as-of funding rate and open interest."""
    hourly = cut_lineage(B.hourly(spark, folder))
    interest = A.prefix(A.with_time_chunk(hourly), {"open_interest": ("sum", "n_ticks")}).select("symbol", "ts", "open_interest")
    sparse = cut_lineage(B.funding_from(hourly).unionByName(interest, allowMissingColumns=True))
    return cut_lineage(A.asof(hourly.drop("n_ticks"), sparse, ["funding_rate", "open_interest"]))


@query("reindex_ffill", sql("bars", ("g", """SELECT s.symbol, h.ts FROM (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1) s,
  LATERAL (SELECT unnest(generate_series(s.a, s.b, INTERVAL 1 HOUR)) AS ts) h"""),
    ("out_", "SELECT g.symbol, g.ts, b.close FROM g ASOF LEFT JOIN bars b ON g.symbol = b.symbol AND g.ts >= b.ts"),
    out=cols("out_", nums="close")))
def reindex_ffill(spark, folder):
    bars = B.stored_bars(spark, folder)
    edges = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = edges.select("symbol", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    return report(A.asof(grid, bars, ["close"]), "symbol", "ts", "close")


@query("join_then_fill", sql("bars funding", ("j", "SELECT b.symbol, b.ts, b.close, f.funding_rate AS fr FROM bars b LEFT JOIN funding f ON b.symbol = f.symbol AND b.ts = f.ts"),
    ("out_", f"SELECT *, last_value(fr IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS funding_rate FROM j"),
    out=cols("out_", nums="close funding_rate:9")))
def join_then_fill(spark, folder):
    bars = B.stored_bars(spark, folder).select("symbol", "ts", "close")
    return report(A.join_then_fill(bars, B.funding(spark, folder), ["funding_rate"]), "symbol", "ts", "close", "funding_rate:9")


@query("column_concat", sql("bars", ("l", f"SELECT symbol, ts, lead(close, 4) OVER ({P}) / close - 1 AS fwd FROM bars"),
    ("out_", "SELECT b.symbol, b.ts, b.close, l.fwd FROM bars b JOIN l USING (symbol, ts)"), out=cols("out_", nums="close fwd")))
def column_concat(spark, folder):
    from barloom.operators.features import W
    bars = B.stored_bars(spark, folder)
    label = clean(chunked(bars, after=4).withColumn("fwd", F.try_divide(F.lead("close", 4).over(W()), F.col("close")) - 1)).select("symbol", "ts", "fwd")
    return report(bars.join(label, ["symbol", "ts"]), "symbol", "ts", "close", "fwd")


DOWN_DAYS = ("dn", f"SELECT symbol, ts AS d, close < {lag('close')} AS down FROM (SELECT symbol, date_trunc('day', ts) AS ts, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2)")


@query("semi_join_days", sql("bars", DOWN_DAYS, ("out_", "SELECT b.* FROM bars b WHERE EXISTS (SELECT 1 FROM dn WHERE dn.symbol = b.symbol AND dn.d = date_trunc('day', b.ts) AND dn.down)"),
    out=cols("out_", nums=OHLCV)))
def semi_join_days(spark, folder):
    from barloom.operators.features import W
    bars = B.stored_bars(spark, folder)
    day = B.rebar(bars, "1 day")
    down = clean(chunked(day, before=1, span=DAILY).withColumn("down", F.col("close") < F.lag("close", 1).over(W())))
    days = down.where("down").select("symbol", F.col("ts").alias("day"))
    return report(bars.withColumn("day", F.date_trunc("day", "ts")).join(days, ["symbol", "day"], "left_semi"), "symbol", "ts", *OHLCV.split())


@query("anti_join_blackout", sql("daily", ("out_", "SELECT * FROM daily WHERE NOT (month(ts) IN (1, 4, 7, 10) AND day(ts) BETWEEN 10 AND 27)"),
    out=cols("out_", nums=OHLCV8)))
def anti_join_blackout(spark, folder):
    days = B.stored_daily(spark, folder)
    return report(days.withColumn("day", F.to_date("ts")).join(A.blackout_days(days), "day", "left_anti"), "symbol", "ts", *OHLCV8.split())


@query("week_to_week", sql("daily", ("w", "SELECT symbol, date_trunc('week', ts)::TIMESTAMP AS wk, arg_max(close, ts) / arg_min(open, ts) - 1 AS wr FROM daily GROUP BY 1, 2"),
    ("out_", "SELECT d.symbol, d.ts, w.wr AS prev_week_ret FROM daily d LEFT JOIN w ON d.symbol = w.symbol AND date_trunc('week', d.ts)::TIMESTAMP = w.wk + INTERVAL 7 DAYS"),
    out=cols("out_", nums="prev_week_ret")))
def week_to_week(spark, folder):
    return report(A.previous_week(B.stored_daily(spark, folder)), "symbol", "ts", "prev_week_ret")


@query("forward_bars", sql("bars", ("n", f"SELECT *, row_number() OVER ({P}) AS rn FROM bars"),
    ("out_", "SELECT a.symbol, a.ts, b.rn - a.rn AS k, b.close / a.close - 1 AS ret FROM n a JOIN n b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 5"),
    out=cols("out_", ints="k", nums="ret")))
def forward_bars(spark, folder):
    from barloom.functions.rolling import ahead
    from barloom.operators.features import W
    df = chunked(B.stored_bars(spark, folder), after=5).withColumn("_next", F.collect_list("close").over(ahead(W, 5)))
    df = clean(df.where("_own").select("symbol", "ts", "close", F.posexplode("_next").alias("k", "later")))
    return report(df.select("symbol", "ts", (F.col("k") + 1).alias("k"), (F.try_divide("later", "close") - 1).alias("ret")))


@query("intraday_pairs", sql("bars", ("out_", """SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, max(close) FILTER (WHERE hour(ts) = 9) AS entry,
  max(close) FILTER (WHERE hour(ts) = 10) AS exit, max(close) FILTER (WHERE hour(ts) = 10) / max(close) FILTER (WHERE hour(ts) = 9) - 1 AS ret
  FROM bars GROUP BY 1, 2 HAVING count(*) FILTER (WHERE hour(ts) = 9) > 0 AND count(*) FILTER (WHERE hour(ts) = 10) > 0"""),
    out=cols("out_", nums="entry exit ret")))
def intraday_pairs(spark, folder):
    at = lambda h: F.max(F.when(F.hour("ts") == h, F.col("close")))
    pairs = B.stored_bars(spark, folder).where(F.hour("ts").isin(9, 10)).groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(
        at(9).alias("entry"), at(10).alias("exit")).where("entry is not null and exit is not null")
    return report(pairs.select("symbol", F.col("day").alias("ts"), "entry", "exit", (F.try_divide("exit", "entry") - 1).alias("ret")))


@query("regime_levels", sql("daily", ("f", f"SELECT *, close / {lag('close', 20)} - 1 AS m FROM daily"),
    ("g", "SELECT *, CASE WHEN m > 0.5 THEN 'bull' WHEN m < -0.3 THEN 'bear' WHEN m IS NULL THEN 'unknown' ELSE 'sideways' END AS regime FROM f"),
    ("lv", "SELECT * FROM (VALUES ('bull', 2.0, 6.0), ('bear', 1.5, 3.0), ('sideways', 1.0, 2.0)) t(regime, sl_pct, tp_pct)"),
    ("out_", "SELECT g.symbol, g.ts, g.regime, lv.sl_pct, lv.tp_pct FROM g JOIN lv ON lv.regime = CASE WHEN g.regime = 'unknown' THEN 'sideways' ELSE g.regime END"),
    out=cols("out_", keys="symbol regime", nums="sl_pct tp_pct")))
def regime_levels(spark, folder):
    levels = spark.createDataFrame([("bull", 2.0, 6.0), ("bear", 1.5, 3.0), ("sideways", 1.0, 2.0)], "regime string, sl_pct double, tp_pct double")
    rows = A.regime_levels(daily_frame(B.stored_daily(spark, folder)), levels)
    return report(rows, "symbol", "regime", "ts", "sl_pct", "tp_pct")
