"""Sentiment flags, chart-side score, bucketing, user functions and sweep roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import custom
from barloom.functions.rolling import c, div, flag, lag as lag_
from barloom.operators import features as X
from barloom.operators import recursive as R
from barloom.operators import sweep as S
from barloom.operators.chunks import chunked, clean
from barloom.plans.q_features import alias, listed
from barloom.plans.q_sources import bars_with_funding
from barloom.plans.registry import query, report
from barloom.plans.sqltext import P, cols, full, roll, sql
from barloom.session import cut_lineage
from barloom.sources import bars as B


@query("funding_flags", sql("bars_f", ("q", alias({
    "q95": f"CASE WHEN {roll('count', 'funding_rate', 168)} >= 168 THEN quantile_cont(funding_rate, 0.95) OVER ({P} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) END",
    "pr": f"CASE WHEN count(*) OVER ({P} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) = 24 THEN avg(coalesce(funding_rate > 0, false)::INT) OVER ({P} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END",
    "funding_z_168_min24": f"(funding_rate - {full('avg', 'funding_rate', 168, 24)}) / ({full('stddev_samp', 'funding_rate', 168, 24)} + 1e-10)",
    "funding_oi_div": f"(funding_rate - {full('avg', 'funding_rate', 24)}) / ({full('stddev_samp', 'funding_rate', 24)} + 1e-10) * (open_interest - {full('avg', 'open_interest', 24)}) / ({full('stddev_samp', 'open_interest', 24)} + 1e-10)"}, "bars_f")),
    ("out_", "SELECT *, coalesce(abs(funding_rate) > q95, false)::INT AS funding_extreme, pr AS funding_positive_ratio FROM q"),
    out=cols("out_", ints="funding_extreme", nums="funding_positive_ratio funding_z_168_min24:4 funding_oi_div:4")))
def funding_flags(spark, folder):
    return report(X.features(bars_with_funding(spark, folder), X.funding_features), "symbol", "ts", "funding_extreme", "funding_positive_ratio",
                  "funding_z_168_min24:4", "funding_oi_div:4")


@query("equal_width_buckets", sql("bars", ("e", "SELECT symbol, min(close) AS lo, max(close) AS hi FROM bars GROUP BY 1"),
    ("b", "SELECT b.symbol, CAST(least(20, floor((close - lo) / nullif(hi - lo, 0) * 20) + 1) AS BIGINT) AS bucket, volume FROM bars b JOIN e USING (symbol)"),
    ("out_", "SELECT symbol, bucket, count(*) AS n, sum(volume) AS volume FROM b GROUP BY 1, 2"), out=cols("out_", ts="", ints="bucket n", nums="volume")))
def equal_width_buckets(spark, folder):
    bars = B.stored_bars(spark, folder)
    edges = bars.groupBy("symbol").agg(F.min("close").alias("lo"), F.max("close").alias("hi"))
    df = bars.join(edges, "symbol").withColumn("bucket", F.least(F.lit(20), F.width_bucket("close", "lo", "hi", F.lit(20))))
    return report(df.groupBy("symbol", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume")))


@query("row_filters", sql("daily vix", ("j", "SELECT d.*, v.vix FROM daily d JOIN vix v ON d.ts = v.ts"),
    ("out_", "SELECT * FROM j WHERE isodow(ts) IN (1, 3) AND month(ts) IN (11, 12, 1, 2, 3, 4) AND vix >= 15 AND vix < 25 AND close > open"), out=cols("out_", nums="vix close:8")))
def row_filters(spark, folder):
    """Weekday, season and volatility-band filters; the index filter runs before the join."""
    vix = cut_lineage(B.volatility_index(spark, folder)).where("vix >= 15 and vix < 25")
    days = B.daily(spark, folder).where("weekday(ts) in (0, 2) and month(ts) in (11, 12, 1, 2, 3, 4) and close > open")
    return report(days.join(vix, "ts"), "symbol", "ts", "vix", "close:8")


@query("chart_score")
def chart_score(spark, folder):
    """Five one-point conditions plus a volatility-rank filter; two points and a wake market enter."""
    bars = cut_lineage(X.features(B.stored_bars(spark, folder), X.averages, X.cci_williams, X.volumes).select(
        "symbol", "ts", "open", "high", "low", "close", "volume", "ma_20", "ma_50", "cci", "volume_spike"))
    df = R.macd(cut_lineage(R.wilder_atr_adx(cut_lineage(R.wilder_rsi(bars)))))
    df = chunked(cut_lineage(df.withColumn("atr_share", div("atr", "close") * 100)), before=201)
    seen = F.collect_list("atr_share").over(X.W.rowsBetween(-200, -1))
    points = {
        "rsi_momentum": c("rsi") > 75, "volume_up": (c("volume_spike") == 1) & (c("close") > c("open")),
        "cci_bounce": (c("cci") < -100) & (c("cci") > lag_("cci", 1, X.W)),
        "macd_turn": (c("macd_hist") > 0) & (lag_("macd_hist", 1, X.W) < 0), "trend": (c("close") > c("ma_20")) & (c("ma_20") > c("ma_50"))}
    df = df.withColumns({**{n: flag(e) for n, e in points.items()}, "_seen": seen})
    rank = F.try_divide(F.size(F.filter("_seen", lambda v: v <= c("atr_share"))) * 100.0, F.size("_seen"))
    df = clean(df.withColumns({"score": sum([c(n) for n in points], F.lit(0)), "atr_rank": F.when(F.size("_seen") == 200, rank)}))
    return report(df.select("symbol", "ts", *points, "score", "atr_rank", flag((c("score") >= 2) & (c("atr_rank") > 25)).alias("enter")))


@query("custom_rolling", sql("bars", ("l", alias({"vals": listed("close", 10)})),
    ("out_", "SELECT symbol, ts, CASE WHEN len(vals) = 10 THEN list_max(vals) - list_min(vals) END AS spread FROM l"), out=cols("out_", nums="spread")))
def custom_rolling(spark, folder):
    """A user-supplied rolling function next to the built-in packs."""
    df = chunked(B.stored_bars(spark, folder), before=10)
    return report(clean(df.withColumn("spread", custom.rolling_apply(lambda v: v.max() - v.min(), "close", 10, X.W))), "symbol", "ts", "spread")


@query("sweep_rollup")
def sweep_rollup(spark, folder):
    """Runs and profitable runs by every combination of direction and exit mode."""
    runs = cut_lineage(S.sweep(bars_with_funding(spark, folder), S.Grid()))
    df = runs.cube("direction", "exit_mode").agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum(flag(c("profit_factor") > 1)).alias("n_profitable"), F.avg("win_rate").alias("win_rate"),
        F.max_by("tp_mult", "profit_factor").alias("best_target"))
    return report(df.withColumns({x: F.coalesce(x, F.lit("ALL")) for x in ("direction", "exit_mode")}))


@query("sweep_top")
def sweep_top(spark, folder):
    """Best three configurations per symbol by profit factor among runs with enough trades."""
    from pyspark.sql import Window
    runs = cut_lineage(S.sweep(bars_with_funding(spark, folder), S.Grid())).where("n_trades >= 10")
    w = Window.partitionBy("symbol").orderBy(F.desc_nulls_last("profit_factor"), *S.CONFIG)
    return report(runs.withColumn("place", F.row_number().over(w)).where("place <= 3").select("symbol", "place", *S.CONFIG, "n_trades", "profit_factor"))
