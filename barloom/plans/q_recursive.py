"""Recursive indicators and the rules built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import signals as G
from barloom.functions.rolling import c
from barloom.operators import features as X
from barloom.operators import recursive as R
from barloom.operators.chunks import chunked, clean
from barloom.plans.q_features import TR, alias
from barloom.plans.registry import query, report
from barloom.plans.sqltext import P, cols, full, lag, sql
from barloom.session import cut_lineage
from barloom.sources import bars as B

NUM = ("nb", f"SELECT *, row_number() OVER ({P}) - 1 AS rn FROM bars")


def scan_sql(name, source, u, keep):
    """Recursive fold of ``y = keep * y + u`` in row order."""
    return (name, f"""SELECT symbol, rn, CAST(coalesce({u}, 0) AS DOUBLE) AS y FROM {source} WHERE rn = 0
  UNION ALL SELECT b.symbol, b.rn, {keep!r} * p.y + coalesce(b.{u}, 0) FROM {name} p JOIN {source} b ON b.symbol = p.symbol AND b.rn = p.rn + 1""")


def rec(*args, **kw):
    return sql(*args, **kw).replace("WITH ", "WITH RECURSIVE ", 1)


def mean(x, n):
    return f"avg({x}) OVER ({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


A12 = 2 / 13


@query("ema_12", rec("bars", NUM, ("u", alias({"u": f"CASE WHEN rn = 11 THEN {mean('close', 12)} WHEN rn > 11 THEN {A12!r} * close END"}, "nb")), scan_sql("s", "u", "u", 1 - A12),
    ("out_", "SELECT u.symbol, u.ts, CASE WHEN u.rn >= 11 THEN s.y END AS ema_12 FROM u JOIN s USING (symbol, rn)"), out=cols("out_", nums="ema_12")))
def ema_12(spark, folder):
    return report(R.ema(B.stored_bars(spark, folder), 12), "symbol", "ts", "ema_12")


MACD = [NUM, ("u", alias({f"u{n}": f"CASE WHEN rn = 25 THEN {mean('close', n)} WHEN rn > 25 THEN {2 / (n + 1)!r} * close END" for n in (12, 26)}, "nb")),
        scan_sql("sf", "u", "u12", 1 - 2 / 13), scan_sql("ss", "u", "u26", 1 - 2 / 27),
        ("m", "SELECT u.symbol, u.ts, u.rn, CASE WHEN u.rn >= 25 THEN sf.y - ss.y END AS macd FROM u JOIN sf USING (symbol, rn) JOIN ss USING (symbol, rn)"),
        ("mu", alias({"ug": f"CASE WHEN rn = 33 THEN {mean('macd', 9)} WHEN rn > 33 THEN 0.2 * macd END"}, "m")), scan_sql("sg", "mu", "ug", 0.8),
        ("md", "SELECT mu.symbol, mu.ts, mu.rn, CASE WHEN mu.rn >= 33 THEN macd END AS macd, CASE WHEN mu.rn >= 33 THEN sg.y END AS macd_signal, CASE WHEN mu.rn >= 33 THEN macd - sg.y END AS macd_hist FROM mu JOIN sg USING (symbol, rn)"),
        ("out_", f"SELECT *, coalesce((coalesce(macd > macd_signal, false)::INT <> lag(coalesce(macd > macd_signal, false)::INT) OVER ({P})), true)::INT AS macd_cross FROM md")]


@query("macd", rec("bars", *MACD, out=cols("out_", ints="macd_cross", nums="macd macd_signal macd_hist")))
def macd(spark, folder):
    df = chunked(cut_lineage(R.macd(B.stored_bars(spark, folder))), before=1)
    above = F.coalesce(c("macd") > c("macd_signal"), F.lit(False))
    df = df.withColumn("_a", above.cast("int"))
    df = df.withColumn("macd_cross", F.coalesce((c("_a") != F.lag("_a").over(X.W())).cast("int"), F.lit(1)))
    return report(clean(df), "symbol", "ts", "macd_cross", "macd", "macd_signal", "macd_hist")


def rsi_sql(x, skip, name):
    f = 14 + skip
    return [("d", f"SELECT *, {x} - {lag(x)} AS d FROM src_"),
            ("gl", "SELECT *, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM d"),
            ("u", alias({"ug": f"CASE WHEN rn = {f} THEN {mean('g', 14)} WHEN rn > {f} THEN g / 14 END", "ul": f"CASE WHEN rn = {f} THEN {mean('l', 14)} WHEN rn > {f} THEN l / 14 END"}, "gl")),
            scan_sql("sg", "u", "ug", 13 / 14), scan_sql("sl", "u", "ul", 13 / 14),
            ("out_", f"SELECT u.symbol, u.ts, CASE WHEN u.rn >= {f} THEN coalesce(100 * sg.y / nullif(sg.y + sl.y, 0), 0) END AS {name} FROM u JOIN sg USING (symbol, rn) JOIN sl USING (symbol, rn)")]


@query("wilder_rsi", rec("bars", ("src_", NUM[1]), *rsi_sql("close", 0, "rsi"), out=cols("out_", nums="rsi")))
def wilder_rsi(spark, folder):
    return report(R.wilder_rsi(B.stored_bars(spark, folder)), "symbol", "ts", "rsi")


@query("wilder_rsi_4h", rec("bars", ("src_", f"SELECT *, {full('avg', 'close', 4)} AS sm, row_number() OVER ({P}) - 1 AS rn FROM bars"), *rsi_sql("sm", 3, "rsi_4h"), out=cols("out_", nums="rsi_4h")))
def wilder_rsi_4h(spark, folder):
    from barloom.functions.rolling import full as full_
    bars = chunked(B.stored_bars(spark, folder), before=4)
    smooth = cut_lineage(clean(bars.withColumn("sm", full_(F.avg, "close", 4, X.W))))
    return report(R.wilder_rsi(smooth, x="sm", skip=3, out="rsi_4h"), "symbol", "ts", "rsi_4h")


ADX = [NUM, ("d", alias({"up": f"high - {lag('high')}", "dn": f"{lag('low')} - low", "tr": f"CASE WHEN {lag('close')} IS NOT NULL THEN {TR} END"}, "nb")),
       ("dm", alias({"pdm": "CASE WHEN up > 0 AND up > dn THEN up ELSE 0 END", "mdm": "CASE WHEN dn > 0 AND dn > up THEN dn ELSE 0 END"}, "d")),
       ("u", alias({**{f"u{x}": f"CASE WHEN rn = 13 THEN sum(CASE WHEN rn >= 1 THEN {x} END) OVER ({P} ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) WHEN rn > 13 THEN {x} END" for x in ("tr", "pdm", "mdm")},
                    "uatr": f"CASE WHEN rn = 14 THEN {mean('tr', 14)} WHEN rn > 14 THEN tr / 14 END"}, "dm")),
       *[scan_sql(f"s{x}", "u", f"u{x}", 13 / 14) for x in ("tr", "pdm", "mdm", "atr")],
       ("x", "SELECT u.symbol, u.ts, u.rn, CASE WHEN u.rn >= 14 THEN satr.y END AS atr, CASE WHEN u.rn >= 14 THEN coalesce(abs(spdm.y - smdm.y) / nullif(spdm.y + smdm.y, 0) * 100, 0) END AS dx FROM u JOIN str USING (symbol, rn) JOIN spdm USING (symbol, rn) JOIN smdm USING (symbol, rn) JOIN satr USING (symbol, rn)"),
       ("ux", alias({"ud": f"CASE WHEN rn = 27 THEN {mean('dx', 14)} WHEN rn > 27 THEN dx / 14 END"}, "x")), scan_sql("sx", "ux", "ud", 13 / 14),
       ("out_", "SELECT ux.symbol, ux.ts, atr, dx, CASE WHEN ux.rn >= 27 THEN sx.y END AS adx, coalesce(ux.rn >= 27 AND sx.y > 25, false)::INT AS strong_trend FROM ux JOIN sx USING (symbol, rn)")]


@query("adx_14", rec("bars", *ADX, out=cols("out_", ints="strong_trend", nums="atr dx adx")))
def adx_14(spark, folder):
    df = R.wilder_atr_adx(B.stored_bars(spark, folder)).withColumn("strong_trend", F.coalesce(c("adx") > 25, F.lit(False)))
    return report(df, "symbol", "ts", "strong_trend", "atr", "dx", "adx")


@query("psar")
def psar(spark, folder):
    return report(R.parabolic_sar(B.stored_bars(spark, folder)))


@query("rule_sets")
def rule_sets(spark, folder):
    """Six named long/short rule sets over Wilder RSI, CCI, MACD histogram, averages and ADX."""
    bars = cut_lineage(X.features(B.stored_bars(spark, folder), X.averages, X.cci_williams).select(
        "symbol", "ts", "open", "high", "low", "close", "volume", "ma_20", "ma_100", "cci"))
    df = R.wilder_atr_adx(cut_lineage(R.wilder_rsi(bars)))
    df = cut_lineage(R.macd(cut_lineage(df)))
    df = clean(chunked(df, before=1).withColumn("macd_hist_prev", F.lag("macd_hist").over(X.W())))
    return report(df.select("symbol", "ts", *[G.side(a, b).alias(n) for n, (a, b) in G.rule_sets().items()]))
