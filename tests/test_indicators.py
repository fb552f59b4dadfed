"""Recursive indicators, causality and edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import features as X
from barloom.operators import recursive as R
from barloom.operators.chunks import Span
from barloom.operators.studies import streaks

SPAN = Span(3600 * 20, 3)


def by_symbol(df, frame):
    got = df.toPandas().sort_values(["symbol", "ts"])
    for symbol, part in frame.sort_values("ts").groupby("symbol"):
        yield got[got.symbol == symbol].reset_index(drop=True), part.reset_index(drop=True)


def test_ema_across_chunks(walk):
    frame, bars = walk
    for mine, part in by_symbol(R.ema(bars, 12, span=SPAN), frame):
        c, y, want = part.close.values, None, []
        for i, x in enumerate(c):
            y = c[:12].mean() if i == 11 else y + (x - y) * 2 / 13 if i > 11 else None
            want.append(np.nan if y is None else y)
        np.testing.assert_allclose(mine.ema_12.astype(float), want, rtol=1e-10)


def test_parabolic_sar_is_chunk_independent(walk):
    frame, bars = walk
    small = dict()
    for span in (SPAN, Span(3600 * 100000, 8)):
        small[span] = R.parabolic_sar(bars, span=span).toPandas().sort_values(["symbol", "ts"]).sar.astype(float).values
    np.testing.assert_allclose(*small.values())


def test_features_do_not_look_ahead(walk):
    frame, bars = walk
    packs = (X.averages, X.rsi, X.atr, X.moments, X.momentum, X.consistency, X.entropy_sampled, X.hurst_sampled)
    edge = frame.ts.quantile(0.5)
    whole = X.features(bars, *packs, span=SPAN).where(F.col("ts") <= F.lit(edge)).toPandas().sort_values(["symbol", "ts"])
    cut = X.features(bars.where(F.col("ts") <= F.lit(edge)), *packs, span=SPAN).toPandas().sort_values(["symbol", "ts"])
    for name in [x for x in cut.columns if x not in ("symbol", "ts")]:
        np.testing.assert_allclose(whole[name].astype(float).values, cut[name].astype(float).values, rtol=1e-8, atol=1e-9, err_msg=name)


def test_rsi_edge_cases(spark):
    rows = [("flat", i, 10.0) for i in range(20)] + [("up", i, 10.0 + i) for i in range(20)]
    bars = spark.createDataFrame(rows, "symbol string, h int, close double").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600)).drop("h")
    last = {r["symbol"]: r["rsi_14"] for r in X.features(bars, X.rsi).where("ts = timestamp_seconds(19 * 3600)").collect()}
    assert last == {"flat": None, "up": 100.0}


def test_zero_return_in_streak(spark):
    closes = [10, 11, 12, 12, 13, 12, 11]
    bars = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(closes)], "symbol string, d int, close double").withColumn(
        "ts", F.timestamp_seconds(F.col("d") * 86400)).drop("d")
    runs = lambda policy: [r["streak"] for r in streaks(bars, policy).orderBy("ts").collect()]
    assert runs("reset") == [0, 1, 2, 0, 1, -1, -2]
    assert runs("up") == [0, 1, 2, 3, 4, -1, -2]


def test_zero_volume_gives_null_not_error(spark):
    bars = spark.createDataFrame([("a", i, 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(60)], "symbol string, h int, open double, high double, low double, close double, volume double")
    bars = bars.withColumn("ts", F.timestamp_seconds(F.col("h") * 3600)).drop("h")
    row = X.features(bars, X.vwap, X.volumes, X.book_proxies, X.cci_williams, X.candles).orderBy(F.desc("ts")).first()
    assert row["vwap"] is None and row["volume_ratio"] is None and row["close_position"] == 0.5


def loop_ema(x, n, first=None):
    first = n - 1 if first is None else first
    y = np.full(len(x), np.nan)
    y[first] = x[first - n + 1:first + 1].mean()
    for i in range(first + 1, len(x)):
        y[i] = y[i - 1] + (x[i] - y[i - 1]) * 2 / (n + 1)
    return y


def dense(spark, seconds, n, seed=2):
    import pandas as pd
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 0.1, n))
    spread = np.abs(rng.normal(0, 0.05, n))
    frame = pd.DataFrame({"symbol": "a", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * seconds, "s"),
                          "high": close + spread, "low": close - spread, "close": close})
    return frame, spark.createDataFrame(frame)


@pytest.mark.parametrize("seconds,n", [(300, 20000), (1, 60000)])
@pytest.mark.parametrize("length", [2, 200])
def test_ema_of_dense_series_equals_a_loop(spark, seconds, n, length):
    """Five-minute and one-second bars in chunks cut for hourly ones."""
    frame, bars = dense(spark, seconds, n)
    got = R.ema(bars, length).orderBy("ts").toPandas()[f"ema_{length}"].astype(float)
    np.testing.assert_allclose(got, loop_ema(frame.close.values, length), rtol=1e-11)


def test_macd_rsi_adx_of_dense_series_equal_loops(spark):
    frame, bars = dense(spark, 300, 8000)
    c = frame.close.values
    line = loop_ema(c, 12, 25) - loop_ema(c, 26)
    signal = np.full(len(c), np.nan)
    signal[25:] = loop_ema(line[25:], 9)
    got = R.macd(bars).orderBy("ts").toPandas()
    np.testing.assert_allclose(got.macd_signal.astype(float), signal, rtol=1e-8, atol=1e-11)

    def wilder(u, start, seed, n=14):
        y = np.full(len(u), np.nan)
        y[start] = seed
        for i in range(start + 1, len(u)):
            y[i] = y[i - 1] * (n - 1) / n + u[i] / n
        return y

    d = np.diff(c, prepend=np.nan)
    gain, loss = np.maximum(d, 0), np.maximum(-d, 0)
    up, down = wilder(gain, 14, gain[1:15].mean()), wilder(loss, 14, loss[1:15].mean())
    rsi = R.wilder_rsi(bars).orderBy("ts").toPandas().rsi.astype(float)
    np.testing.assert_allclose(rsi, 100 * up / (up + down), rtol=1e-9)
    before = np.concatenate(([np.nan], c[:-1]))
    tr = np.maximum(frame.high - frame.low, np.maximum(np.abs(frame.high - before), np.abs(frame.low - before))).values
    atr = R.wilder_atr_adx(bars).orderBy("ts").toPandas().atr.astype(float)
    np.testing.assert_allclose(atr, wilder(tr, 14, tr[1:15].mean()), rtol=1e-9)
