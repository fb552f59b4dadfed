"""Chunked windows and scans equal plain per-symbol computation, whatever the chunk length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators.align import asof
from barloom.operators.chunks import Span, chunked, clean, ordered, owned, prefix

SPANS = [Span(3600 * 7, 3), Span(3600 * 24, 8), Span(3600 * 5000, 8)]


def sorted_pdf(df):
    return df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


@pytest.mark.parametrize("span", SPANS)
def test_halo_frames_match_unchunked(walk, span):
    frame, bars = walk
    w = ordered()
    df = chunked(bars, before=30, after=9, span=span).withColumns({
        "s": F.sum("close").over(w.rowsBetween(-29, 0)), "ahead": F.lead("close", 9).over(w), "row": F.col("_rn")})
    got = sorted_pdf(clean(df))
    want = frame.sort_values(["symbol", "ts"]).reset_index(drop=True)
    g = want.groupby("symbol")
    assert len(got) == len(want)
    np.testing.assert_allclose(got["s"], g["close"].transform(lambda x: x.rolling(30, min_periods=1).sum()), rtol=1e-10)
    np.testing.assert_allclose(got["ahead"], g["close"].shift(-9))
    np.testing.assert_array_equal(got["row"], g.cumcount())


@pytest.mark.parametrize("span", SPANS)
def test_scans_match_cumulative(walk, span):
    frame, bars = walk
    df = owned(chunked(bars.withColumn("x", F.when(F.col("volume") > 40, F.col("volume"))), span=span))
    got = sorted_pdf(prefix(df, {"s": ("sum", "volume"), "m": ("max", "close"), "l": ("last", "x")}))
    g = frame.assign(x=frame.volume.where(frame.volume > 40)).sort_values(["symbol", "ts"]).reset_index(drop=True).groupby("symbol")
    np.testing.assert_allclose(got["s"], g["volume"].cumsum())
    np.testing.assert_allclose(got["m"], g["close"].cummax())
    np.testing.assert_allclose(got["l"], g["x"].ffill())


def test_exclusive_scan(walk):
    frame, bars = walk
    df = owned(chunked(bars, span=SPANS[0]))
    got = sorted_pdf(prefix(df, {"s": ("sum", "volume")}, inclusive=False))
    want = frame.sort_values(["symbol", "ts"]).reset_index(drop=True).groupby("symbol")["volume"].transform(lambda x: x.cumsum().shift(1))
    np.testing.assert_allclose(got["s"], want)


def test_asof_matches_pandas(spark, walk):
    import pandas as pd
    frame, bars = walk
    right = frame[["symbol", "ts"]].sample(80, random_state=1).assign(v=range(80))
    right["ts"] = right["ts"] + pd.Timedelta(minutes=30)
    got = sorted_pdf(asof(bars.select("symbol", "ts"), spark.createDataFrame(right), ["v"], span=SPANS[0]))
    want = pd.merge_asof(frame[["symbol", "ts"]].sort_values("ts"), right.sort_values("ts"), on="ts", by="symbol").sort_values(["symbol", "ts"])
    np.testing.assert_allclose(got["v"].astype(float), want["v"].astype(float))


def test_asof_sees_equal_stamp(spark):
    left = spark.sql("select 'a' symbol, timestamp'2024-01-01 01:00:00' ts")
    right = spark.sql("select 'a' symbol, timestamp'2024-01-01 01:00:00' ts, 7 v")
    assert asof(left, right, ["v"]).first()["v"] == 7
