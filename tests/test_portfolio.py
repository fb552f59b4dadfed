"""Hysteresis trades, exact strata and the ordered kernel against plain loops."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.functions import custom as U
from barloom.operators import splits as V
from barloom.operators import trades as T
from barloom.operators.chunks import Span, chunked

SPAN = Span(3600 * 20, 3)


def loop_trades(part, p, share, hold):
    """Bar by bar: (row, reason, bars held, result) of every trade."""
    low, high, close = part.low.values, part.high.values, part.close.values
    out, held = [], None
    for i in range(len(close)):
        if held is None:
            if p[i] > 0.55:
                stop, target = (0.05, 0.02) if share[i] < 0.0025 else (0.05, 0.03) if share[i] < 0.005 else (0.08, 0.04)
                held = (i, close[i], close[i] * (1 - stop), close[i] * (1 + target))
            continue
        row, paid, lo, hi = held
        end = ((lo, "SL") if low[i] <= lo else (hi, "TP") if high[i] >= hi else (close[i], "SIGNAL") if p[i] < 0.45
               else (close[i], "TIMEOUT") if i - row >= hold else None)
        if end:
            out.append((row, end[1], i - row, end[0] / paid - 1))
            held = None
    if held:
        out.append((held[0], "EOD", len(close) - 1 - held[0], close[-1] / held[1] - 1))
    return out


def test_hysteresis_trades_against_loop(spark, walk):
    frame, _ = walk
    rng = np.random.default_rng(3)
    frame = frame.sort_values(["symbol", "ts"]).reset_index(drop=True)
    frame["p"] = np.clip(0.55 + np.cumsum(rng.normal(0, 0.01, len(frame))) % 0.3 - 0.1, 0, 1)
    frame["atr_share"] = rng.choice([0.001, 0.004, 0.02, np.nan], len(frame))
    bars = spark.createDataFrame(frame).withColumn("atr_share", F.expr("nullif(atr_share, double('NaN'))"))
    df = chunked(bars, after=9, span=SPAN)
    df = df.withColumn("_next", F.collect_list(F.struct("high", "low", "close", "p")).over(T.W.rowsBetween(1, 9))).where("_own")
    got = T.hysteresis_trades(df.withColumn("entry_rn", F.col("_rn")), hold=9).toPandas().sort_values(["symbol", "entry_rn"])
    for symbol, part in frame.groupby("symbol"):
        mine, want = got[got.symbol == symbol], loop_trades(part, part.p.values, part.atr_share.values, 9)
        assert list(zip(mine.entry_rn, mine.reason, mine.bars_held)) == [w[:3] for w in want]
        assert np.allclose(mine.gross_ret, [w[3] for w in want])
    assert len(got) > 20


def test_stratified_split_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"symbol": "s", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(3001), "h"),
                         "label": rng.choice([0, 1, 2], 3001, p=[0.9, 0.099, 0.001])})
    rows.loc[3000, "label"] = 7  # one row of its label
    df = spark.createDataFrame(rows).withColumn("label", F.when(F.col("label") != 2, F.col("label")))
    for digits in (1, 4):
        got = V.stratified_split(df, digits=digits).toPandas()
        assert len(got) == 3001
        for kind, part in got.groupby(got.label.map(lambda x: "-" if pd.isna(x) else str(int(x)))):
            name = lambda r: hashlib.md5(f"s|{r.ts.value // 1000}|{kind}|42".encode()).hexdigest()  # noqa: E731, B023
            order = sorted(part.itertuples(), key=name)
            n = (len(order) * 20 + 50) // 100
            assert {r.ts for r in order[:n]} == set(part[part.split == "test"].ts), kind
    assert V.stratified_split(df.limit(0)).count() == 0


def test_ordered_kernel_sees_rows_in_order(spark):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"symbol": rng.choice(["a", "b"], 500), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.permutation(500), "h"),
                         "r": rng.normal(0, 0.01, 500)})
    got = U.ordered_kernel(spark.createDataFrame(rows).repartition(5), U.cusum(0.02), "symbol string, ts timestamp, side int", ["symbol"], ["ts"]).toPandas()
    want = []
    for symbol, part in rows.sort_values("ts").groupby("symbol"):
        up = down = 0.0
        for r in part.itertuples():
            up, down = max(0.0, up + r.r), min(0.0, down + r.r)
            if up > 0.02:
                want.append((symbol, r.ts, 1))
                up = 0.0
            elif down < -0.02:
                want.append((symbol, r.ts, -1))
                down = 0.0
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want) and len(want) > 20
