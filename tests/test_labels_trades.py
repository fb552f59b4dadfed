"""Set-based labels, exits and trade selection against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import labels as L
from barloom.operators import trades as T
from barloom.operators.chunks import Span, chunked

SPAN = Span(3600 * 20, 3)


def loop_labels(part, tp, sl, hold):
    h, l, c = part.high.values, part.low.values, part.close.values  # noqa: E741
    tr = np.array([h[0] - l[0]] + [max(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])) for i in range(1, len(c))])
    atr = pd.Series(tr).rolling(14).mean().values
    out = []
    for i in range(len(c)):
        if np.isnan(atr[i]) or i + hold > len(c):
            out.append((None, None))
            continue
        label, held = 0, hold
        for j in range(i + 1, i + hold):
            if l[j] <= c[i] - sl * atr[i]:
                label, held = -1, j - i
                break
            if h[j] >= c[i] + tp * atr[i]:
                label, held = 1, j - i
                break
        out.append((label, held))
    return out


def test_triple_barrier_against_loop(walk):
    frame, bars = walk
    got = L.triple_barrier(bars, tp=1.0, sl=0.7, hold=10, span=SPAN).toPandas().sort_values(["symbol", "ts"])
    for symbol, part in frame.sort_values("ts").groupby("symbol"):
        mine = got[got.symbol == symbol]
        want = loop_labels(part, 1.0, 0.7, 10)
        assert [None if pd.isna(x) else int(x) for x in mine.tb_label] == [w[0] for w in want]
        assert [None if pd.isna(x) else int(x) for x in mine.tb_holding] == [w[1] for w in want]


def loop_exit(entry, side, atr, tp, sl, hold, mode, trail, future):
    stop, target, secured = entry - side * sl * atr, entry + side * tp * atr, False
    for k, (h, l, c) in enumerate(future, 1):  # noqa: E741
        best, worst = (h, l) if side > 0 else (l, h)
        if side * (worst - stop) <= 0:
            return k, stop, "SL"
        if side * (best - target) >= 0:
            return k, target, "TP"
        if k >= hold:
            return k, c, "TIMEOUT"
        if mode == "trailing":
            stop = side * max(side * stop, side * (best - side * trail * atr))
        if mode == "breakeven" and not secured and side * (best - (entry + side * trail * atr)) >= 0:
            stop, secured = side * max(side * stop, side * entry), True
    return None, None, None


@pytest.mark.parametrize("mode", ["fixed", "trailing", "breakeven"])
@pytest.mark.parametrize("side", [1, -1])
def test_exits_against_loop(walk, mode, side):
    frame, bars = walk
    df = T.with_future(chunked(bars, after=12, span=SPAN), 12).where("_own").withColumns({
        "side": F.lit(side), "entry_price": F.col("close"), "atr_entry": F.col("close") * 0.02, "tp_mult": F.lit(1.5), "sl_mult": F.lit(1.0),
        "hold": F.lit(8), "exit_mode": F.lit(mode), "trail_mult": F.lit(0.6)})
    got = T.resolve_exits(df).select("symbol", "ts", "bars_held", "exit_price", "reason").toPandas().sort_values(["symbol", "ts"])
    for symbol, part in frame.sort_values("ts").groupby("symbol"):
        rows = part[["high", "low", "close"]].values.tolist()
        mine = got[got.symbol == symbol].to_dict("records")
        for i, row in enumerate(mine):
            k, price, why = loop_exit(rows[i][2], side, rows[i][2] * 0.02, 1.5, 1.0, 8, mode, 0.6, rows[i + 1:i + 13])
            assert (row["reason"] or None) == why
            if why:
                assert int(row["bars_held"]) == k and abs(row["exit_price"] - price) < 1e-9


@pytest.mark.parametrize("cooldown", [0, 3])
def test_one_at_a_time_against_loop(spark, cooldown, monkeypatch):
    monkeypatch.setattr(T, "ROWS_PER_PART", 16)
    rng = np.random.default_rng(2)
    rows = [(s, int(rn), None if rng.random() < 0.01 else int(rng.integers(1, 13))) for s, n in (("hot", 900), ("b", 60)) for rn in sorted(rng.choice(2000, n, replace=False))]
    df = spark.createDataFrame(rows, "symbol string, entry_rn bigint, bars_held int").withColumn("tag", F.col("entry_rn") * 2)
    got = {(r["symbol"], r["entry_rn"]) for r in T.one_at_a_time(df, ["symbol"], 12, cooldown).collect()}
    want, free = set(), {}
    for s, rn, held in rows:
        if rn >= free.get(s, 0):
            want.add((s, rn))
            free[s] = float("inf") if held is None else rn + held + 1 + cooldown
    assert got == want


def test_running_product_signs_and_zero(spark):
    xs = [2.0, -3.0, 0.5, -1.0, 4.0, 0.0, 5.0]
    df = spark.createDataFrame([("a", i, x, i // 3) for i, x in enumerate(xs)], "symbol string, ts int, x double, _chunk long")
    got = [r["p"] for r in T.running_product(df, "x", "p").orderBy("ts").collect()]
    np.testing.assert_allclose(got, np.cumprod(xs))


def test_signal_backtest_conserves_equity(walk, spark):
    frame, bars = walk
    df = bars.withColumn("signal", F.when(F.pmod(F.hour("ts"), F.lit(5)) < 2, 1).when(F.pmod(F.hour("ts"), F.lit(5)) == 3, -1).otherwise(0))
    curve = T.signal_backtest(df, fee=0.001, span=SPAN).toPandas().sort_values(["symbol", "ts"])
    for _, part in curve.groupby("symbol"):
        want = 10_000 * (1 + part.net_ret.fillna(0)).cumprod()
        np.testing.assert_allclose(part.equity, want, rtol=1e-9)


def test_partial_exit_takes_half(spark):
    future = [(102.5, 99.9, 102.0), (102.2, 99.0, 99.5)]
    rows = [("a", 1, 100.0, 2.0, future)]
    df = spark.createDataFrame(rows, "symbol string, side int, entry_price double, atr_entry double, _future array<struct<high: double, low: double, close: double>>")
    df = df.withColumn("_future", F.transform("_future", lambda b: F.struct(b["high"], b["low"], b["close"], F.lit(0.0).alias("funding"))))
    df = df.withColumns({"tp_mult": F.lit(5.0), "sl_mult": F.lit(1.0), "hold": F.lit(5), "trail_mult": F.lit(1.0)})
    row = T.with_partial(df).first()
    assert row["partial_taken"] == 1 and row["reason"] == "SL" and abs(row["total_ret"] - 0.01) < 1e-12


def test_one_position_of_many_runs_equals_a_loop(spark):
    """Links over several parts, entries that never close, empty parts, and runs that reach over Arrow batches."""
    rng = np.random.default_rng(8)
    rows, want = [], set()
    for run in range(60):
        at = np.unique(rng.integers(0, 512 * 6, rng.integers(1, 900)))
        at = at[(at < 900) | (at > 2000)] if run % 3 else at
        held = rng.integers(1, 19, len(at)).astype(object)
        if run % 7 == 0 and len(at):
            held[-1] = None
        free = 0
        for a, h in zip(at.tolist(), held.tolist()):
            rows.append((run, a, h, f"t{a}"))
            if a >= free:
                want.add((run, a, h, f"t{a}"))
                free = a + h + 1 + 2 if h else 1 << 50
    df = spark.createDataFrame(rows, "run int, entry_rn long, bars_held int, tag string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {(r.run, r.entry_rn, r.bars_held, r.tag) for r in T.one_at_a_time(df, ["run"], 18, 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert T.one_at_a_time(df.where("false"), ["run"], 18, 2).collect() == []


def test_account_curve_equals_two_scans(spark):
    rng = np.random.default_rng(9)
    rows = [(run, int(a), float(g)) for run in range(20) for a, g in zip(np.sort(rng.choice(4000, 300, replace=False)), rng.normal(0.001, 0.02, 300))]
    rows += [(99, 1, 0.5), (99, 700, -1.5), (99, 1400, 0.3), (98, 5, -1.0), (98, 6, 0.1)]
    df = spark.createDataFrame(rows, "run int, entry_rn long, growth double").cache()
    two = T.stop_at_drawdown(T.trade_equity(df, "growth", ["run"], 25_000.0), ["run"])
    pick = lambda x: {(r.run, r.entry_rn): (r.capital, r.peak, r.dd) for r in x.select("run", "entry_rn", "capital", "peak", "dd").collect()}
    one, other = pick(T.account_curve(df, "growth", ["run"])), pick(two)
    assert one.keys() == other.keys() and len(one) < len(rows)
    for k, v in one.items():
        np.testing.assert_allclose(v, other[k], rtol=1e-9, atol=1e-6)
