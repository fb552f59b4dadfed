"""Throttled sizes, runs of red candles and intraday prices against plain loops."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import rules as R


def loop(part, capital=25_000.0, full=5.0, small=2.0, limit=0.3):
    eq = peak = capital
    out = []
    for x in part.sort_values("ts").pnl_pct:
        size = small if (peak - eq) / peak * 100 > limit else full
        eq *= 1 + size / 100 * x / 100
        peak = max(peak, eq)
        out.append((size, eq))
    return out


@pytest.mark.parametrize("days", [3, 40, 4000])
def test_throttled_against_loop(spark, days):
    rng = np.random.default_rng(days)
    parts = [pd.DataFrame({"symbol": s, "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.sort(rng.choice(3 * n, n, replace=False)), "D"),
                           "pnl_pct": rng.normal(0.2, 4, n)}) for s, n in (("hot", 900), ("b", 40), ("one", 1))]
    rows = pd.concat(parts)
    got = R.throttled(spark.createDataFrame(rows), buckets=86_400 * days).toPandas().sort_values(["symbol", "ts"])
    assert len(got) == len(rows) and set(got["size"]) == {2.0, 5.0}
    for symbol, part in rows.groupby("symbol"):
        mine, want = got[got.symbol == symbol], loop(part)
        assert list(mine["size"]) == [w[0] for w in want]
        assert np.allclose(mine.equity, [w[1] for w in want], rtol=1e-12)


def test_red_runs_against_loop(spark):
    rng = np.random.default_rng(7)
    rows = pd.concat([pd.DataFrame({"symbol": s, "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n), "D"), "open": 100.0,
                                    "close": 100 + rng.choice([-2.0, -1.0, 0.0, 1.0], n)}) for s, n in (("hot", 800), ("b", 2))])
    got = R.red_runs(spark.createDataFrame(rows)).toPandas().sort_values(["symbol", "ts"])
    for symbol, part in rows.groupby("symbol"):
        run, move, want = 0, 0.0, []
        for r in part.itertuples():
            want.append((run, move))
            run, move = (run + 1, move + (r.close - r.open) / r.open * 100) if r.close < r.open else (0, 0.0)
        mine = got[got.symbol == symbol]
        assert list(mine.red_run) == [w[0] for w in want]
        assert np.allclose(mine.red_move, [w[1] for w in want])


def test_intraday_prices_need_their_bars(spark):
    def day(date, minutes):
        return [("a", pd.Timestamp(date) + pd.Timedelta(minutes=m), float(m), m + 1.0, m - 1.0, m + 0.5) for m in minutes]
    rows = day("2024-01-02", [540, 565, 570, 575, 590, 625, 635, 640, 700, 900]) + day("2024-01-03", [545, 575, 600, 640])
    bars = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts", "open", "high", "low", "close"]))
    full, thin = R.intraday_prices(bars).orderBy("ts").collect()
    assert (full.at_925, full.bar_930, full.near_1030, full.hour_10_close, full.pre_bars, full.or_bars, full.rest_bars) == (565.5, 570.0, 635.5, 640.5, 2, 2, 6)
    assert (thin.at_925, thin.bar_930, thin.near_1030, thin.hour_10_close, thin.open_930) == (None, None, None, 640.5, 575.0)
    trades = R.rule_trades(R.intraday_prices(bars).selectExpr("*", "-3L AS st", "10.0D AS vx", "0 AS dow"), R.INTRADAY_RULES).collect()
    by_day = {d: {t.rule for t in trades if t.ts.day == d} for d in (2, 3)}
    assert {"S2", "S10", "S10b", "S11", "S17"} <= by_day[2] and not {"S2", "S10", "S10b", "S11"} & by_day[3] and "S17" in by_day[3]
    assert [t.ts.day for t in R.range_breaks(bars).collect()] == [2]
