"""Several micro-batches give what one batch gives; late rows are dropped."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import features as X
from barloom.sources.files import fresh_path
from barloom.streaming import jobs as J
from barloom.streaming.ordered import HOUR, in_order, too_late

TICK = "symbol string, ts timestamp, ord bigint, price double, qty double"


def landed(spark, name, frames):
    path = fresh_path(spark, name)
    for frame in frames:
        spark.createDataFrame(frame, TICK).coalesce(1).write.mode("append").parquet(path)
    return J.table_stream(spark, path, spark.createDataFrame([], TICK).schema, 1)


def tick(symbol, stamp, ord_, price=1.0):
    return (symbol, pd.Timestamp(stamp).to_pydatetime(), ord_, price, 1.0)


def test_late_tick_is_dropped_and_bars_close_once(spark):
    stream = landed(spark, "late", [
        [tick("a", "2024-01-01 00:10", 1, 5.0), tick("a", "2024-01-01 00:50", 2, 7.0)],
        [tick("a", "2024-01-01 03:00", 3, 9.0)],
        [tick("a", "2024-01-01 06:00", 5, 1.0)],
        [tick("a", "2024-01-01 00:20", 4, 99.0)],
    ])
    rows = spark.read.parquet(J.run_to_table(J.closed_bars(stream), "t")).orderBy("ts").collect()
    assert [(r["ts"].hour, r["high"]) for r in rows] == [(0, 7.0), (3, 9.0)]


def test_state_survives_batches(spark):
    bars = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
    path = fresh_path(spark, "bars")
    for frame in ([("a", pd.Timestamp("2024-01-01 00:00").to_pydatetime(), 10.0, 11.0, 9.9, 10.5, 1.0)], [("a", pd.Timestamp("2024-01-01 01:00").to_pydatetime(), 10.5, 12.0, 10.4, 11.9, 1.0)]):
        spark.createDataFrame(frame, bars).coalesce(1).write.mode("append").parquet(path)
    stream = J.table_stream(spark, path, spark.createDataFrame([], bars).schema, 1)
    row = spark.read.parquet(J.run_to_table(J.positions(stream, late=0), "p")).first()
    assert row["reason"] == "TP" and abs(row["pnl"] - 0.10) < 1e-12


def test_served_features_equal_batch(spark, walk):
    _, bars = walk
    path = fresh_path(spark, "walk")
    edges = ["2024-01-01", "2024-01-12", "2024-01-20", "2025-01-01"]
    for a, b in zip(edges, edges[1:]):
        bars.where((F.col("ts") >= a) & (F.col("ts") < b)).coalesce(1).write.mode("append").parquet(path)
    out = J.serve_features(J.table_stream(spark, path, bars.schema, 1), X.strategy_inputs, late=0)
    served = spark.read.parquet(out).select("symbol", "ts", F.round("rsi_14", 8), F.round("dev_z", 8))
    batch = X.features(bars, X.strategy_inputs).select("symbol", "ts", F.round("rsi_14", 8), F.round("dev_z", 8))
    assert served.count() == bars.count() and served.exceptAll(batch).count() == 0


def test_the_newest_bars_are_served_too(spark):
    """Bars that still wait for late files when all files are read, in files whose bars are out of order."""
    path = fresh_path(spark, "newest")
    bar = lambda symbol, h: (symbol, (pd.Timestamp("2024-01-01") + pd.Timedelta(h, "h")).to_pydatetime(), 10.0, 11.0, 9.0, 10.0 + h, 1.0)
    for hours in ((0, 1, 2, 5, 30, 33), (31, 32, 34, 36), (35,)):
        rows = [bar(s, h) for s in ("a", "c") for h in hours] + ([bar("b", 36)] if 36 in hours else [])
        spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(path)
    bars = spark.read.schema(spark.createDataFrame([], BARS).schema).parquet(path)
    out = J.serve_features(J.table_stream(spark, path, bars.schema, 1), X.averages)
    served = spark.read.parquet(out).select("symbol", "ts", "close", F.round("ma_20", 8), F.round("ma_50", 8))
    batch = X.features(bars, X.averages).select("symbol", "ts", "close", F.round("ma_20", 8), F.round("ma_50", 8))
    assert served.count() == bars.count() == 23 and served.exceptAll(batch).count() == 0
    assert spark.read.parquet(out.replace("/features", "/late")).count() == 0


BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
DAY = 24 * HOUR


def dealt(spark, rows, files, seed):
    """The rows dealt at random to files that are read one after the other; a last row of another key ends the stream."""
    rng = np.random.default_rng(seed)
    place = rng.integers(0, files, len(rows))
    path = fresh_path(spark, "dealt")
    for k in range(files):
        spark.createDataFrame(rows[place == k], BARS).coalesce(1).write.mode("append").parquet(path)
    end = pd.DataFrame([("end", pd.Timestamp("2030-01-01"), 1.0, 1.0, 1.0, 1.0, 1.0)], columns=rows.columns)
    spark.createDataFrame(end, BARS).coalesce(1).write.mode("append").parquet(path)
    return J.table_stream(spark, path, spark.createDataFrame([], BARS).schema, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_positions_and_regimes_are_the_same_for_any_file_order(spark, walk, seed):
    rows = walk[0]
    rows = rows[rows.symbol != "tiny"].groupby("symbol").head(60)
    want, kept = set(), {}
    for symbol, part in rows.sort_values("ts").groupby("symbol"):
        _, out = J.position_step(0.05, 0.10)([], [(t.value // 1000, o, h, l, c) for t, o, h, l, c in zip(part.ts, part.open, part.high, part.low, part.close)])
        want |= {(symbol, *x) for x in out}
        kept[symbol] = len(part)
    late = dict(late=60 * DAY, horizon=90 * DAY)
    got = spark.read.parquet(J.run_to_table(J.positions(dealt(spark, rows, 5, seed), **late), "p")).collect()
    assert {tuple(r)[:-1] for r in got} == want and all(r.late_at is None for r in got) and len(want) > 3
    regimes = lambda df: df.withColumn("regime", F.when(F.col("close") > F.col("open"), "up").otherwise("down"))
    got = spark.read.parquet(J.run_to_table(J.steady_regimes(regimes(dealt(spark, rows, 5, seed)), **late), "r")).where("symbol <> 'end'")
    assert {r.symbol: r["count"] for r in got.groupBy("symbol").count().collect()} == kept


def test_rows_that_come_too_late_are_given_out(spark):
    path = fresh_path(spark, "toolate")
    hours = ["2024-01-01 00:00", "2024-01-01 05:00", "2024-01-01 20:00", "2024-01-01 21:00", "2024-01-01 01:00", "2024-01-02 20:00"]
    for h in hours:
        spark.createDataFrame([("a", pd.Timestamp(h).to_pydatetime(), 10.0, 10.1, 9.9, 10.05, 1.0)], BARS).coalesce(1).write.mode("append").parquet(path)
    stream = J.table_stream(spark, path, spark.createDataFrame([], BARS).schema, 1)
    regimes = stream.withColumn("regime", F.lit("up"))
    table = spark.read.parquet(J.run_to_table(J.steady_regimes(regimes, late=2 * HOUR), "late"))
    assert [r.ts for r in too_late(table).collect()] == [pd.Timestamp(hours[4])]
    assert sorted(pd.Timestamp(r.at, unit="us") for r in J.on_time(table).collect()) == [pd.Timestamp(hours[k]) for k in (0, 1, 2, 3)]


def test_guard_decides_before_the_fill_and_forgets_refused_orders():
    day, hour = J.DAY, J.DAY // 24
    step = J.guard_step(1000.0, 50.0, 2, 0.8, 100.0)
    orders = [(0, 500.0, 2 * hour, -60.0), (hour, 400.0, 3 * hour, 5.0), (hour + 1, 10.0, 3 * hour, 1.0), (4 * hour, 10.0, 5 * hour, 9.0),
              (day, 10.0, day + 1, 1.0), (day + hour, 10.0, day + hour + 1, 1.0), (day + 2 * hour, 10.0, day + 9 * hour, 1.0)]
    want = ["ok", "ok", "exposure", "daily loss", "ok", "ok", "daily trades"]
    kept, out = step([], orders)
    assert [x[1] for x in out] == want and out[3][4:6] == (-55.0, 2) and out[4][4:6] == (0.0, 0)
    again, one = [], []
    for o in orders:  # the same one by one, through the state
        again, x = step(again, [o])
        one += x
    assert one == out and again == kept
    assert J.guard_step(50.0, 50.0, 2, 0.8, 100.0)([], orders[:1])[1][0][1] == "balance"


def test_ring_of_a_silent_symbol_is_dropped(spark):
    path = fresh_path(spark, "idle")
    for symbol, h in (("a", "2024-01-01"), ("b", "2024-01-20"), ("b", "2024-02-01"), ("a", "2024-02-02"), ("b", "2024-03-20")):
        spark.createDataFrame([(symbol, pd.Timestamp(h).to_pydatetime(), 1.0, 1.0, 1.0, 1.0, 1.0)], BARS).coalesce(1).write.mode("append").parquet(path)
    stream = J.table_stream(spark, path, spark.createDataFrame([], BARS).schema, 1)
    out = in_order(stream, J.recent_step(3), J.BAR, f"at bigint, {J.BAR}", f"at bigint, {J.BAR}, fresh int", late=0, idle=14 * DAY)
    rows = spark.read.parquet(J.run_to_table(out, "idle")).where("symbol = 'a'").collect()
    assert sorted((pd.Timestamp(r.at, unit="us").month, r.fresh) for r in rows) == [(1, 1), (2, 1)]
