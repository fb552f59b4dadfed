"""Structured Streaming jobs over ticks and closed bars.

Stateful steps are chained through tables: a job writes closed bars, the next one streams from that
table. Each job keeps its progress in a checkpoint below the shared folder, so a lost executor or
a restarted driver resumes where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.features import LOOKBACK, build
from barloom.session import ensure_utc, shared_folder
from barloom.streaming.ordered import HOUR, in_order, on_time, too_late

LATENESS = "10 minutes"


def tick_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Ticks from ``events`` files as they land."""
    ensure_utc(spark)
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/event[s].parquet")
    return raw.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"),
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("qty"))


def table_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_table(stream: DataFrame, name: str, path: str | None = None) -> str:
    """Process everything available, append to a table, return its path."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    path = path or f"{base}/table"
    (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{base}/progress")
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return path


def closed_bars(ticks: DataFrame, width: str = "1 hour", late: str = LATENESS) -> DataFrame:
    """A bar is emitted once, when the watermark has passed its end; later ticks are dropped."""
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("bar")).agg(
        F.min_by("price", "ord").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ord").alias("close"), F.sum("qty").alias("volume"))
    return bars.select("symbol", F.col("bar.start").alias("ts"), "open", "high", "low", "close", "volume")


def newest_candles(candles: DataFrame, late: str = LATENESS) -> DataFrame:
    """Of re-sent candles (same symbol and minute) the one with the highest sequence number wins."""
    kept = candles.withWatermark("ts", late).groupBy("symbol", F.window("ts", "1 minute").alias("bar")).agg(
        F.max_by(F.struct("ord", "price", "qty"), "ord").alias("row"))
    return kept.select("symbol", F.col("bar.start").alias("ts"), "row.*")


def exact_duplicates_dropped(ticks: DataFrame, late: str = LATENESS) -> DataFrame:
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ord"])


def sliding_stats(ticks: DataFrame, width: str = "4 hours", step: str = "1 hour", late: str = LATENESS) -> DataFrame:
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width, step).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("price").alias("avg_price"), F.sum("qty").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "n", "avg_price", "volume")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = LATENESS) -> DataFrame:
    """Bursts of ticks separated by silence."""
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.max("price").alias("top"))
    return out.select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("end_ts"), "n", "top")


def with_thresholds(bars: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Stream-static join: alert when a bar moves more than its symbol's stored threshold."""
    move = F.try_divide(F.col("close") - F.col("open"), F.col("open"))
    return bars.join(thresholds, "symbol").withColumn("move", move).withColumn("alert", (F.abs("move") > F.col("threshold")).cast("int"))


def book_averages(books: DataFrame, late: str = LATENESS) -> DataFrame:
    """Sliding means of order-book features on a stream of snapshots."""
    from barloom.functions import book
    rows = books.select("symbol", "ts", *[e.alias(n) for n, e in {**book.spread(), **book.imbalance(5)}.items()])
    out = rows.withWatermark("ts", late).groupBy("symbol", F.window("ts", "6 hours", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ob_spread_pct").alias("avg_spread"), F.avg("ob_imbalance_pct_5").alias("avg_imbalance"))
    return out.select("symbol", F.col("w.start").alias("ts"), "n", "avg_spread", "avg_imbalance")


ORDER_OUT = "at bigint, decision string, value double, pnl double, day_pnl double, day_trades bigint, exposure double"
ORDER_STATE = "day bigint, pnl double, trades bigint, frees array<struct<at: bigint, value: double, pnl: double>>"
DAY = 86_400_000_000


def guard_step(balance: float, max_loss: float, max_trades: int, max_exposure: float, least_balance: float):
    """Decides every order before it is filled, from what the fills before it have led to.

    An order has a time, a value, and the time and result of its close. A fill counts against the exposure until it closes, and
    its result and one trade count on the day it closes; a refused order changes nothing.
    """
    def step(kept: list, rows: list) -> tuple[list, list]:
        day, pnl, trades, frees = kept[0] if kept else (-1, 0.0, 0, [])
        total, frees, out = balance, sorted(tuple(x) for x in frees), []
        for at, value, close_at, result in rows:
            while frees and frees[0][0] <= at:
                end, _, won = frees.pop(0)
                if end // DAY != day:
                    day, pnl, trades = end // DAY, 0.0, 0
                pnl, trades = pnl + won, trades + 1
            if at // DAY != day:
                day, pnl, trades = at // DAY, 0.0, 0
            held = sum(x[1] for x in frees)
            decision = ("daily loss" if pnl <= -max_loss else "daily trades" if trades >= max_trades
                        else "exposure" if held >= max_exposure * total else "balance" if total < least_balance else "ok")
            out.append((at, decision, value, result, pnl, trades, held))
            if decision == "ok":
                frees = sorted([*frees, (close_at, value, result)])
        return [(day, pnl, trades, frees)], out

    return step


def daily_guard(orders: DataFrame, balance: float = 10_000.0, max_loss: float = 200.0, max_trades: int = 2, max_exposure: float = 0.8,
                least_balance: float = 100.0, **times) -> DataFrame:
    """symbol, at, decision and the day's state before each order (symbol, ts, value, close_at, pnl); see ``guard_step``."""
    return in_order(orders, guard_step(balance, max_loss, max_trades, max_exposure, least_balance), "value double, close_at bigint, pnl double",
                    ORDER_STATE, ORDER_OUT, **times)


def recent_step(reach: int):
    """Gives out the last ``reach`` rows (fresh 0) before the released ones (fresh 1), and keeps as many."""
    def step(kept: list, rows: list) -> tuple[list, list]:
        out = [(*x, 0) for x in kept] + [(*x, 1) for x in rows]
        return [*kept, *rows][-reach:] if reach else [], out

    return step


BAR = "open double, high double, low double, close double, volume double"


def serve_features(bars: DataFrame, pack, name: str = "features", idle: int = 400 * 24 * HOUR, late: int = 6 * HOUR,
                   horizon: int = 30 * 24 * HOUR) -> str:
    """Features of newly closed bars by the batch expressions over a ring buffer of the bars before them.

    The last bars that the pack can reach are a list state of each symbol, dropped after ``idle`` milliseconds without bars; no bar is
    read twice from a table. Bars are taken in event-time order (see ``ordered``). Late ones are in the folder beside
    the features. Batch folders are overwritten on replay, so results are exactly once. When all available bars are read, those that
    still wait for ``late`` are served too: a row of the folder of marks moves the watermark past them, and the job goes on from its
    checkpoint.
    """
    spark = bars.sparkSession
    base = f"{shared_folder(spark)}/serve-{name}-{uuid.uuid4().hex}"
    marks, bars = f"{base}/marks", bars.withColumn("_mark", F.lit(False))
    spark.createDataFrame([], bars.schema).write.parquet(marks)
    bars = bars.unionByName(table_stream(spark, marks, bars.schema))
    values = [x.split()[0] for x in BAR.split(", ")]

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        too_late(batch).write.mode("overwrite").parquet(f"{base}/late/batch={number}")
        rows = on_time(batch).groupBy("symbol", "at").agg(F.max("fresh").alias("fresh"), *[F.first(x).alias(x) for x in values])
        frame = build(rows.select("symbol", F.timestamp_micros("at").alias("ts"), *values, "fresh"), pack).drop("_chunk", "_rn")
        frame.where("fresh = 1").drop("fresh").write.mode("overwrite").parquet(f"{base}/features/batch={number}")
        batch.unpersist()

    stream = in_order(bars, recent_step(LOOKBACK[pack.__name__]), BAR, f"at bigint, {BAR}", f"at bigint, {BAR}, fresh int",
                      late=late, horizon=horizon, idle=idle, mark="_mark")

    def run() -> str | None:
        job = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
        job.awaitTermination()
        return job.lastProgress["eventTime"].get("watermark") if job.lastProgress else None

    watermark = run()
    if watermark:
        # one millisecond after the newest bar, as watermarks have no finer part
        ahead = F.timestamp_millis(F.unix_millis(F.to_timestamp(F.lit(watermark))) + horizon + late + 1)
        row = {"ts": ahead, "_mark": F.lit(True)}
        spark.range(1).select(*[row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in bars.schema]).write.mode("append").parquet(marks)
        run()
    return f"{base}/features"


POSITION_OUT = "entry_at bigint, exit_at bigint, entry_price double, exit_price double, reason string, pnl double"


def position_step(stop: float, target: float):
    def step(kept: list, rows: list) -> tuple[list, list]:
        entry, price = kept[0] if kept else (None, None)
        out = []
        for at, open_, high, low, close in rows:
            if price is not None:
                hit = "SL" if low <= price * (1 - stop) else "TP" if high >= price * (1 + target) else None
                if hit:
                    left = price * (1 - stop) if hit == "SL" else price * (1 + target)
                    out.append((entry, at, price, left, hit, left / price - 1))
                    entry = price = None
            elif close > open_:
                entry, price = at, close
        return [(entry, price)] if price is not None else [], out

    return step


def positions(bars: DataFrame, stop: float = 0.05, target: float = 0.10, **times) -> DataFrame:
    """One open long per symbol: stop and target are tested on every bar in time order, closes are emitted.

    A bar closing above its open enters when flat. Bars may arrive in any order within ``late``; later ones are given out
    with ``late_at``.
    """
    return in_order(bars, position_step(stop, target), "open double, high double, low double, close double", "entry_at bigint, price double",
                    POSITION_OUT, **times)


def regime_step(kept: list, rows: list) -> tuple[list, list]:
    out, seen = [], [x[0] for x in kept]
    for at, regime in rows:
        seen = [*seen, regime][-3:]
        major = [r for r in seen if seen.count(r) * 2 > 3]
        out.append((at, regime, major[0] if major else regime))
    return [(r,) for r in seen], out


def steady_regimes(rows: DataFrame, **times) -> DataFrame:
    """Majority of the last three regimes per symbol in time order, kept in state."""
    return in_order(rows, regime_step, "regime string", "regime string", "at bigint, regime string, steady_regime string", **times)
