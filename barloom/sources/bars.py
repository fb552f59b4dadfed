"""Tick to bar building and the market tables derived from the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.chunks import seconds
from barloom.session import cut_lineage, ensure_utc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ohlcv(ticks: DataFrame, keys: list, order: str = "ord", counted: bool = False) -> DataFrame:
    """Open, high, low, close and volume per key; partial aggregates combine before the shuffle."""
    position = F.col(order)
    return ticks.groupBy(*keys).agg(
        F.min_by("price", position).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", position).alias("close"),
        F.sum("qty").alias("volume"),
        *([F.count(F.lit(1)).alias("n_ticks")] if counted else []),
    )


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Tick tape from ``events``: one price and quantity per event."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("ord"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"),
    )


def resample(source: DataFrame, width: str) -> DataFrame:
    """Ticks to bars of ``width`` ('1 hour', '4 hours', '1 day'), stamped at the bar start."""
    stamped = source.withColumn("_bar", F.window("ts", width)["start"]).drop("ts")
    return ohlcv(stamped, ["symbol", F.col("_bar").alias("ts")])


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars with the tick count: everything hourly derives from this one scan of the ticks."""
    return ohlcv(ticks(spark, folder).withColumn("ts", F.date_trunc("hour", "ts")), ["symbol", "ts"], counted=True)


def bars_1h(spark: SparkSession, folder: str) -> DataFrame:
    return hourly(spark, folder).drop("n_ticks")


def stored_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars written once: the tick scan runs a single time however often bars are read."""
    return cut_lineage(bars_1h(spark, folder))


def stored_daily(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(daily(spark, folder))


def rebar(bars: DataFrame, width: str) -> DataFrame:
    """Coarser bars from finer ones: first open, last close, extremes, summed volume."""
    return (
        bars.withColumn("_bar", F.window("ts", width)["start"])
        .groupBy("symbol", F.col("_bar").alias("bar_ts"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("bar_ts", "ts")
    )


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars from ``lineitem``: ship flag as symbol, unit price, quantity as volume."""
    position = F.struct(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )
    return ohlcv(
        table(spark, folder, "lineitem").select(
            F.col("l_returnflag").alias("symbol"),
            F.col("l_shipdate").cast("date").cast("timestamp").alias("ts"),
            position.alias("ord"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("qty"),
        ),
        ["symbol", "ts"],
    )


def volatility_index(spark: SparkSession, folder: str) -> DataFrame:
    """Market-wide daily index from ``orders``, scaled into 10..35."""
    per_day = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderdate").cast("date").cast("timestamp").alias("ts"))
        .agg(F.avg("o_totalprice").alias("_level"))
    )
    top = per_day.agg(F.max("_level")).scalar()
    return per_day.select("ts", (10 + 25 * F.col("_level") / top).alias("vix"))


def index_with_term(spark: SparkSession, folder: str, days: int = 60) -> DataFrame:
    """The daily index and yesterday's slope to its own ``days`` mean, a stand-in for a 3-month index."""
    from barloom.operators.chunks import DAILY, chunked, clean, ordered
    w = ordered("ts", ())
    df = chunked(cut_lineage(volatility_index(spark, folder)), before=days + 1, span=DAILY, key=())
    mean = F.when(F.count("vix").over(w.rowsBetween(-(days - 1), 0)) == days, F.avg("vix").over(w.rowsBetween(-(days - 1), 0)))
    df = df.withColumn("_term", F.try_divide(mean - F.col("vix"), F.col("vix")))
    return clean(df.withColumn("term_prev", F.lag("_term").over(w)))


def _next_symbol(source: DataFrame) -> DataFrame:
    """Alphabetical successor of every symbol, wrapping round."""
    names = source.select("symbol").distinct()
    whole = Window.partitionBy(F.lit(1))
    return names.select(
        "symbol",
        F.coalesce(F.lead("symbol").over(whole.orderBy("symbol")), F.min("symbol").over(whole)).alias("donor"),
    )


def funding_from(hourly: DataFrame) -> DataFrame:
    """Sparse 8-hour series: last value of the next symbol in each block, stamped at the block end."""
    block = F.floor(seconds() / F.lit(8 * 3600)).cast("bigint")
    per_block = hourly.groupBy("symbol", block.alias("block")).agg(F.max_by("close", "ts").alias("price"))
    pairs = _next_symbol(hourly).select(F.col("symbol").alias("taker"), F.col("donor").alias("symbol"))
    return per_block.join(pairs, "symbol").select(
        F.col("taker").alias("symbol"),
        F.timestamp_seconds((F.col("block") + 1) * 8 * 3600).alias("ts"),
        ((F.col("price") - 50) / 1e5).alias("funding_rate"),
    )


def funding(spark: SparkSession, folder: str) -> DataFrame:
    return funding_from(stored_bars(spark, folder))
