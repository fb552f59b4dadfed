"""File sources and sinks: typed scans, partitioned writes, landed exchange JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import shared_folder

BAR_SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
TRADE_SCHEMA = ("trade_id bigint, symbol string, side string, entry_ts timestamp, exit_ts timestamp, "
                "entry_price double, exit_price double, reason string, bars_held bigint, pnl double")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_bars(bars: DataFrame, path: str) -> None:
    """Partitioned by symbol and month, so a reader prunes both."""
    (bars.withColumn("month", F.date_format("ts", "yyyy-MM"))
     .repartition("symbol", "month")
     .write.mode("errorifexists").partitionBy("symbol", "month").parquet(path))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAR_SCHEMA + ", month string").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


PAGE = "struct<category:string,symbol:string,list:array<array<string>>>"


def kline_pages(bars: DataFrame) -> DataFrame:
    """One exchange-shaped JSON page per symbol and day: rows of text, newest first."""
    row = F.array(
        F.unix_millis("ts").cast("string"),
        *[F.col(x).cast("string") for x in ("open", "high", "low", "close", "volume")])
    return (
        bars.groupBy("symbol", F.to_date("ts").alias("day"))
        .agg(F.sort_array(F.collect_list(row), asc=False).alias("list"))
        .select(F.to_json(F.struct(F.lit("linear").alias("category"), "symbol", "list")).alias("body"))
    )


def parse_klines(pages: DataFrame) -> DataFrame:
    """Landed kline pages to typed bars."""
    parsed = pages.select(F.from_json("body", PAGE).alias("p")).select("p.symbol", F.explode("p.list").alias("k"))
    names = ("open", "high", "low", "close", "volume")
    return parsed.select(
        "symbol", F.timestamp_millis(F.col("k")[0].cast("bigint")).alias("ts"),
        *[F.col("k")[i + 1].cast("double").alias(x) for i, x in enumerate(names)])


SERIES_PAGE = "struct<symbol:string,list:array<struct<{field}:string,{stamp}:string>>>"


def series_pages(series: DataFrame, field: str, stamp: str) -> DataFrame:
    """Funding or open-interest pages: objects of text fields, one page per symbol and day."""
    item = F.struct(F.col(field).cast("string").alias(field), F.unix_millis("ts").cast("string").alias(stamp))
    return series.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.collect_list(item).alias("list")).select(
        F.to_json(F.struct("symbol", "list")).alias("body"))


def parse_series(pages: DataFrame, field: str, stamp: str) -> DataFrame:
    kind = SERIES_PAGE.format(field=field, stamp=stamp)
    return (
        pages.select(F.from_json("body", kind).alias("p")).select("p.symbol", F.explode("p.list").alias("x"))
        .select("symbol", F.timestamp_millis(F.col(f"x.{stamp}").cast("bigint")).alias("ts"),
                F.col(f"x.{field}").cast("double").alias(field))
    )
