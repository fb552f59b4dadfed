"""Time-ordered train/test splits and sample weights, per series.

Folds are arithmetic on the row number and the series length, so no index lists are built.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.align import clean_numbered
from barloom.operators.chunks import HOURLY, Span


def numbered(df: DataFrame, span: Span = HOURLY) -> DataFrame:
    """Row number ``rn`` and series length ``n``."""
    out = clean_numbered(df, span)
    sizes = out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return out.join(sizes, "symbol")


def chronological(df: DataFrame, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """Column ``split`` on a numbered frame."""
    rn, n = F.col("rn"), F.col("n")
    return df.withColumn(
        "split",
        F.when(rn < F.floor(n * train), "train").when(rn < F.floor(n * (train + valid)), "valid").otherwise("test"))


def _folds(df: DataFrame, parts: list) -> DataFrame:
    """``parts``: (fold, role, usable, low, high); a row appears once per fold it belongs to."""
    rn = F.col("rn")
    hits = [
        F.when(ok & (rn >= low) & (rn < high), F.struct(F.lit(fold).alias("fold"), F.lit(role).alias("role")))
        for fold, role, ok, low, high in parts
    ]
    return df.withColumn("_hit", F.explode(F.array_compact(F.array(*hits)))).select("*", "_hit.*").drop("_hit")


def purged_walk_forward(df: DataFrame, n_splits: int = 7, test_pct: float = 0.10, purge: int = 12,
                        min_train: int = 100) -> DataFrame:
    """Expanding train window, a purge gap, then the test window; too short folds are left out."""
    n, zero = F.col("n"), F.lit(0)
    size = F.floor(n * test_pct)
    parts = []
    for i in range(n_splits):
        start = n - (n_splits - i) * size
        end = F.least(start + size, n)
        usable = (start >= size) & (start - purge >= min_train)
        parts += [(i, "train", usable, zero, start - purge), (i, "test", usable, start, end)]
    return _folds(df, parts)


def gap_splits(df: DataFrame, n_splits: int = 5, test_size: float = 0.2, gap: int = 24) -> DataFrame:
    """Overlapping test windows stepping back from the end, with a gap before each."""
    n, zero = F.col("n"), F.lit(0)
    size = F.floor(n * test_size)
    parts = []
    for i in range(n_splits):
        start = n - size - i * F.floor(size / n_splits)
        usable = (start >= size) & (start - gap > 0)
        parts += [(i, "train", usable, zero, start - gap), (i, "test", usable, start, start + size)]
    return _folds(df, parts)


def three_way_splits(df: DataFrame, n_splits: int = 5) -> DataFrame:
    """Expanding train, then half a step of validation and half a step of test."""
    n, zero = F.col("n"), F.lit(0)
    step = F.floor(n / (n_splits + 1))
    half = F.floor(step / 2)
    parts = []
    for i in range(n_splits):
        train_end = (i + 1) * step
        valid_end = F.least(train_end + half, n)
        test_end = F.least(valid_end + half, n)
        yes = F.lit(True)
        parts += [(i, "train", yes, zero, train_end), (i, "valid", yes, train_end, valid_end),
                  (i, "test", yes, valid_end, test_end)]
    return _folds(df, parts)


def calendar_split(daily: DataFrame, months: int = 84) -> DataFrame:
    """First ``months`` of each series train, the rest test."""
    starts = daily.groupBy("symbol").agg(F.min("ts").alias("_first"))
    edge = F.add_months(F.col("_first").cast("date"), months)
    return daily.join(starts, "symbol").withColumn(
        "split", F.when(F.col("ts").cast("date") < edge, "train").otherwise("test")).drop("_first")


def decay_weights(df: DataFrame, half_life: float = 8000.0) -> DataFrame:
    """Newer rows weigh more; the mean weight is 1 (closed form of the geometric sum)."""
    rate = math.log(2) / half_life
    n = F.col("n")
    mean = (1 - F.exp(-rate * n)) / (F.lit(1 - math.exp(-rate)) * n)
    return df.withColumn("weight", F.exp(F.lit(-rate) * (n - 1 - F.col("rn"))) / mean)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Positives weigh n_neg / n_pos, negatives 1."""
    sizes = df.groupBy("symbol").agg(F.sum(F.col(label)).alias("_pos"), F.count(label).alias("_all"))
    ratio = F.try_divide(F.col("_all") - F.col("_pos"), F.col("_pos"))
    return df.join(sizes, "symbol").withColumn(
        "class_weight", F.when(F.col(label) == 1, ratio).otherwise(1.0)).drop("_pos", "_all")


def stratified_split(df: DataFrame, label: str = "label", test_pct: int = 20, seed: int = 42, digits: int = 4) -> DataFrame:
    """Exactly the rounded share of every label is ``test``: the rows of the label with the least hashes.

    Counts by the first ``digits`` hex digits of the hash tell in which slice a label is cut; only the rows of that slice are ranked,
    so no label is sorted as a whole and the rows themselves are not shuffled. A null label is a label of its own. ``symbol`` and ``ts``
    name a row. ``df`` is read three times: give a written table.
    """
    kind = F.coalesce(F.col(label).cast("string"), F.lit("-"))
    named = df.withColumn("_kind", kind).withColumn("_h", F.md5(F.concat_ws(
        "|", "symbol", F.unix_micros("ts").cast("string"), "_kind", F.lit(str(seed))).cast("binary")))
    slim = named.select("_kind", "_h", F.substring("_h", 1, digits).alias("_slice"))
    of_kind = Window.partitionBy("_kind")
    ends = slim.groupBy("_kind", "_slice").agg(F.count(F.lit(1)).alias("_n")).withColumns({
        "_end": F.sum("_n").over(of_kind.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)),
        "_want": F.floor((F.sum("_n").over(of_kind) * test_pct + 50) / 100)})
    cut = ends.where("_want > _end - _n and _want <= _end").select("_kind", "_slice", (F.col("_want") - F.col("_end") + F.col("_n")).alias("_need"))
    ranked = slim.join(cut, ["_kind", "_slice"]).withColumn("_r", F.row_number().over(Window.partitionBy("_kind").orderBy("_h")))
    last = ranked.where("_r = _need").select("_kind", F.col("_h").alias("_last"))
    return named.join(last, "_kind", "left").withColumn(
        "split", F.when(F.col("_h") <= F.col("_last"), "test").otherwise("train")).drop("_kind", "_h", "_last")
