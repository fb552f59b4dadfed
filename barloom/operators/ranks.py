"""Exact order statistics without a global sort or a group in one task.

Rows are first combined per distinct value, so a value shared by a third of all rows is one row after the map side.
Distinct values are then dealt to ranges whose ends come from counts (Spark samples every partition), whatever the
distribution of the values; ranges are made finer until none holds more than ``SLICE`` values. Only the counts of the
ranges are scanned as a whole.

NULL and NaN take no part; infinite values are values like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut_lineage

START = Window.unboundedPreceding
#: Distinct values of one range at most.
SLICE = 1_000_000


def present(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def unpivoted(df: DataFrame, columns, keep=(), name: str = "feature", value: str = "x") -> DataFrame:
    """One row a column: ``keep``, the column's name and its value, so that many columns are ranked in one pass."""
    cells = F.array(*[F.struct(F.lit(k).alias(name), F.col(k).cast("double").alias(value)) for k in columns])
    return df.select(*keep, F.inline(cells))


def _sliced(values: DataFrame, order: list, most: int) -> DataFrame:
    """The written values with ``_slice``, the number of their range, and no range of more than ``most`` values."""
    out = cut_lineage(values.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))
    while True:
        largest, n = out.groupBy("_slice").count().agg(F.max("count"), F.sum("count")).first()
        if (largest or 0) <= most:
            return out
        parts = 2 * max(-(-n // most), out.agg(F.max("_slice")).first()[0] + 1)
        out = cut_lineage(out.drop("_slice").repartitionByRange(parts, *order).withColumn("_slice", F.spark_partition_id()))


def value_ranks(df: DataFrame, value: str, by=(), extra: dict | None = None, most: int = SLICE) -> DataFrame:
    """One row per (by, value): ``cnt`` rows, ``below`` rows with a smaller value, ``n`` rows in all."""
    by = list(by)
    sums = [agg.alias(name) for name, agg in (extra or {}).items()]
    values = df.where(present(F.col(value))).groupBy(*by, value).agg(F.count(F.lit(1)).alias("cnt"), *sums)
    values = _sliced(values, [*by, value], most)
    series = Window.partitionBy(*by)
    slices = values.groupBy(*by, "_slice").agg(F.sum("cnt").alias("_size")).select(
        *by, "_slice",
        F.coalesce(F.sum("_size").over(series.orderBy("_slice").rowsBetween(START, -1)), F.lit(0)).alias("_before"),
        F.sum("_size").over(series).alias("n"),
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(START, -1)
    return (
        values.join(slices, [*by, "_slice"])
        .withColumn("below", F.col("_before") + F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
        .drop("_before", "_slice")
    )


def average_rank() -> Column:
    return F.col("below") + (F.col("cnt") + 1) / F.lit(2.0)


def quantiles(df: DataFrame, value: str, probs: dict, by=()) -> DataFrame:
    """Exact linear-interpolated quantiles per group: ``probs`` maps output name to probability."""
    ranked = value_ranks(df, value, by)
    out = []
    for name, p in probs.items():
        place = (F.col("n") - 1) * F.lit(float(p))
        holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("cnt"))
        low = F.max(F.when(holds(F.floor(place)), F.col(value)))
        high = F.max(F.when(holds(F.ceil(place)), F.col(value)))
        part = F.max(place - F.floor(place))
        out.append(F.when(high == low, low).otherwise(low + (high - low) * part).alias(name))
    return ranked.groupBy(*by).agg(*out)


def auc(df: DataFrame, score: str, label: str, by=()) -> DataFrame:
    """Rank-sum area under the ROC curve, average ranks on ties."""
    df = df.where(F.col(label).isNotNull())
    ranked = value_ranks(df, score, by, {"pos": F.sum(F.col(label).cast("double"))})
    pos = F.sum("pos")
    neg = F.sum(F.col("cnt") - F.col("pos"))
    area = F.try_divide(F.sum(F.col("pos") * average_rank()) - pos * (pos + 1) / 2, pos * neg)
    return ranked.groupBy(*by).agg(area.alias("auc"), F.sum("cnt").alias("n"), pos.alias("n_pos"))


def holdout_auc(df: DataFrame, score: str, label: str, by=(), ts: str = "ts", train: float = 0.7, least: tuple = (500, 50, 10)) -> DataFrame:
    """AUC over the last part of every group in time, and the direction (1, or -1 if the score ranks the other way round).

    Only rows with both values count; the test part begins after the first ``int(train * n)`` of them. Without ``least`` rows, rows of
    each class, and rows of each class in the test part, the result is NULL. ``ts`` is unique in a group.
    """
    by = list(by)
    df = df.where(present(F.col(score)) & F.col(label).isNotNull()).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    places = value_ranks(df, "_at", by).select(*by, "_at", "below", F.col("n").alias("_all"))
    y = F.col(label).cast("double")
    whole = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("_pos"))
    test = df.join(places, [*by, "_at"]).where(F.col("below") >= F.floor(F.col("_all") * train))
    out = whole.join(auc(test, score, label, by).select(*by, F.col("auc").alias("_auc"), F.col("n").alias("n_test"), F.col("n_pos").alias("_p")), by)
    enough = lambda pos, n, k: (pos >= k) & (n - pos >= k)
    ok = (F.col("n") >= least[0]) & enough(F.col("_pos"), F.col("n"), least[1]) & enough(F.col("_p"), F.col("n_test"), least[2])
    return out.select(*by, "n", "n_test", F.when(ok, F.greatest("_auc", 1 - F.col("_auc"))).alias("auc"),
                      F.when(ok, F.when(F.col("_auc") < 0.5, -1).otherwise(1)).alias("direction"))


def spearman(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Correlation of average ranks per group."""
    by = list(by)
    df = df.where(present(F.col(x)) & present(F.col(y))).select(*by, x, y)
    pairs = df.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_w"))
    rx = value_ranks(df, x, by).select(*by, x, average_rank().alias("_rx"))
    ry = value_ranks(df, y, by).select(*by, y, average_rank().alias("_ry"))
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    n, sa, sb = F.sum(w), F.sum(w * a), F.sum(w * b)
    cov = F.sum(w * a * b) - sa * sb / n
    var = F.sqrt((F.sum(w * a * a) - sa * sa / n) * (F.sum(w * b * b) - sb * sb / n))
    return pairs.join(rx, [*by, x]).join(ry, [*by, y]).groupBy(*by).agg(
        F.try_divide(cov, var).alias("rho"), n.alias("n"))
