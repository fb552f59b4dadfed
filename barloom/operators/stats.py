"""Grouped statistics, dataset reports, correlations, classification metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.rolling import c, flag
from barloom.operators import ranks


def group_stats(df: DataFrame, value: str, by, median: bool = True, year: float = 252.0) -> DataFrame:
    """Count, mean, exact median, deviation, share positive, t against zero, annualized Sharpe."""
    by = list(by)
    df = df.where(c(value).isNotNull())
    mean, std, n = F.avg(value), F.stddev_samp(value), F.count(value)
    out = df.groupBy(*by).agg(
        n.alias("n"), mean.alias("mean"), std.alias("std"), F.avg(flag(c(value) > 0)).alias("pos_share"),
        F.try_divide(mean, std / F.sqrt(n)).alias("t_stat"), F.try_divide(mean, std).alias("_s"))
    out = out.withColumn("sharpe", c("_s") * F.lit(year ** 0.5)).drop("_s")
    if not median:
        return out
    med = ranks.quantiles(df, value, {"median": 0.5}, by)
    if not by:
        return out.withColumn("median", med.scalar())
    return out.join(med, by)


def welch(df: DataFrame, value: str, event: str, by=()) -> DataFrame:
    """Event rows against all rows: difference of means, t and Welch degrees of freedom."""
    x = F.when(c(event), c(value))
    out = df.where(c(value).isNotNull()).groupBy(*by).agg(
        F.count(x).alias("n_event"), F.avg(x).alias("m1"), F.var_samp(x).alias("v1"),
        F.count(value).alias("n_all"), F.avg(value).alias("m2"), F.var_samp(value).alias("v2"))
    a, b = F.try_divide("v1", "n_event"), F.try_divide("v2", "n_all")
    return out.where("n_event > 1").select(
        *by, "n_event", "n_all", (c("m1") - c("m2")).alias("diff"), F.try_divide(c("m1") - c("m2"), F.sqrt(a + b)).alias("t_stat"),
        F.try_divide((a + b) * (a + b), a * a / (c("n_event") - 1) + b * b / (c("n_all") - 1)).alias("dof"))


def numeric_columns(df: DataFrame) -> list:
    kinds = (T.DoubleType, T.IntegerType, T.LongType, T.FloatType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


EXCLUDED_PATTERNS = ("open", "high", "low", "close", "volume", "label", "target", "future", "forward", "fwd", "tb_")
LOOKAHEAD_PATTERNS = ("future", "forward", "fwd", "next", "target", "label")
GROUP_PATTERNS = {"returns": "ret", "trend": "ma_", "volatility": "vol", "funding": "fund", "momentum": "mom", "time": "hour"}


def feature_catalog(df: DataFrame) -> DataFrame:
    """Every column with its group, whether it looks ahead, its null share, and whether it is kept: a varying number that is no price, label or look-ahead."""
    numeric = numeric_columns(df)
    rows = []
    for name in df.columns:
        ahead = any(p in name for p in LOOKAHEAD_PATTERNS)
        kept = name in numeric and name not in EXCLUDED_PATTERNS and not any(p in name for p in EXCLUDED_PATTERNS[5:])
        group = next((g for g, p in GROUP_PATTERNS.items() if p in name), "other")
        rows.append((name, group, kept and not ahead, ahead))
    names = df.sparkSession.createDataFrame(rows, "name string, feature_group string, wanted boolean, lookahead boolean")
    found = column_profile(df, numeric).select(c("feature").alias("name"), "null_share", F.coalesce(c("low") < c("high"), F.lit(False)).alias("varies"))
    return names.join(found, "name", "left").select(
        "name", "feature_group", (c("wanted") & F.coalesce("varies", F.lit(False))).alias("kept"), "lookahead", "null_share")


def feature_differences(df: DataFrame, wanted: list) -> DataFrame:
    """``missing`` and ``present`` of the wanted features, comma-joined by name; a column without any value is missing."""
    held = column_profile(df, numeric_columns(df)).where("null_share < 1").select("feature", F.lit(True).alias("_held"))
    want = df.sparkSession.createDataFrame([(x,) for x in wanted], "feature string").join(held, "feature", "left")
    named = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, c("feature")))), ",")
    return want.agg(named(c("_held").isNull()).alias("missing"), named(c("_held")).alias("present"))


def column_profile(df: DataFrame, columns: list, target: str | None = None) -> DataFrame:
    """Null share, mean, deviation and correlation with the target, all columns in one pass."""
    stats = []
    for x in columns:
        v = c(x).cast("double")
        corr = F.corr(v, c(target).cast("double")) if target else F.lit(None).cast("double")
        stats.append(F.struct(
            F.lit(x).alias("feature"), F.avg(v.isNull().cast("int")).alias("null_share"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), corr.alias("corr")))
    return df.agg(F.array(*stats).alias("_s")).select(F.explode("_s").alias("_r")).select("_r.*")


def validation_report(df: DataFrame, columns: list, label: str, min_rows: int = 1000) -> DataFrame:
    """Checks a training set must pass: rows, nulls, constant columns, label diversity."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(c(x).isNull()) for x in columns])
    constant = reduce(lambda a, b: a + b, [flag(F.min(x) == F.max(x)) for x in columns])
    out = df.agg(
        F.count(F.lit(1)).alias("n_rows"), nulls.alias("n_nulls"), constant.alias("n_constant"),
        F.count_distinct(label).alias("n_labels"), F.avg(c(label).cast("double")).alias("positive_share"))
    return out.withColumn("valid", (c("n_rows") >= min_rows) & (c("n_nulls") == 0) & (c("n_constant") == 0) & (c("n_labels") >= 2))


def clip_and_scale(df: DataFrame, columns: list, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip at exact quantiles, then standardize; bounds are one row per column."""
    cuts = ranks.quantiles(ranks.unpivoted(df, columns), "x", {"a": low, "b": high}, ["feature"])
    cut = cuts.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("a", "b"))))).scalar()  # one entry a column
    edge = lambda x, side: F.element_at(cut, F.lit(x))[side]
    df = df.withColumns({x: F.when(c(x).isNotNull(), F.greatest(edge(x, "a"), F.least(edge(x, "b"), c(x)))) for x in columns})
    moments = df.agg(F.struct(*[F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias(x) for x in columns]).alias("r")).scalar()
    return df.withColumns({x: F.try_divide(c(x) - moments[x]["m"], moments[x]["s"]) for x in columns})


def correlation_pairs(df: DataFrame, columns: list) -> DataFrame:
    """Upper triangle of the correlation matrix in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(c(a), c(b)).alias("corr")) for a, b in pairs])
    return df.agg(cells.alias("_c")).select(F.explode("_c").alias("_r")).select("_r.*")


def redundant_features(pairs: DataFrame, columns: list, limit: float = 0.85) -> list:
    """Greedy drop in column order over the small pair table."""
    strong = {(r["a"], r["b"]) for r in pairs.where(F.abs("corr") > limit).collect()}
    kept: list = []
    for x in columns:
        if not any((k, x) in strong for k in kept):
            kept.append(x)
    return [x for x in columns if x not in kept]


def classification_report(df: DataFrame, prob: str, label: str, by=(), cut: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1, specificity, Brier and AUC per group."""
    by = list(by)
    y, hit = c(label).cast("int"), flag(c(prob) >= cut)
    df = df.where(c(prob).isNotNull() & c(label).isNotNull())
    out = df.groupBy(*by).agg(
        F.sum(hit * y).alias("tp"), F.sum(hit * (1 - y)).alias("fp"), F.sum((1 - hit) * y).alias("fn"),
        F.sum((1 - hit) * (1 - y)).alias("tn"), F.avg((c(prob) - y) * (c(prob) - y)).alias("brier"))
    tp, fp, fn, tn = c("tp"), c("fp"), c("fn"), c("tn")
    out = out.withColumns({
        "accuracy": (tp + tn) / (tp + fp + fn + tn), "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn),
        "specificity": F.try_divide(tn, tn + fp), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
    })
    return out.join(ranks.auc(df, prob, label, by).select(*by, "auc"), by) if by else out


def mutual_information(df: DataFrame, features: list, target: str, bins: int = 10) -> DataFrame:
    """Mutual information of decile-binned features and a discrete target: one contingency table of all features."""
    cells = ranks.unpivoted(df.where(c(target).isNotNull()), features, [target]).where(ranks.present(c("x")))
    cuts = ranks.quantiles(cells, "x", {f"q{i}": i / bins for i in range(1, bins)}, ["feature"])
    cells = cells.join(cuts.select("feature", F.array(*[f"q{i}" for i in range(1, bins)]).alias("_e")), "feature").withColumn(
        "_b", F.size(F.filter("_e", lambda e: e < c("x")))).groupBy("feature", "_b", target).agg(F.count(F.lit(1)).alias("_n"))
    whole, by_bin, by_y = (Window.partitionBy("feature", *more) for more in ((), ("_b",), (target,)))
    n = F.sum("_n").over(whole)
    term = c("_n") / n * F.ln(c("_n") * n / (F.sum("_n").over(by_bin) * F.sum("_n").over(by_y)))
    return cells.select("feature", term.alias("_t")).groupBy("feature").agg(F.sum("_t").alias("mi"))
