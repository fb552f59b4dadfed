"""Walk-forward training, scoring and combination with Spark MLlib.

The loops below run over folds, models and regimes, a handful of fits; rows stay in Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import c, flag
from barloom.operators.chunks import HOURLY, SharedWindow, Span, chunked, clean
from barloom.session import cut_lineage

W = SharedWindow()
TREES = dict(maxDepth=3, maxBins=32, seed=7)


def assembled(df: DataFrame, features: list) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def union_all(frames: list) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def folds_of(df: DataFrame) -> list:
    """Fold numbers present (a handful)."""
    return sorted(r["fold"] for r in df.where("role = 'test'").select("fold").distinct().collect())


def blend(pairs: list) -> F.Column:
    """Weighted mean of the predictions that are present."""
    num = reduce(lambda a, b: a + b, [F.coalesce(p * w, F.lit(0.0)) for p, w in pairs])
    den = reduce(lambda a, b: a + b, [F.when(p.isNotNull(), w).otherwise(0.0) for p, w in pairs])
    return F.try_divide(num, den)


def regressors(iterations: int = 5) -> dict:
    return {
        "gbt": GBTRegressor(labelCol="y", weightCol="weight", maxIter=iterations, predictionCol="gbt", **TREES),
        "forest": RandomForestRegressor(labelCol="y", weightCol="weight", numTrees=8, predictionCol="forest", **TREES),
        "huber": LinearRegression(labelCol="y", weightCol="weight", loss="huber", maxIter=20, predictionCol="huber"),
    }


def walk_forward_regression(folds: DataFrame, features: list, target: str, weight: str | None = None, iterations: int = 5,
                            names=("gbt", "forest", "huber")) -> DataFrame:
    """Out-of-sample predictions per test fold.

    Models see the older 85% of the train window; inverse errors on the rest weigh the ensemble.
    ``folds`` has ``fold``, ``role``, ``rn`` and ``n`` columns.
    """
    df = folds.withColumns({"y": c(target), "weight": c(weight) if weight else F.lit(1.0)}).where("y is not null")
    df = cut_lineage(assembled(df, features))
    out = []
    for fold in folds_of(df):
        part = df.where(c("fold") == fold)
        edge = part.where("role = 'train'").groupBy("symbol").agg((F.max("rn") * 0.85).alias("_edge"))
        train = part.where("role = 'train'").join(edge, "symbol")
        models = {n: m.fit(train.where("rn <= _edge")) for n, m in regressors(iterations).items() if n in names}
        score = lambda frame: reduce(lambda a, m: m.transform(a), models.values(), frame)
        errors = score(train.where("rn > _edge")).agg(*[F.sqrt(F.avg((c("y") - c(n)) ** 2)).alias(n) for n in models]).first()
        pairs = [(c(n), F.lit(1.0 / max(errors[n], 1e-12))) for n in models]
        scored = score(part.where("role = 'test'"))
        out.append(scored.select("symbol", "ts", "fold", "y", *models, blend(pairs).alias("pred")))
    return union_all(out)


def walk_forward_classification(folds: DataFrame, features: list, label: str, iterations: int = 5, side: str = "long") -> DataFrame:
    """Out-of-sample probability of the label per test fold."""
    df = cut_lineage(assembled(folds.withColumn("y", c(label).cast("double")).where("y is not null"), features))
    model = GBTClassifier(labelCol="y", maxIter=iterations, **TREES)
    out = []
    for fold in folds_of(df):
        part = df.where(c("fold") == fold)
        scored = model.fit(part.where("role = 'train'")).transform(part.where("role = 'test'"))
        out.append(scored.select("symbol", "ts", "fold", "y", F.lit(side).alias("side"), vector_to_array("probability")[1].alias("prob")))
    return union_all(out)


def stable_features(folds: DataFrame, features: list, label: str, iterations: int = 3) -> DataFrame:
    """Mean importance rank over folds plus 0.3 of its deviation: small is stable and useful."""
    df = cut_lineage(assembled(folds.withColumn("y", c(label).cast("double")).where("y is not null and role = 'train'"), features))
    rows = []
    for fold in sorted(r["fold"] for r in df.select("fold").distinct().collect()):
        model = GBTClassifier(labelCol="y", maxIter=iterations, **TREES).fit(df.where(c("fold") == fold))
        rows += [(fold, x, float(v)) for x, v in zip(features, model.featureImportances.toArray())]
    table = df.sparkSession.createDataFrame(rows, "fold int, feature string, importance double")
    ranked = table.withColumn("rank", F.rank().over(Window.partitionBy("fold").orderBy(F.desc("importance"))))
    return ranked.groupBy("feature").agg(
        F.avg("rank").alias("mean_rank"), F.coalesce(F.stddev_pop("rank"), F.lit(0.0)).alias("std_rank")
    ).withColumn("score", c("mean_rank") + 0.3 * c("std_rank"))


def calibrate(train: DataFrame, test: DataFrame, prob: str = "prob", label: str = "y") -> DataFrame:
    """Isotonic calibration and confidence tiers by distance from one half."""
    model = IsotonicRegression(featuresCol=prob, labelCol=label, predictionCol="calibrated").fit(train)
    return model.transform(test).withColumn("tier", confidence_tier(c("calibrated")))


def others(scores: DataFrame) -> list:
    """(rows of the other folds, rows of the fold) of every fold."""
    folds = sorted(r["fold"] for r in scores.select("fold").distinct().collect())
    return [(scores.where(c("fold") != k), scores.where(c("fold") == k)) for k in folds]


def calibrate_folds(scores: DataFrame, prob: str = "prob", label: str = "y") -> DataFrame:
    """Every row calibrated by the other folds; null where there is no other fold."""
    none = lambda df: df.withColumns({"calibrated": F.lit(None).cast("double"), "tier": F.lit(None).cast("string")})
    return union_all([none(test) if train.isEmpty() else calibrate(train, test, prob, label) for train, test in others(scores)])


def confidence_tier(p) -> F.Column:
    return F.when(F.abs(p - 0.5) > 0.2, "high").when(F.abs(p - 0.5) > 0.1, "medium").otherwise("low")


def stack(scores: DataFrame, columns: list, label: str = "y") -> DataFrame:
    """Meta-learner on out-of-sample scores; every row is scored by the learner of the other folds.

    Where those hold one class alone it is their base rate, where there are none it is null.
    """
    df = scores.dropna(subset=columns)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), LogisticRegression(labelCol=label, maxIter=20, regParam=0.01)])
    out = []
    for train, test in others(df):
        classes, rate = train.agg(F.count_distinct(label), F.avg(label)).first()
        if classes < 2:
            out.append(test.withColumn("stacked", F.lit(rate).cast("double")))
        else:
            out.append(pipe.fit(train).transform(test).withColumn("stacked", vector_to_array("probability")[1]).select(*df.columns, "stacked"))
    return union_all(out)


def market_regimes(df: DataFrame, features: list, order_by: str, k: int = 3, names=("bear", "sideways", "bull")) -> DataFrame:
    """Gaussian mixture states named by their mean return, worst to best."""
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
        GaussianMixture(featuresCol="_x", k=k, seed=7, maxIter=25, predictionCol="state")])
    scored = cut_lineage(pipe.fit(df).transform(df).select(*df.columns, "state"))
    means = scored.groupBy("state").agg(F.avg(order_by).alias("_m"))
    ranks = means.withColumn("regime_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_m", "state")) - 1)
    label = F.element_at(F.array(*[F.lit(x) for x in names]), c("regime_id") + 1)
    return scored.join(ranks.select("state", "regime_id", label.alias("regime")), "state").drop("state")


def persistent_regime(df: DataFrame, regime: str = "regime", n: int = 3, span: Span = HOURLY) -> DataFrame:
    """Majority of the last ``n`` regimes; without a majority the newest one."""
    df = chunked(df, before=n, span=span)
    seen = F.collect_list(regime).over(W.rowsBetween(-(n - 1), 0))
    df = df.withColumn("_seen", seen)
    major = F.filter("_seen", lambda r: F.size(F.filter("_seen", lambda x: x == r)) * 2 > n)
    return clean(df.withColumn("steady_regime", F.when(F.size(major) > 0, F.element_at(major, 1)).otherwise(c(regime))))


def by_regime(folds: DataFrame, features: list, label: str, regimes: list, iterations: int = 3) -> DataFrame:
    """One model per regime and fold; rows are scored by the model of their own regime.

    Where the training rows of a regime hold one class alone, its test rows get their base rate, without training rows null.
    """
    parts = []
    for name in regimes:
        part = folds.where(c("regime") == name)
        seen = part.where("role = 'train'").groupBy("fold").agg(F.count_distinct(label).alias("classes"), F.avg(c(label).cast("double")).alias("rate"))
        rates = {r["fold"]: (r["classes"], r["rate"]) for r in seen.collect()}
        tested = folds_of(part.where(c(label).isNotNull()))
        learned = [k for k in tested if rates.get(k, (0, None))[0] > 1]
        scored = [walk_forward_classification(part.where(c("fold").isin(learned)), features, label, iterations)] if learned else []
        for k in tested:
            if k not in learned:
                test = assembled(part.where((c("fold") == k) & (c("role") == "test") & c(label).isNotNull()), features)
                rate = F.lit(rates.get(k, (0, None))[1]).cast("double")
                scored.append(test.select("symbol", "ts", "fold", c(label).cast("double").alias("y"), F.lit("long").alias("side"), rate.alias("prob")))
        parts += [x.withColumn("regime", F.lit(name)) for x in scored]
    return union_all(parts)


def search(folds: DataFrame, features: list, target: str, depths=(2, 3), rates=(0.05, 0.1), iterations: int = 3) -> DataFrame:
    """Grid search over walk-forward folds: mean test error per setting."""
    df = cut_lineage(assembled(folds.withColumn("y", c(target)).where("y is not null"), features))
    rows = []
    for depth in depths:
        for rate in rates:
            model = GBTRegressor(labelCol="y", maxIter=iterations, maxDepth=depth, stepSize=rate, seed=7)
            errors = []
            for fold in folds_of(df):
                part = df.where(c("fold") == fold)
                scored = model.fit(part.where("role = 'train'")).transform(part.where("role = 'test'"))
                errors.append(scored.agg(F.sqrt(F.avg((c("y") - c("prediction")) ** 2))).first()[0])
            rows.append((depth, rate, float(sum(errors) / len(errors))))
    return df.sparkSession.createDataFrame(rows, "max_depth int, step_size double, rmse double")


def save_and_score(train: DataFrame, new: DataFrame, features: list, target: str, path: str) -> DataFrame:
    """Fit, save, load and score a pipeline, as a batch scoring job does."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), GBTRegressor(labelCol=target, maxIter=5, **TREES)])
    pipe.fit(train.where(c(target).isNotNull())).write().save(path)
    return PipelineModel.load(path).transform(new).drop("features")


def adversarial_weights(df: DataFrame, features: list, recent: float = 0.2, folds: int = 2) -> DataFrame:
    """Weights that make old rows look like recent ones: odds of 'recent' from held-out classifiers.

    ``df`` has ``rn`` and ``n``; the fold of a row is a hash of its key.
    """
    base = df.withColumns({
        "y": flag(c("rn") >= c("n") * (1 - recent)).cast("double"),
        "fold": F.pmod(F.xxhash64("symbol", "ts"), F.lit(folds)),
    })
    base = cut_lineage(assembled(base, features))
    parts = []
    for k in range(folds):
        model = GBTClassifier(labelCol="y", maxIter=3, **TREES).fit(base.where(c("fold") != k))
        parts.append(model.transform(base.where(c("fold") == k)).select("symbol", "ts", vector_to_array("probability")[1].alias("_p")))
    p = F.greatest(F.lit(0.05), F.least(F.lit(0.95), c("_p")))
    scored = cut_lineage(union_all(parts).withColumn("raw", p / (1 - p)))
    mean = scored.agg(F.avg("raw")).scalar()
    return scored.select("symbol", "ts", (c("raw") / mean).alias("weight"))


def oversample_minority(df: DataFrame, features: list, label: str = "label", span: Span = HOURLY) -> DataFrame:
    """One synthetic row between each positive and the next positive of its series.

    The partner is the neighbour in time within the minority, found by a window, never by all pairs.
    """
    minor = chunked(df.where(c(label) == 1), after=1, span=span)
    part = F.pmod(F.xxhash64("symbol", "ts"), F.lit(1000)) / 1000.0
    mixed = {x: c(x) + part * (F.lead(x).over(W()) - c(x)) for x in features}
    made = clean(minor.withColumns({f"_n_{x}": e for x, e in mixed.items()}).withColumns({x: c(f"_n_{x}") for x in features}))
    made = made.dropna(subset=features).withColumn("synthetic", F.lit(True))
    return df.withColumn("synthetic", F.lit(False)).unionByName(made)
