"""MLlib jobs; seeds are fixed, results are checked by rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import c, div, flag, full as full_, lag as lag_, lead as lead_
from barloom.operators import features as X
from barloom.operators import labels as L
from barloom.operators import ml as M
from barloom.operators import ranks as K
from barloom.operators import splits as V
from barloom.operators.chunks import chunked, clean
from barloom.plans.q_features import alias
from barloom.plans.registry import query, report
from barloom.plans.sqltext import P, cols, lag, sql
from barloom.session import cut_lineage
from barloom.sources import bars as B
from barloom.sources import files as S

FEATURES = ["ret_1", "mom_12h", "price_vs_ma_20", "vol_ratio_24h", "rsi_14", "atr_pct"]


def training(spark, folder):
    """Feature rows with a forward return, a label per side and a momentum regime, numbered per symbol."""
    df = chunked(B.stored_bars(spark, folder), before=26, after=8)
    df = X.atr(X.rsi(df)).withColumns({
        "ret_1": F.ln(div("close", lag_("close", 1, X.W))), "mom_12h": F.ln(div("close", lag_("close", 12, X.W))),
        "price_vs_ma_20": div("close", full_(F.avg, "close", 20, X.W)) - 1,
        "vol_ratio_24h": div("volume", full_(F.avg, "volume", 24, X.W) + 1e-10),
        "target": F.ln(div(lead_("close", 8, X.W), "close"))})
    df = clean(df).dropna(subset=[*FEATURES, "target"])
    df = df.withColumns({"label": flag(c("target") > 0), "short_label": flag(c("target") < 0),
                         "regime": F.when(c("mom_12h") > 0.3, "bull").when(c("mom_12h") < -0.3, "bear").otherwise("sideways")})
    return cut_lineage(V.numbered(cut_lineage(df.select("symbol", "ts", *FEATURES, "target", "label", "short_label", "regime"))))


def folds(spark, folder):
    """All seven folds of a tenth of each series."""
    return cut_lineage(V.purged_walk_forward(training(spark, folder), n_splits=7, test_pct=0.1, purge=12, min_train=100))


@query("walk_forward_gbt")
def walk_forward_gbt(spark, folder):
    """Regression ensemble with decayed sample weights, out of sample."""
    df = V.decay_weights(folds(spark, folder)).withColumnRenamed("weight", "w")
    return report(M.walk_forward_regression(df, FEATURES, "target", "w", 3))


@query("walk_forward_classifier")
def walk_forward_classifier(spark, folder):
    """Long and short classifiers, out of sample, with AUC per fold and side."""
    df = folds(spark, folder)
    scores = cut_lineage(M.walk_forward_classification(df, FEATURES, "label", 3, "long").unionByName(
        M.walk_forward_classification(df, FEATURES, "short_label", 3, "short")))
    return report(K.auc(scores, "prob", "y", ["side", "fold"]))


@query("stable_features")
def stable_features(spark, folder):
    return report(M.stable_features(folds(spark, folder), FEATURES, "label"))


@query("calibration")
def calibration(spark, folder):
    scores = cut_lineage(M.walk_forward_classification(folds(spark, folder), FEATURES, "label", 3))
    out = M.calibrate_folds(scores)
    return report(out.select("symbol", "ts", "prob", "calibrated", "tier"))


@query("stacking")
def stacking(spark, folder):
    """Classifier score and price momentum combined by a meta-learner."""
    df = folds(spark, folder)
    scores = M.walk_forward_classification(df, FEATURES, "label", 3)
    second = df.where("role = 'test'").select("symbol", "ts", "fold", (1 / (1 + F.exp(-c("mom_12h")))).alias("score2"))
    both = cut_lineage(scores.join(second, ["symbol", "ts", "fold"]))
    return report(M.stack(both, ["prob", "score2"]).select("symbol", "ts", "fold", "y", "prob", "score2", "stacked"))


@query("gmm_regimes")
def gmm_regimes(spark, folder):
    df = cut_lineage(X.features(B.stored_bars(spark, folder), X.regime_pack).dropna(subset=["ret_24h", "vol_24h", "ma_diff", "rsi"]))
    named = M.market_regimes(df.select("symbol", "ts", "ret_24h", "vol_24h", "ma_diff", "rsi"), ["ret_24h", "vol_24h", "ma_diff", "rsi"], "ret_24h")
    steady = M.persistent_regime(cut_lineage(named))
    return report(steady.select("symbol", "ts", "regime_id", "regime", "steady_regime"))


REG = [("m_", alias({"m": f"close / {lag('close', 12)} - 1"})), ("g_", "SELECT *, CASE WHEN m > 0.3 THEN 'bull' WHEN m < -0.3 THEN 'bear' ELSE 'sideways' END AS regime FROM m_"),
       ("h_", f"SELECT *, lag(regime, 1) OVER ({P}) AS a, lag(regime, 2) OVER ({P}) AS b FROM g_")]


@query("regime_persistence", sql("bars", *REG, ("out_", "SELECT symbol, ts, regime, CASE WHEN a = b THEN a ELSE regime END AS steady_regime FROM h_"), out=cols("out_", keys="symbol regime steady_regime")))
def regime_persistence(spark, folder):
    df = clean(chunked(B.stored_bars(spark, folder), before=12).withColumn("m", div("close", lag_("close", 12, X.W)) - 1))
    df = df.withColumn("regime", F.when(c("m") > 0.3, "bull").when(c("m") < -0.3, "bear").otherwise("sideways"))
    return report(M.persistent_regime(cut_lineage(df)), "symbol", "regime", "steady_regime", "ts")


@query("regime_models")
def regime_models(spark, folder):
    out = cut_lineage(M.by_regime(folds(spark, folder), FEATURES, "label", ["bear", "sideways", "bull"]))
    # rows without a score have no rank, but count
    rows = out.groupBy("regime").agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"))
    area = K.auc(out.where("prob is not null"), "prob", "y", ["regime"]).select("regime", "auc")
    return report(rows.join(area, "regime", "left").select("regime", "auc", "n", "n_pos"))


@query("parameter_search")
def parameter_search(spark, folder):
    return report(M.search(folds(spark, folder), FEATURES, "target"))


@query("batch_scoring")
def batch_scoring(spark, folder):
    """Saved model on the newest rows, with exact score thresholds."""
    df = training(spark, folder)
    scored = cut_lineage(M.save_and_score(df.where("rn < n * 0.8"), df.where("rn >= n * 0.8"), FEATURES, "target", S.fresh_path(spark, "model")))
    cuts = K.quantiles(scored, "prediction", {"top_10": 0.9}, ["symbol"])
    return report(scored.join(cuts, "symbol").select("symbol", "ts", "prediction", "top_10", flag(c("prediction") >= c("top_10")).alias("enter")))


@query("adversarial_weights")
def adversarial_weights(spark, folder):
    return report(M.adversarial_weights(training(spark, folder), FEATURES))


@query("minority_oversampling")
def minority_oversampling(spark, folder):
    df = M.oversample_minority(training(spark, folder).select("symbol", "ts", *FEATURES, "label"), FEATURES)
    return report(df.groupBy("symbol", "label", "synthetic").agg(F.count(F.lit(1)).alias("n"), F.avg("rsi_14").alias("avg_rsi")))


BLEND = ("b_", alias({"p1": f"close / {lag('close', 12)} - 1", "p2": f"close / {lag('close', 24)} - 1"}))


@query("ensemble_blend", sql("bars", BLEND, ("out_", "SELECT symbol, ts, (coalesce(0.6::DOUBLE * p1, 0) + coalesce(0.4::DOUBLE * p2, 0)) / nullif(CASE WHEN p1 IS NOT NULL THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN p2 IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END, 0) AS pred FROM b_"), out=cols("out_", nums="pred")))
def ensemble_blend(spark, folder):
    df = chunked(B.stored_bars(spark, folder), before=24)
    df = clean(df.withColumns({"p1": div("close", lag_("close", 12, X.W)) - 1, "p2": div("close", lag_("close", 24, X.W)) - 1}))
    return report(df.select("symbol", "ts", M.blend([(c("p1"), F.lit(0.6)), (c("p2"), F.lit(0.4))]).alias("pred")))


HORIZONS = (1, 2, 4, 6, 8, 12, 24, 48)


@query("horizon_scan")
def horizon_scan(spark, folder):
    """Which horizon and barrier are predictable at all: rank AUC of momentum against each target."""
    bars = B.stored_bars(spark, folder)
    base = cut_lineage(X.features(L.forward_returns(bars, HORIZONS), X.momentum).select("symbol", "ts", "mom_12h", *[f"fwd_{k}" for k in HORIZONS]))
    grid = F.array(*[F.struct(F.lit(f"horizon_{k}").alias("target"), flag(c(f"fwd_{k}") > 0).alias("label"), c(f"fwd_{k}").isNotNull().alias("_ok")) for k in HORIZONS])
    rows = base.select("mom_12h", F.explode(grid).alias("_g")).select("mom_12h", "_g.*").where("_ok")
    for tp, sl in ((2.0, 1.0), (3.0, 1.5)):
        tb = L.triple_barrier(bars, tp=tp, sl=sl).where("tb_binary is not null").select("symbol", "ts", c("tb_binary").alias("label"))
        rows = rows.unionByName(tb.join(base, ["symbol", "ts"]).select("mom_12h", F.lit(f"barrier_{tp}_{sl}").alias("target"), "label"), allowMissingColumns=True)
    return report(K.auc(cut_lineage(rows.where("mom_12h is not null").drop("_ok")), "mom_12h", "label", ["target"]))


@query("regime_predictability", sql("bars", ("f_", alias({"mom": f"ln(close / {lag('close', 12)})", "fwd": f"lead(close, 8) OVER ({P}) / close - 1", "v": f"abs(close / {lag('close')} - 1)"})),
    ("q_", "SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM f_ WHERE fwd IS NOT NULL AND mom IS NOT NULL"), ("g_", "SELECT mom, (fwd > 0)::INT AS label, CASE WHEN v <= a THEN 'quiet' WHEN v >= b THEN 'wild' ELSE 'middle' END AS band FROM f_, q_ WHERE fwd IS NOT NULL AND mom IS NOT NULL"),
    ("out_", "SELECT band, count(*) AS n, (sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auc FROM (SELECT *, rank() OVER (PARTITION BY band ORDER BY mom) + (count(*) OVER (PARTITION BY band, mom) - 1) / 2 AS rk FROM g_) GROUP BY 1"),
    out=cols("out_", keys="band", ts="", ints="n", nums="auc")))
def regime_predictability(spark, folder):
    df = chunked(B.stored_bars(spark, folder), before=12, after=8)
    df = clean(df.withColumns({"mom": F.ln(div("close", lag_("close", 12, X.W))), "fwd": div(lead_("close", 8, X.W), "close") - 1, "v": F.abs(div("close", lag_("close", 1, X.W)) - 1)}))
    df = cut_lineage(df.where("fwd is not null and mom is not null"))
    cut = K.quantiles(df, "v", {"a": .25, "b": .75}).select(F.struct("a", "b")).scalar()
    df = df.withColumns({"label": flag(c("fwd") > 0), "_cut": cut})
    df = df.withColumn("band", F.when(c("v") <= c("_cut.a"), "quiet").when(c("v") >= c("_cut.b"), "wild").otherwise("middle"))
    return report(K.auc(df, "mom", "label", ["band"]), "band", "n", "auc")
