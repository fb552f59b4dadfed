import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.functions.tdist import two_sided_p
from barloom.operators import ranks as K


def data(seed=3, n=900):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 3, n // 3), np.repeat([0.0, -1.5, 2.0], n // 9), rng.exponential(1e4, n // 3)])
    y = x + rng.normal(0, 2, len(x))
    return pd.DataFrame({"g": rng.choice(["a", "b"], len(x), p=[0.9, 0.1]), "x": x, "y": y, "label": (rng.random(len(x)) < 0.4).astype(int)})


def packed(n=6000):
    """Values that agree in their leading bits, ties, and every kind of value that is no ordinary number."""
    x = 0.5 + np.arange(n) * 2.0 ** -50
    return pd.DataFrame({"g": "a", "x": np.concatenate([x, x[:50], [0.0, -0.0, 5e-324, -5e-324, 1e308, np.inf, np.inf, -np.inf]])})


def test_packed_values_are_dealt_evenly(spark):
    frame = packed()
    values = spark.createDataFrame(frame).groupBy("g", "x").count().where("x between 0.4 and 0.6")
    sizes = [r["count"] for r in K._sliced(values, ["g", "x"], 500).groupBy("_slice").count().collect()]
    assert max(sizes) <= 500 and sum(sizes) == 6000 and len(sizes) >= 12
    ranked = K.value_ranks(spark.createDataFrame(frame), "x", ["g"], most=500).orderBy("x").toPandas()
    assert (ranked.below == ranked.cnt.cumsum() - ranked.cnt).all() and (ranked.n == len(frame)).all()


def test_nan_takes_no_part_and_infinite_values_do(spark):
    frame = packed(40)
    whole = spark.createDataFrame(frame).unionByName(spark.createDataFrame([("a", float("nan")), ("a", None)], "g string, x double"))
    got = K.quantiles(whole, "x", {"p10": 0.1, "p50": 0.5, "p100": 1.0}, ["g"]).first()
    x = np.sort(frame.x.values)
    assert (got.p10, got.p50) == tuple(np.percentile(x, [10, 50])) and got.p100 == np.inf
    labels = whole.withColumn("label", F.when(F.col("x") > 0.5, 1).otherwise(0)).withColumn("y", F.col("x"))
    assert K.auc(labels, "x", "label").first().auc == 1.0
    assert abs(K.spearman(labels, "x", "y").first().rho - 1) < 1e-12
    assert K.quantiles(whole.where("x is null"), "x", {"p": 0.5}).first().p is None


def test_holdout_auc_and_direction(spark):
    rng = np.random.default_rng(4)
    n = 1000
    label = (rng.random(n) < 0.5).astype(int)
    frame = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "h"), "up": label + rng.normal(0, 1, n),
                          "down": -label + rng.normal(0, 1, n), "label": label})
    tall = K.unpivoted(spark.createDataFrame(frame), ["up", "down"], ["ts", "label"])
    got = {r.feature: r for r in K.holdout_auc(tall, "x", "label", ["feature"]).collect()}
    test = frame[700:]
    for name, sign in (("up", 1), ("down", -1)):
        pos, neg = test[test.label == 1][name].values * sign, test[test.label == 0][name].values * sign
        assert got[name].direction == sign and got[name].n_test == 300
        assert abs(got[name].auc - np.mean(pos[:, None] > neg[None])) < 1e-12
    few = {r.feature: r for r in K.holdout_auc(tall.where("ts < '2024-01-10'"), "x", "label", ["feature"]).collect()}
    assert few["up"].auc is None and few["up"].direction is None


def test_quantiles_match_numpy(spark):
    frame = data()
    got = K.quantiles(spark.createDataFrame(frame), "x", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, ["g"]).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["p10", "p50", "p99"]].astype(float), np.percentile(part.x, [10, 50, 99]))


def test_auc_matches_all_pairs(spark):
    frame = data(n=180)
    got = K.auc(spark.createDataFrame(frame), "x", "label").first()
    pos, neg = frame[frame.label == 1].x, frame[frame.label == 0].x
    want = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg)])
    assert abs(got["auc"] - want) < 1e-12


def test_spearman_matches_pandas(spark):
    frame = data()
    got = K.spearman(spark.createDataFrame(frame), "x", "y", ["g"]).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        assert abs(got.loc[g, "rho"] - part.x.rank().corr(part.y.rank())) < 1e-10


def test_student_t_known_values():
    assert abs(two_sided_p(2.0, 10) - 0.07338803477074037) < 1e-10
    assert abs(two_sided_p(2.228138852, 10) - 0.05) < 1e-8
    assert abs(two_sided_p(0.0, 5) - 1.0) < 1e-12
    assert abs(two_sided_p(-1.959963985, 1e7) - 0.05) < 1e-6
