"""Every fold and regime gives its rows, however few."""

from barloom.operators import ml as M
from barloom.plans import q_ml


def test_stack_and_calibration_score_every_fold(spark):
    rows = [("a", 10 * f + i, f, float(i % 2), 0.3 + 0.1 * (i % 2) + 0.01 * i, 0.5 + 0.01 * i) for f in (0, 1, 2) for i in range(8)]
    scores = spark.createDataFrame(rows, "symbol string, ts long, fold int, y double, prob double, score2 double")
    got = {r.ts: r for r in M.stack(scores, ["prob", "score2"]).collect()}
    assert sorted(got) == sorted(r[1] for r in rows)
    assert all(abs(r.stacked - (r.prob + r.score2) / 2) > 1e-9 for r in got.values())  # learned, no mean
    got = {r.ts: r for r in M.calibrate_folds(scores).collect()}
    assert sorted(got) == sorted(r[1] for r in rows) and all(r.calibrated is not None for r in got.values())
    one = scores.where("fold = 0")
    assert [r.stacked for r in M.stack(one, ["prob", "score2"]).collect()] == [None] * 8
    assert [r.calibrated for r in M.calibrate_folds(one).collect()] == [None] * 8


def test_one_class_regime_keeps_its_rows(spark):
    rows = []
    for fold in (0, 1):
        for i in range(12):
            rows.append(("a", 100 * fold + i, fold, "train" if i < 8 else "test", "bull", float(i), i % 2))
            rows.append(("b", 100 * fold + i, fold, "train" if i < 8 else "test", "bear", float(i), 1 if i < 8 else i % 2))
        rows.append(("c", 100 * fold, fold, "test", "sideways", 1.0, 0))
    folds = spark.createDataFrame(rows, "symbol string, ts long, fold int, role string, regime string, x double, label int")
    got = M.by_regime(folds, ["x"], "label", ["bear", "sideways", "bull"]).collect()
    assert sorted((r.symbol, r.ts) for r in got) == sorted((r[0], r[1]) for r in rows if r[3] == "test")
    assert {r.prob for r in got if r.regime == "bear"} == {1.0} and {r.prob for r in got if r.regime == "sideways"} == {None}


def test_horizon_scan_has_every_horizon(spark):
    got = {r.target for r in q_ml.horizon_scan(spark, "/root/testdata/sf0.001").collect()}
    assert {f"horizon_{k}" for k in (1, 2, 4, 6, 8, 12, 24, 48)} <= got
