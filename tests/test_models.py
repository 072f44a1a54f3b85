import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peptaflow.ml import grid
from peptaflow.ml import isotonic_logistic as il
from peptaflow.operators import statistics


def simulate(spark, seed, n=256):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * z))).astype(int)
    rows = [(i, float(z[i]), float(-z[i]), float(z[i] + rng.normal()), 1.0, float(rng.normal()), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, rising double, falling double, noisy double, constant double, noise double, label int")


FEATURES = ["rising", "falling", "noisy", "constant", "noise"]


@pytest.fixture(scope="module")
def fitted(spark):
    df = simulate(spark, 0)
    return df, il.IsotonicLogistic(FEATURES, drop_weak=False).fit(df)


def test_probabilities_and_trends(fitted):
    df, m = fitted
    out = m.predict(df)
    p = np.array([r[0] for r in out.select("PredictedProbability").collect()])
    assert ((p >= 0) & (p <= 1)).all()
    assert statistics.auroc(out, F.col("PredictedProbability"), F.col("label")).first()["auroc"] > 0.8
    imp = m.importances()
    assert imp["rising"]["trend"] == 1 and imp["falling"]["trend"] == -1 and imp["noisy"]["trend"] == 1
    assert imp["rising"]["f2l"] > imp["noisy"]["f2l"] > imp["constant"]["f2l"]
    assert imp["rising"]["p"] < 1e-6 < imp["noise"]["p"] and abs(imp["constant"]["effect"]) < 1e-12


def test_curves_are_monotone_and_near_the_truth(fitted):
    _, m = fitted
    x, y = m.curves["rising"].knots
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all()
    mid = np.interp([-1.0, 1.0], x, y) + m.curves["rising"].offset
    assert abs(mid[0] + 2) < 1.2 and abs(mid[1] - 2) < 1.2
    assert (np.diff(m.curves["falling"].knots[1]) <= 0).all()


def test_inverse(fitted, spark):
    _, m = fitted
    for f in ("rising", "falling"):
        x, y = m.curves[f].knots
        strict = np.flatnonzero(np.diff(y) != 0)
        inner = [float((x[i] + x[i + 1]) / 2) for i in strict[2:-2]]
        df = spark.createDataFrame([(v,) for v in inner], "x double").withColumn("t", il.interpolate(F.col("x"), m.curves[f].knots))
        back = m.inverse_transform(df, {f: "t"}).collect()
        assert back and max(abs(r["x"] - r[f"_x_{f}"]) for r in back) < 1e-6


def test_saved_model_predicts_alike(fitted, spark, tmp_path):
    df, m = fitted
    m.save(spark, str(tmp_path / "m"))
    again = il.IsotonicLogistic.load(spark, str(tmp_path / "m"))
    a = {r["id"]: r["PredictedProbability"] for r in m.predict(df).collect()}
    assert all(abs(a[r["id"]] - r["PredictedProbability"]) < 1e-12 for r in again.predict(df).collect())


def test_weak_features_are_dropped(spark):
    m = il.IsotonicLogistic(["rising", "constant"], effect_size=0.15).fit(simulate(spark, 3, 2000))
    assert m.curves["constant"].dropped and not m.curves["rising"].dropped
    assert m.importances()["constant"]["f2l"] == 0


def test_ties_are_spread_inside_the_midpoints(spark):
    rows = [(0, i, x, 1.0) for i, x in enumerate([1.0, 1.0, 2.0, 2.0, 2.0, 5.0])]
    got = sorted((r["x"], r["xo"]) for r in il.spread_ties(spark.createDataFrame(rows, "feature int, row long, x double, y double")).collect())
    assert len({o for _, o in got}) == 6
    for x, o in got:
        lo, hi = {1.0: (0.5, 1.5), 2.0: (1.5, 3.5), 5.0: (3.5, 6.5)}[x]
        assert lo < o < hi


def test_run_log_odds_by_hand(spark):
    labels = [0, 0, 0, 1, 0, 1, 1, 1]
    pts = spark.createDataFrame([(0, i, float(i), float(y), float(i)) for i, y in enumerate(labels)], "feature int, row long, x double, y double, xo double")
    runs = il.label_runs(pts)
    assert sorted((r["x"], r["y"], r["n"]) for r in runs.collect()) == [(1.0, 0.0, 3.0), (3.0, 1.0, 1.0), (4.0, 0.0, 1.0), (6.0, 1.0, 3.0)]
    odds = {r["x"]: r["y"] for r in il.run_log_odds(runs).collect()}
    assert abs(odds[3.0] - math.log(((1 + (1 + 3) / 2) / 2) / ((3 + 1) / 2))) < 1e-12
    assert abs(odds[1.0] + math.log(((3 + (1 + 3) / 2) / 2) / 1)) < 1e-12


def test_turning_point(spark):
    x = np.linspace(-3, 3, 200)
    df = spark.createDataFrame([(float(a), float(a * a)) for a in x], "x double, y double")
    kx, ky = il.turning_knots(df)
    assert np.abs(ky - kx**2).mean() < 0.3 and ky[0] > 7 and ky[-1] > 7 and ky.min() < 0.5


def test_regression_task(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 5, 300)
    df = spark.createDataFrame([(i, float(v), float(v * v + rng.normal() * 0.1)) for i, v in enumerate(x)], "id long, x double, label double")
    m = il.IsotonicLogistic(["x"], task="regression", drop_weak=False).fit(df)
    err = m.predict(df).select(F.avg(F.abs(F.col("PredictedProbability") - F.col("label")))).first()[0]
    assert err < 0.5


def test_missing_values(spark):
    df = simulate(spark, 5).withColumn("rising", F.when(F.col("id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("rising")))
    out = il.IsotonicLogistic(["rising", "noise"], excluded=["noisy"], drop_weak=False).fit(df).predict(df)
    assert out.filter("PredictedProbability IS NULL OR isnan(PredictedProbability)").count() == 0
    with pytest.raises(Exception, match="missing value"):
        il.IsotonicLogistic(["rising"], nan_policy="raise").fit(df)


def test_grid(spark):
    df = simulate(spark, 7)
    out = grid.grid(df, df, ["rising", "noisy", "noise"], "label", [("standard", "logistic"), ("none", "lda"), ("minmax", "qda")])
    rows = {(r["scaler"], r["classifier"]): r["auroc"] for r in out.collect()}
    assert len(rows) == 3 and min(rows.values()) > 0.75
    assert grid.score_table(out).count() == 3
    bad = spark.createDataFrame([([0.5, 0.5],), ([0.5, 0.6],), ([1.0],)], "probs array<double>")
    assert grid.bad_probabilities(bad).count() == 2
