"""Ensembles, calibration and imputation against plain numpy loops, with ties, gaps and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import ensembles as E
from marlstone.operators import features as X


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x, z = rng.normal(size=300), rng.normal(size=300)
    y = 2 * x - z + rng.normal(scale=0.3, size=300)
    data = [(int(i), float(a), float(b), float(c), int(c > 0), int(i % 4)) for i, (a, b, c) in enumerate(zip(x, z, y))]
    return spark.createDataFrame(data, "id long, x double, z double, y double, label int, fold int").repartition(5)


def test_stacking_equals_a_loop_over_folds(rows):
    got, members = E.stacked_linear(rows, {"a": ["x"], "b": ["z", "x"]}, "y", "fold")
    p = rows.toPandas()
    outer = np.zeros((len(p), 2))
    for k in range(4):
        for m, cs in enumerate([["x"], ["z", "x"]]):
            fit, own = p[p.fold != k], (p.fold == k).to_numpy()
            b = np.linalg.lstsq(np.c_[np.ones(len(fit)), fit[cs]], fit.y, rcond=None)[0]
            outer[own, m] = np.c_[np.ones(own.sum()), p.loc[own, cs]] @ b
    want = np.linalg.lstsq(np.c_[np.ones(len(p)), outer], p.y, rcond=None)[0]
    assert np.allclose([got["intercept"], got["a"], got["b"]], want)
    error = rows.select(F.avg(F.pow(E.stacked_prediction(got, members) - F.col("y"), 2))).first()[0]
    assert error < 0.2


def test_boosting_equals_a_loop(rows):
    cuts = {"x": [-0.5, 0.0, 0.5], "z": [-0.5, 0.0, 0.5]}
    got = E.adaboost(rows, ["x", "z"], "label", 5, cuts=cuts)
    p, w = rows.toPandas(), np.full(300, 1 / 300)
    for stump in got:
        best = min((min(e := w[(p[c] > t).astype(int) != p.label].sum(), 1 - e), c, t) for c, at in cuts.items() for t in at)
        assert (stump["feature"], stump["threshold"]) == best[1:] and np.isclose(stump["error"], best[0])
        says = (p[stump["feature"]] > stump["threshold"]).astype(int) if stump["polarity"] > 0 else (p[stump["feature"]] <= stump["threshold"]).astype(int)
        w = w * np.exp(stump["alpha"] * (2 * (says != p.label) - 1))
        w /= w.sum()
    right = rows.select(F.avg((E.adaboost_prediction(got) == F.col("label")).cast("double"))).first()[0]
    assert right > 0.85


def test_boosting_stops_after_a_perfect_stump_and_without_rows(rows):
    assert len(E.adaboost(rows, ["y"], "label", 9, cuts={"y": [0.0]})) == 1
    assert E.adaboost(rows.limit(0), ["x"], "label", 3) == []


def test_bags_are_bootstraps_that_agree_between_runs(rows):
    one, two = (E.bagged_linear(d, "id", ["x", "z"], "y", 8).orderBy("bag").collect() for d in (rows, rows.repartition(2)))
    assert np.allclose([tuple(r) for r in one], [tuple(r) for r in two])
    assert abs(np.mean([r["x"] for r in one]) - 2) < 0.1 and np.std([r["x"] for r in one]) > 0


def test_poisson_counts_have_mean_and_variance_one(spark):
    n = spark.range(40_000).select(E.poisson_count((F.col("id") + 0.5) / 40_000).alias("n")).agg(F.avg("n"), F.var_pop("n")).first()
    assert np.allclose(n, [1, 1], atol=0.01)


def test_sigmoid_calibration_is_calibrated(rows):
    a, b = E.sigmoid_calibration(rows, "x", "label")
    assert a > 0
    p = 1 / (1 + F.exp(-(a * F.col("x") + b)))
    got, want = rows.select(F.avg(p), F.avg("label")).first()
    assert abs(got - want) < 0.01


def test_temperature_goes_down_the_loss(rows):
    z = rows.select((-F.col("x")).alias("z0"), F.col("x").alias("z1"), "label")
    t = E.temperature(z, ["z0", "z1"], "label", 30, 0.5)
    loss = lambda v: z.select(F.avg(F.log1p(F.exp(-(2 * F.col("label") - 1) * 2 * F.col("z1") / v)))).first()[0]
    assert loss(t) < loss(1.0) and loss(t) <= min(loss(t * 0.9), loss(t * 1.1))


def test_iterative_fills_approach_the_truth_and_keep_what_is_there(spark, rows):
    gappy = rows.select("id", F.when(F.col("id") % 5 != 0, F.col("x")).alias("x"), F.col("z"), F.when(F.col("id") % 7 != 0, F.col("y")).alias("y"), F.lit(None).cast("double").alias("none"))
    out = X.iterative_impute(gappy, ["x", "z", "y", "none"]).toPandas().set_index("id")
    true = rows.toPandas().set_index("id").loc[out.index]
    there = out.index % 5 != 0
    assert len(out) == 300 and (out.x[there] == true.x[there]).all() and out.none.isna().all()
    assert np.abs(out.x - true.x)[~there].mean() < 0.35 and not out.y.isna().any()
    assert X.iterative_impute(gappy.limit(0), ["x", "y"]).count() == 0
    means = X.iterative_impute(gappy, ["x"], linear=False).filter("id % 5 = 0").select("x").distinct().collect()
    assert len(means) == 1


def test_chain_predicts_from_predictions(rows):
    models = E.regressor_chain(rows, ["x"], ["y", "z"])
    got = E.chain_predictions(rows, models).filter("id = 7").first()
    y = models["y"]["intercept"] + models["y"]["x"] * got["x"]
    assert np.isclose(got["y_pred"], y)
    assert np.isclose(got["z_pred"], models["z"]["intercept"] + models["z"]["x"] * got["x"] + models["z"]["y"] * y)
